"""Source trees as DataFrames: scan records with fingerprints, contents, line counts.

Directories are listed on the driver (metadata only); contents are read by tasks, from a folder that all executors see.
Unlike Spark's own file sources this keeps empty files and names that begin with ``_`` or ``.``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.build import classify, extension_counts, updated_cache
from cairn.sources.ignore import IGNORE_FILES, IgnoreMatcher

RECORD = "path string, absolute_path string, sha256 string, size bigint, mtime double"
CONTENT = f"{RECORD}, content binary, line_count bigint"


def list_files(root: str, matcher: IgnoreMatcher | None = None) -> Iterator[tuple[str, str]]:
    """Root-relative and absolute paths of tracked files; ignored directories are not entered."""
    matcher = matcher or IgnoreMatcher.for_workspace(root)
    for folder, names, files in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        base = "" if base == "." else base + "/"
        names[:] = sorted(n for n in names if not matcher.is_ignored(base + n, True))
        for name in sorted(files):
            if not matcher.is_ignored(base + name):
                yield base + name, os.path.join(folder, name)


def line_count(content: bytes) -> int:
    """Newline-ended lines, and one more for a trailing rest."""
    return content.count(b"\n") + (1 if content and not content.endswith(b"\n") else 0)


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "absolute_path", "sha256", "size", "mtime", "content", "line_count"]
    for part in parts:
        rows = []
        for path, absolute in zip(part["path"], part["absolute_path"]):
            try:
                mtime = os.stat(absolute).st_mtime
                with open(absolute, "rb") as f:
                    content = f.read()
            except OSError:  # vanished or unreadable files are left out
                continue
            rows.append((path, absolute, hashlib.sha256(content).hexdigest(), len(content), mtime, content, line_count(content)))
        yield pd.DataFrame(rows, columns=columns)


def read_workspace(spark: SparkSession, root: str, matcher: IgnoreMatcher | None = None, partitions: int = 0) -> DataFrame:
    """``path, absolute_path, sha256, size, mtime, content, line_count`` of each tracked file; no rows if ``root`` is no folder."""
    found = list(list_files(root, matcher)) if os.path.isdir(root) else []
    listed = spark.createDataFrame(found, "path string, absolute_path string")
    return listed.repartition(partitions or max(1, min(len(found) // 100, 10_000))).mapInPandas(_read, CONTENT)


def scan(spark: SparkSession, root: str, cache: DataFrame | None = None, matcher: IgnoreMatcher | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan records, and ``path, change`` against the fingerprints of ``cache`` (all ``added`` without one)."""
    records = read_workspace(spark, root, matcher).select("path", "absolute_path", "sha256", "size", "mtime")
    none = spark.createDataFrame([], "path string, sha256 string, size bigint, mtime double")
    return records, classify(records, none if cache is None else cache)


def metrics(files: DataFrame) -> DataFrame:
    """``file_count, line_count`` in one row."""
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("bigint").alias("line_count"))


def metrics_increased(before: tuple[int, int], now: tuple[int, int]) -> bool:
    return now[0] > before[0] or now[1] > before[1]


def workspace_info(spark: SparkSession, root: str) -> dict:
    """Ignore files found, and the tracked files and directories as DataFrames; ValueError if ``root`` is no folder."""
    if not os.path.isdir(root):
        raise ValueError(f"{root} is no folder")
    matcher = IgnoreMatcher.for_workspace(root)
    files = spark.createDataFrame(list(list_files(root, matcher)), "path string, absolute_path string")
    folders = files.select(F.explode(paths.ancestors("path")).alias("path")).where("path <> ''").distinct()
    ignore = [f"{d}/{n}".lstrip("/") for d in matcher.by_directory for n in IGNORE_FILES if os.path.isfile(os.path.join(root, d, n))]
    return {"ignore_files": sorted(ignore), "files": files, "directories": folders, "extensions": extension_counts(files)}


__all__ = ["classify", "extension_counts", "line_count", "list_files", "metrics", "metrics_increased", "read_workspace", "scan", "updated_cache", "workspace_info"]
