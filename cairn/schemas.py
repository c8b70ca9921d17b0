"""Columns of the property graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = {
    "node_id": "string", "node_type": "string", "file_path": "string", "name": "string", "qualified_name": "string", "kind": "string",
    "module": "string", "names": "array<string>", "is_relative": "boolean", "language": "string", "start_line": "int", "end_line": "int",
    "docstring": "string", "complexity": "bigint", "churn": "bigint", "size": "bigint", "mtime": "double", "sha256": "string",
    "absolute_path": "string", "parse_errors": "array<string>", "first_seen": "double", "last_seen": "double", "is_broken": "boolean",
    "community_id": "int", "is_bridge": "boolean",
}
EDGE_COLUMNS = {"source": "string", "target": "string", "edge_type": "string", "line": "int", "seq": "bigint"}
#: Attributes that change with every build and say nothing about the code.
VOLATILE = ("last_seen", "first_seen", "community_id", "is_bridge")


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with exactly these columns, missing ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def nodes(df: DataFrame) -> DataFrame:
    return conform(df, NODE_COLUMNS)


def edges(df: DataFrame) -> DataFrame:
    return conform(df, EDGE_COLUMNS)
