"""Sessions, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cairn", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is developed with; on a cluster use its own session."""
    settings = {
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory with one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is local (tests on one machine) a temporary folder is made, and set for later
    calls; on a cluster each executor would write to its own disk, so there it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.cairn.local.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        conf = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.cairn.local.dir", conf)
    return conf


_written: dict[str, SparkSession] = {}


def _remove(paths: list[str]) -> None:
    for path in paths:
        spark = _written.pop(path, None)
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone, and its folder with it
            pass


atexit.register(lambda: _remove(list(_written)))


def materialize(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders per value of ``by``, and read it back.

    This cuts the lineage with a compressed table that survives the loss of executors. Tables are removed by ``discard``, at the end
    of a ``scratch`` block, or when the process ends.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _written[path] = spark
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._cairn_path = path
    return out


def is_written(table: DataFrame) -> bool:
    """Whether ``materialize`` returned the table and it has not been removed."""
    return getattr(table, "_cairn_path", None) in _written


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` returned and nothing reads any more; others are left alone."""
    _remove([t._cairn_path for t in tables if getattr(t, "_cairn_path", None) in _written])


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end all tables that were materialized inside: use results within the block, or write them there."""
    before = set(_written)
    try:
        yield
    finally:
        _remove([p for p in _written if p not in before])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for Python work on tables of few splits; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
