"""Graph documents: JSON with ``metadata``, ``nodes`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators.graph import PropertyGraph


def _pick(df: DataFrame, *names: str):
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def read_graph_document(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph of a JSON document; ids may be called ``id`` or ``node_id``, ends ``source``/``from`` and ``target``/``to``.

    A missing file is a FileNotFoundError, a text that is no such document a ValueError.
    """
    try:
        doc = spark.read.option("multiLine", True).json(path)
        columns = doc.columns
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if "_corrupt_record" in columns or "nodes" not in columns:
        raise ValueError(f"{path} is no graph document")
    raw = doc.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = schemas.nodes(raw.withColumn("node_id", _pick(raw, "id", "node_id")))
    if "edges" not in columns or not str(doc.schema["edges"].dataType).startswith("ArrayType(StructType"):
        return PropertyGraph(nodes, PropertyGraph.empty(spark).edges)
    raw = doc.select(F.explode("edges").alias("e")).select("e.*")
    return PropertyGraph(nodes, schemas.edges(raw.withColumn("source", _pick(raw, "source", "from")).withColumn("target", _pick(raw, "target", "to"))))
