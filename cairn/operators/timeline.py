"""A store of full snapshots in Parquet, partitioned by ``snapshot_id``, and queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators.graph import PropertyGraph


def attrs_hash(df: DataFrame, strict: bool = False) -> Column:
    """A digest of a node's attributes; those that change with every build count only if ``strict``."""
    left_out = {"node_id", "snapshot_id"} | (set() if strict else set(schemas.VOLATILE))
    return F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in left_out])), 256)


def delta_nodes(rows: DataFrame, snapshot_from: int, snapshot_to: int) -> DataFrame:
    """``node_id, kind`` (added, removed, modified) between any two snapshots of ``snapshot_id, node_id, attrs_hash``. An unknown snapshot is empty."""
    if snapshot_from <= 0 or snapshot_to <= 0:
        raise ValueError("snapshot ids are positive")
    a = rows.where(F.col("snapshot_id") == snapshot_from).select("node_id", F.col("attrs_hash").alias("old"))
    b = rows.where(F.col("snapshot_id") == snapshot_to).select("node_id", F.col("attrs_hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "node_id", "full_outer").select("node_id", kind.alias("kind")).where("kind is not null")


def delta_edges(rows: DataFrame, snapshot_from: int, snapshot_to: int, by_type: bool = False) -> DataFrame:
    """``source, target, kind`` (added, removed); attributes of edges don't count, the type only ``by_type``."""
    keys = ["source", "target", *(["edge_type"] if by_type else [])]
    a = rows.where(F.col("snapshot_id") == snapshot_from).select(*keys).distinct()
    b = rows.where(F.col("snapshot_id") == snapshot_to).select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("kind", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("kind", F.lit("removed")))


def node_history(rows: DataFrame, snapshots: DataFrame, node_id: str) -> DataFrame:
    return rows.where(F.col("node_id") == node_id).join(snapshots.select("snapshot_id", "created_at"), "snapshot_id")


def churn_rates(rows: DataFrame, snapshots: DataFrame, snapshot_from: int | None = None, snapshot_to: int | None = None) -> DataFrame:
    """``node_id, changes, rate``: the share of steps between neighbouring snapshots in which a node vanished or changed. A node that
    comes back didn't change. Bounds may be reversed; with fewer than two snapshots rates are 0."""
    if snapshot_from is not None and snapshot_to is not None and snapshot_from > snapshot_to:
        snapshot_from, snapshot_to = snapshot_to, snapshot_from
    chosen = snapshots.select("snapshot_id").distinct()
    if snapshot_from is not None:
        chosen = chosen.where(F.col("snapshot_id") >= snapshot_from)
    if snapshot_to is not None:
        chosen = chosen.where(F.col("snapshot_id") <= snapshot_to)
    order = chosen.select("snapshot_id", F.row_number().over(Window.orderBy("snapshot_id")).alias("pos"))  # one row per snapshot
    n = order.agg(F.max("pos").alias("n"))
    at = rows.join(order, "snapshot_id").select("node_id", "pos", "attrs_hash")
    w = Window.partitionBy("node_id").orderBy("pos")
    steps = at.select("node_id", "pos", "attrs_hash", F.lead("pos").over(w).alias("next"), F.lead("attrs_hash").over(w).alias("then")).join(F.broadcast(n))  # one row
    changed = F.when(F.col("pos") == F.col("n"), 0).when(F.col("next").isNull() | (F.col("next") > F.col("pos") + 1), 1).when(F.col("then") != F.col("attrs_hash"), 1).otherwise(0)
    sums = steps.groupBy("node_id").agg(F.sum(changed).alias("changes"), F.max("n").alias("n"))
    return sums.select("node_id", "changes", F.when(F.col("n") < 2, 0.0).otherwise(F.col("changes") / (F.col("n") - 1)).alias("rate"))


#: The columns of a timeline's tables.
EMPTY = {
    "snapshots": "snapshot_id bigint, created_at double, label string, node_count bigint, edge_count bigint",
    "nodes": ", ".join(f"{c} {t}" for c, t in schemas.NODE_COLUMNS.items()) + ", attrs_hash string, snapshot_id bigint",
    "edges": ", ".join(f"{c} {t}" for c, t in schemas.EDGE_COLUMNS.items()) + ", snapshot_id bigint",
}


class Timeline:
    """Snapshots under a folder: ``snapshots``, ``nodes`` and ``edges``; ids count up from 1."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing recorded yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def record(self, graph: PropertyGraph, label: str | None = None, created_at: float = 0.0) -> int:
        """Append a snapshot. Edges are kept once per source, target and type; the header's count is of all."""
        new = (self.latest() or 0) + 1
        nodes = schemas.nodes(graph.nodes)
        nodes = nodes.withColumn("attrs_hash", attrs_hash(nodes)).withColumn("snapshot_id", F.lit(new).cast("bigint"))
        edges = schemas.edges(graph.edges)
        once = edges.groupBy("source", "target", "edge_type").agg(F.max("line").alias("line"), F.max("seq").alias("seq")).withColumn("snapshot_id", F.lit(new).cast("bigint"))
        nodes.sortWithinPartitions("node_id").write.mode("append").partitionBy("snapshot_id").parquet(f"{self.path}/nodes")
        once.write.mode("append").partitionBy("snapshot_id").parquet(f"{self.path}/edges")
        head = graph.nodes.agg(F.count(F.lit(1)).alias("node_count")).join(edges.agg(F.count(F.lit(1)).alias("edge_count")))
        head = head.select(F.lit(new).cast("bigint").alias("snapshot_id"), F.lit(float(created_at)).alias("created_at"), F.lit(label).cast("string").alias("label"), "node_count", "edge_count")
        head.coalesce(1).write.mode("append").parquet(f"{self.path}/snapshots")  # written last: a snapshot without header doesn't count
        return new

    def snapshots(self) -> DataFrame | None:
        return self._read("snapshots")

    def latest(self) -> int | None:
        heads = self.snapshots()
        return None if heads is None else heads.agg(F.max("snapshot_id")).first()[0]

    def load(self, snapshot_id: int | None = None) -> PropertyGraph:
        """A snapshot's graph, the latest by default; an empty graph if there is none. Only its partition is read."""
        snapshot_id = self.latest() if snapshot_id is None else snapshot_id
        nodes, edges = self._read("nodes"), self._read("edges")
        if snapshot_id is None or nodes is None:
            return PropertyGraph.empty(self.spark)
        at = F.col("snapshot_id") == snapshot_id
        return PropertyGraph(nodes.where(at).drop("snapshot_id", "attrs_hash"), schemas.edges(edges.where(at)) if edges is not None else PropertyGraph.empty(self.spark).edges)

    def rows(self, name: str) -> DataFrame:
        """``snapshots``, ``nodes`` or ``edges`` of all snapshots, without rows before the first one."""
        found = self._read(name)
        return found if found is not None else self.spark.createDataFrame([], EMPTY[name])

    def delta(self, snapshot_from: int, snapshot_to: int) -> tuple[DataFrame, DataFrame]:
        return delta_nodes(self.rows("nodes"), snapshot_from, snapshot_to), delta_edges(self.rows("edges"), snapshot_from, snapshot_to)

    def history(self, node_id: str) -> DataFrame:
        return node_history(self.rows("nodes"), self.rows("snapshots"), node_id)

    def churn_rate(self, file_path: str, snapshot_from: int | None = None, snapshot_to: int | None = None) -> float:
        rows = self.rows("nodes").where(F.col("node_id") == "file:" + file_path)
        got = churn_rates(rows, self.rows("snapshots"), snapshot_from, snapshot_to).first()
        return 0.0 if got is None else got.rate
