"""The query interface over the latest graph: filters, search, neighbourhoods, statistics. Rows come ordered by node id where limited."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import intelligence, timeline
from cairn.operators.graph import PropertyGraph


def _limit(n: int) -> int:
    if n <= 0:
        raise ValueError("limit must be positive")
    return n


def query_graph(graph: PropertyGraph, node_type: str | None = None, file_path: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes by type, prefix of the path and kind."""
    found = graph.nodes
    if node_type:
        found = found.where(F.col("node_type") == node_type)
    if file_path:
        found = found.where(F.col("file_path").startswith(file_path))
    if kind:
        found = found.where(F.col("kind") == kind)
    return found.orderBy("node_id").limit(_limit(limit))


def search_nodes(graph: PropertyGraph, query: str, node_type: str | None = None, limit: int = 25) -> DataFrame:
    """Nodes whose id, names or path contain the text, whatever its case."""
    if not query.strip():
        raise ValueError("query is blank")
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for c in ("node_id", "name", "qualified_name", "file_path"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    found = graph.nodes.where(hit)
    if node_type:
        found = found.where(F.col("node_type") == node_type)
    return found.orderBy("node_id").limit(_limit(limit))


def get_neighbors(graph: PropertyGraph, node_id: str, direction: str = "both") -> DataFrame:
    """One row per edge at a node: ``direction, neighbor, edge_type`` and the neighbour's type and path."""
    if direction not in ("both", "in", "out", "incoming", "outgoing"):
        raise ValueError(direction)
    here = graph.nodes.select(F.col("node_id").alias("neighbor"), "node_type", "file_path")
    parts = []
    if direction in ("both", "in", "incoming"):
        parts.append(graph.in_edges(node_id).select(F.lit("incoming").alias("direction"), F.col("source").alias("neighbor"), "edge_type"))
    if direction in ("both", "out", "outgoing"):
        parts.append(graph.out_edges(node_id).select(F.lit("outgoing").alias("direction"), F.col("target").alias("neighbor"), "edge_type"))
    edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return edges.join(here, "neighbor").select("direction", "neighbor", "edge_type", "node_type", "file_path")


def neighbor_details(graph: PropertyGraph, node_id: str) -> DataFrame:
    """One row per edge at a node, a loop in both directions: ``direction, neighbor`` and all attributes of the edge and of the neighbour as structs."""
    node = graph.nodes.select(F.col("node_id").alias("neighbor"), F.struct(*[c for c in graph.nodes.columns if c != "node_id"]).alias("node"))
    edge = F.struct(*[c for c in graph.edges.columns if c not in ("source", "target")]).alias("edge")
    into = graph.in_edges(node_id).select(F.lit("incoming").alias("direction"), F.col("source").alias("neighbor"), edge)
    out = graph.out_edges(node_id).select(F.lit("outgoing").alias("direction"), F.col("target").alias("neighbor"), edge)
    return into.unionByName(out).join(node, "neighbor", "left").select("direction", "neighbor", "edge", "node")


def delta_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, kind, n`` of a delta of nodes and edges."""
    count = lambda df, part: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges"))


def statistics(graph: PropertyGraph) -> DataFrame:
    """One row of counts by node type, distinct communities and bridges."""
    count = lambda c: F.count(F.when(c, True))
    kinds = [count(F.col("node_type") == t).alias(f"{t}_count") for t in ("file", "symbol", "import", "proxy")]
    extra = [F.count_distinct("community_id").alias("community_count"), count(F.col("is_bridge")).alias("bridge_count")] if "community_id" in graph.nodes.columns else []
    return graph.nodes.agg(F.count(F.lit(1)).alias("node_count"), *kinds, *extra).join(graph.edges.agg(F.count(F.lit(1)).alias("edge_count")))


def language_histogram(graph: PropertyGraph) -> DataFrame:
    known = graph.nodes.where("node_type = 'file' and language is not null and language <> ''")
    return known.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def node_metrics(graph: PropertyGraph) -> DataFrame:
    """Degrees, churn and complexity per node, each with the maximum over all nodes beside it."""
    each = graph.degrees().join(graph.nodes.select("node_id", F.coalesce("churn", F.lit(0)).alias("churn"), F.coalesce("complexity", F.lit(0)).alias("complexity")), "node_id")
    top = each.agg(*[F.max(c).alias(f"max_{c}") for c in ("in_degree", "out_degree", "churn", "complexity")])
    return each.join(F.broadcast(top))  # one row


def file_metadata(graph: PropertyGraph, path: str) -> DataFrame:
    return graph.nodes.where((F.col("node_type") == "file") & (F.col("file_path") == path))


def symbol_count(graph: PropertyGraph, path: str | None = None) -> int:
    """Symbols of a file, or of all."""
    found = graph.nodes.where("node_type = 'symbol'")
    return (found.where(F.col("file_path") == path) if path else found).count()


def _plain(row) -> dict:
    """A row's values without nulls, structs too."""
    return {k: {a: b for a, b in v.items() if b is not None} if isinstance(v, dict) else v for k, v in row.asDict(True).items() if v is not None}


class GraphStore:
    """Answers over the latest snapshot of a timeline, in ``{status, data, error}`` envelopes; the newest id is looked up for every call.

    A call that takes longer than ``timeout`` seconds has its jobs cancelled and answers with an error. Lists come in pages of
    at most ``PAGE`` rows (``limit``, ``offset``), with ``more`` in the envelope if the next page has rows.
    """

    PAGE = 1000

    def __init__(self, store: timeline.Timeline, timeout: float = 30.0) -> None:
        self.store, self.timeout = store, timeout

    def _answer(self, f: Callable[[PropertyGraph], object], limit: int | None = None, offset: int = 0) -> dict:
        context, group, late = self.store.spark.sparkContext, f"answer-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(self.timeout, stop)
        context.setJobGroup(group, "query", True)
        timer.start()
        try:
            size = _limit(self.PAGE if limit is None else limit)
            data, more = f(self.store.load()), {}
            if isinstance(data, DataFrame):
                rows = data.offset(offset).limit(size + 1).collect()
                data, more = [r.asDict(True) for r in rows[:size]], {"more": len(rows) > size}
            return {"status": "ok", "data": data, "error": None, **more}
        except (ValueError, KeyError) as e:
            return {"status": "error", "data": None, "error": str(e.args[0]) if e.args else str(e)}
        except Exception as e:
            if not late.is_set():
                raise
            return {"status": "error", "data": None, "error": f"timed out after {self.timeout:g} s: {type(e).__name__}"}
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def _summary(self, g: PropertyGraph) -> dict:
        head = self.store.rows("snapshots").orderBy(F.desc("snapshot_id")).first()
        latest = head.snapshot_id if head else None
        nodes, edges = g.number_of_nodes(), g.number_of_edges()
        return {
            "snapshot_id": latest, "latest_snapshot_id": latest, "current": True, "label": head.label if head else None, "empty": nodes == 0,
            "node_count": nodes, "edge_count": edges,
        }

    def summary(self) -> dict:
        return self._answer(self._summary)

    def get_graph(self, include_nodes: bool = False, include_edges: bool = False, limit: int = 100) -> dict:
        """The summary, with the first nodes by id and the first edges by their ends if asked for."""

        def find(g: PropertyGraph) -> dict:
            out = self._summary(g)
            if include_nodes:
                out["nodes"] = [_plain(r) for r in g.nodes.orderBy("node_id").limit(_limit(limit)).collect()]
            if include_edges:
                out["edges"] = [_plain(r) for r in g.edges.orderBy("source", "target", "edge_type").limit(_limit(limit)).collect()]
            return out

        return self._answer(find)

    def query_graph(self, node_type: str | None = None, file_path: str | None = None, kind: str | None = None, limit: int = 50) -> dict:
        def find(g: PropertyGraph) -> dict:
            found = [_plain(r) for r in query_graph(g, node_type, file_path, kind, limit).collect()]
            return {"count": len(found), "limit": limit, "nodes": found, "empty": not found and not g.nodes.take(1)}

        return self._answer(find)

    def get_node(self, node_id: str) -> dict:
        def find(g: PropertyGraph) -> dict:
            if not node_id:
                raise ValueError("node_id is required")
            try:
                return {"node_id": node_id} | g.get_node(node_id)
            except KeyError:
                raise KeyError(f"no node {node_id}") from None

        return self._answer(find)

    def get_neighbors(self, node_id: str, direction: str = "both", limit: int | None = None) -> dict:
        """``incoming`` and ``outgoing``: the first edges by neighbour, each with its attributes and those of the neighbour."""

        def find(g: PropertyGraph) -> dict:
            if not node_id:
                raise ValueError("node_id is required")
            if direction not in ("both", "in", "out"):
                raise ValueError(f"unknown direction {direction}")
            if not g.has_node(node_id):
                raise KeyError(f"no node {node_id}")
            found, size = neighbor_details(g, node_id), _limit(self.PAGE if limit is None else limit)
            out = {"node_id": node_id, "direction": direction, "incoming": [], "outgoing": []}
            for side, name in (("in", "incoming"), ("out", "outgoing")):
                if direction in (side, "both"):
                    rows = found.where(F.col("direction") == name).orderBy("neighbor", "edge.edge_type").limit(size).collect()
                    out[name] = [{"node_id": r.neighbor, **{k: v for k, v in _plain(r).items() if k in ("edge", "node")}} for r in rows]
            return out

        return self._answer(find)

    def search_nodes(self, query: str, **options) -> dict:
        return self._answer(lambda g: search_nodes(g, query, **options))

    def get_changes(self, snapshot_from: int, snapshot_to: int, limit: int | None = None) -> dict:
        """Nodes added, removed and modified and edges added and removed, the first ones of each by id, with the number of all in ``counts``."""

        def find(g: PropertyGraph) -> dict:
            size = _limit(self.PAGE if limit is None else limit)
            nodes, edges = self.store.delta(snapshot_from, snapshot_to)
            out = {"snapshot_from": snapshot_from, "snapshot_to": snapshot_to, "counts": {}}
            counts = {(r.part, r.kind): r.n for r in delta_counts(nodes, edges).collect()}
            for kind in ("added", "removed", "modified"):
                out["counts"][f"{kind}_nodes"] = counts.get(("nodes", kind), 0)
                out[f"{kind}_nodes"] = [r.node_id for r in nodes.where(F.col("kind") == kind).orderBy("node_id").limit(size).collect()]
            for kind in ("added", "removed"):
                out["counts"][f"{kind}_edges"] = counts.get(("edges", kind), 0)
                out[f"{kind}_edges"] = [(r.source, r.target) for r in edges.where(F.col("kind") == kind).orderBy("source", "target").limit(size).collect()]
            return out

        return self._answer(find)

    def get_timeline(self, node_id: str | None = None) -> dict:
        """The snapshots, one row per delivery, and a node's attributes in each of them."""

        def find(g: PropertyGraph) -> dict:
            heads = [r.asDict() for r in self.store.rows("snapshots").orderBy("snapshot_id").collect()]
            out = {"snapshots": heads, "count": len(heads), "empty": not heads}
            if node_id:
                rows = self.store.history(node_id).orderBy("snapshot_id").collect()  # at most one row per snapshot
                attrs = lambda r: {k: v for k, v in _plain(r).items() if k not in ("snapshot_id", "created_at", "attrs_hash", "node_id")}
                out |= {"node_id": node_id, "node_history": [{"snapshot_id": r.snapshot_id, "created_at": r.created_at, "attrs": attrs(r)} for r in rows]}
            return out

        return self._answer(find)

    def get_dead_code(self, limit: int | None = None, offset: int = 0, **options) -> dict:
        return self._answer(lambda g: intelligence.dead_code(g, **options).orderBy("node_id"), limit, offset)

    def get_entry_points(self, limit: int | None = None, offset: int = 0) -> dict:
        return self._answer(lambda g: intelligence.entry_points(g).orderBy("node_id"), limit, offset)

    def get_god_nodes(self, limit: int | None = None, offset: int = 0, **options) -> dict:
        return self._answer(lambda g: intelligence.god_nodes(g, **options).orderBy(F.desc("score"), "node_id"), limit, offset)

    def get_circular_deps(self, limit: int | None = None, offset: int = 0) -> dict:
        return self._answer(lambda g: intelligence.circular_dependencies(intelligence.file_import_graph(g)).orderBy("length", "path"), limit, offset)

    def get_complexity(self, limit: int = 25, **options) -> dict:
        return self._answer(lambda g: intelligence.complexity_rankings(g, **options).orderBy(F.desc("complexity"), "node_id"), limit)

    def get_churn(self, file_path: str | None = None, snapshot_from: int | None = None, snapshot_to: int | None = None, limit: int = 25) -> dict:
        if file_path:
            return self._answer(lambda g: {"file_path": file_path, "rate": self.store.churn_rate(file_path, snapshot_from, snapshot_to)}, limit)
        return self._answer(lambda g: intelligence.churn_rankings(g).orderBy(F.desc("churn"), "node_id"), limit)
