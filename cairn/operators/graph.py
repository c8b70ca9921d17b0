"""A directed property graph of two DataFrames, and its primitives.

``nodes`` has ``node_id`` and attributes, ``edges`` has ``source, target, edge_type`` and is a bag. All methods are lazy unless they
return a number or a truth value; methods that change something return a new graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schemas
from cairn.session import discard, materialize


def last_wins(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (null lowest; without order any one, as rows are then equal)."""
    rest = [c for c in df.columns if c not in keys]
    first = [F.col(order)] if order else []
    return df.groupBy(*keys).agg(F.max(F.struct(*first, *[F.col(c).alias(f"_{c}") for c in rest])).alias("_r")).select(*keys, *[F.col(f"_r._{c}").alias(c) for c in rest])


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        none = spark.range(0)
        return cls(schemas.nodes(none), schemas.edges(none))

    def add_nodes(self, new: DataFrame) -> PropertyGraph:
        """Upsert: nodes of ``new`` replace all attributes of old ones with the same id."""
        kept = self.nodes.join(new.select("node_id").distinct(), "node_id", "left_anti")
        return replace(self, nodes=kept.unionByName(last_wins(new, ["node_id"]), allowMissingColumns=True))

    def add_edges(self, new: DataFrame) -> PropertyGraph:
        """Append edges; end points that are no nodes yet become nodes without attributes."""
        edges = self.edges.unionByName(new, allowMissingColumns=True)
        ends = new.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
        return PropertyGraph(self.nodes.unionByName(ends.join(self.nodes, "node_id", "left_anti"), allowMissingColumns=True), edges)

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Drop the nodes of ``ids`` (``node_id``) and all edges that touch them."""
        gone = ids.select("node_id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("node_id", "source"), "source", "left_anti").join(gone.withColumnRenamed("node_id", "target"), "target", "left_anti")
        return PropertyGraph(self.nodes.join(gone, "node_id", "left_anti"), edges.select(*self.edges.columns))

    def simple(self) -> PropertyGraph:
        """Parallel edges of one type merged."""
        return replace(self, edges=self.edges.select("source", "target", "edge_type").distinct())

    def subgraph(self, ids: DataFrame) -> PropertyGraph:
        kept = ids.select("node_id").distinct()
        edges = self.edges.join(kept.withColumnRenamed("node_id", "source"), "source", "left_semi").join(kept.withColumnRenamed("node_id", "target"), "target", "left_semi")
        return PropertyGraph(self.nodes.join(kept, "node_id", "left_semi"), edges.select(*self.edges.columns))

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        return self.edges.count()

    def has_node(self, node_id: str) -> bool:
        return bool(self.nodes.where(F.col("node_id") == node_id).take(1))

    def has_edge(self, source: str, target: str) -> bool:
        return bool(self.edges.where((F.col("source") == source) & (F.col("target") == target)).take(1))

    def get_node(self, node_id: str) -> dict:
        """Attributes of a node, nulls left out; KeyError if there is none."""
        rows = self.nodes.where(F.col("node_id") == node_id).take(1)
        if not rows:
            raise KeyError(node_id)
        return {k: v for k, v in rows[0].asDict(True).items() if v is not None and k != "node_id"}

    def get_edge(self, source: str, target: str) -> dict:
        """The first parallel edge (by ``seq`` if there is one, else by type); KeyError if there is none."""
        order = [c for c in ("seq", "edge_type", "line") if c in self.edges.columns]
        rows = self.edges.where((F.col("source") == source) & (F.col("target") == target)).orderBy(*order).take(1)
        if not rows:
            raise KeyError((source, target))
        return {k: v for k, v in rows[0].asDict(True).items() if v is not None and k not in ("source", "target")}

    def set_node_attr(self, node_id: str, name: str, value: object) -> PropertyGraph:
        """Nothing happens if there is no such node."""
        old = F.col(name) if name in self.nodes.columns else F.lit(None)
        return replace(self, nodes=self.nodes.withColumn(name, F.when(F.col("node_id") == node_id, F.lit(value)).otherwise(old)))

    def in_edges(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("target") == node_id)

    def out_edges(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("source") == node_id)

    def neighbors(self, node_id: str) -> DataFrame:
        """``node_id`` of the successors."""
        return self.out_edges(node_id).select(F.col("target").alias("node_id")).distinct()

    def in_degree(self, node_id: str) -> int:
        return self.in_edges(node_id).count()

    def out_degree(self, node_id: str) -> int:
        return self.out_edges(node_id).count()

    def degrees(self) -> DataFrame:
        """``node_id, in_degree, out_degree`` of every node; one shuffle of partial counts."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i")), F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i")))).alias("e"))
        counts = ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum(1 - F.col("e.i")).alias("out_degree"))
        return self.nodes.select("node_id").join(counts, "node_id", "left").select("node_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("in_degree", "out_degree")])

    def strongly_connected_components(self) -> DataFrame:
        """``node_id, component``: the smallest id of each node's component."""
        return strongly_connected_components(self.nodes.select("node_id"), self.edges.select("source", "target"))

    def node_link(self) -> DataFrame:
        """One JSON text per node and edge, tagged by ``part``."""
        n = self.nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("*")).alias("json"))
        return n.unionByName(self.edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("*")).alias("json")))

    def to_pandas(self, limit: int = 1_000_000) -> tuple:
        """Both tables for single-machine libraries; more than ``limit`` rows are refused."""
        if self.nodes.limit(limit + 1).count() > limit or self.edges.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} rows")
        return self.nodes.toPandas(), self.edges.toPandas()


def _spread(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the arcs, by doubling steps until nothing changes."""
    given = labels
    while True:
        sent = arcs.join(labels.withColumnRenamed("node_id", "source"), "source").select(F.col("target").alias("node_id"), "label")
        best = sent.unionByName(labels).groupBy("node_id").agg(F.min("label").alias("label"))
        # jump: a label's own label is as good; it halves the rounds on long chains
        own = best.select(F.col("node_id").alias("label"), F.col("label").alias("next"))
        new = materialize(best.join(own, "label", "left").select("node_id", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node_id").where("label <> old").take(1)
        if labels is not given:
            discard(labels)
        labels = new
        if not changed:
            return labels


def _tarjan(arcs: dict[str, list[str]]) -> dict[str, str]:
    """The smallest id of every node's component, without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    out: dict[str, str] = {}
    for root in arcs:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(arcs[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(arcs.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    first = min(group)
                    out.update((w, first) for w in group)
    return out


def _solve_components(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(parts)
    if frames:
        rows = pd.concat(frames, ignore_index=True)
        arcs: dict[str, list[str]] = {}
        for a, b in zip(rows["source"], rows["target"]):
            arcs.setdefault(a, []).append(b)
            arcs.setdefault(b, [])
        found = _tarjan(arcs)
        yield pd.DataFrame({"node_id": list(found), "component": list(found.values())})


def _inside(arcs: DataFrame, ids: DataFrame) -> DataFrame:
    """The arcs between nodes of ``ids``."""
    return arcs.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def strongly_connected_components(nodes: DataFrame, edges: DataFrame, task_arcs: int = 1_000_000) -> DataFrame:
    """``node_id, component``: the smallest id of each node's component.

    Nodes without arcs in or out are components of their own and go first. Then colouring: the smallest ancestor colours each
    node, and what reaches the colour's root inside the colour is a component. Both are repeated on what is left, which
    shrinks, until its arcs fit one task (``task_arcs``), where the rest is solved at once.
    """
    arcs = materialize(edges.where("source <> target").select("source", "target").distinct(), "arcs")
    left = materialize(nodes.select("node_id").distinct(), "nodes")
    done: list[DataFrame] = []

    def finish(rest: DataFrame) -> DataFrame:
        out = rest
        for d in done:
            out = out.unionByName(d)
        return out

    while True:
        if arcs.count() <= task_arcs:
            solved = arcs.coalesce(1).mapInPandas(_solve_components, "node_id string, component string")
            alone = left.join(solved, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
            return finish(materialize(alone, "components"))
        both = arcs.select(F.col("source").alias("node_id")).distinct().join(arcs.select(F.col("target").alias("node_id")).distinct(), "node_id", "left_semi")
        single = materialize(left.join(both, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component")), "single")
        left = materialize(left.join(both, "node_id", "left_semi"), "nodes")
        if single.take(1):
            done.append(single)
            arcs = materialize(_inside(arcs, left), "arcs")
            continue
        colours = _spread(left.select("node_id", F.col("node_id").alias("label")), arcs)
        a = colours.select(F.col("node_id").alias("source"), F.col("label").alias("ls"))
        b = colours.select(F.col("node_id").alias("target"), F.col("label").alias("lt"))
        back = materialize(arcs.join(a, "source").join(b, "target").where("ls = lt").select(F.col("target").alias("source"), F.col("source").alias("target")), "back")
        reach = front = colours.where("node_id = label").select("node_id", F.col("label").alias("component"))
        while front.take(1):
            step = back.join(front.withColumnRenamed("node_id", "source"), "source").select(F.col("target").alias("node_id"), "component").distinct()
            front = materialize(step.join(reach.select("node_id"), "node_id", "left_anti"), "front")
            reach = materialize(reach.unionByName(front), "reach")
        done.append(reach)
        left = materialize(left.join(reach.select("node_id"), "node_id", "left_anti"), "nodes")
        arcs = materialize(_inside(arcs, left), "arcs")


def _component_cycles(max_length: int | None):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        arcs: dict[str, list[str]] = {}
        into: dict[str, list[str]] = {}
        for a, b in sorted(zip(pdf["source"], pdf["target"])):
            arcs.setdefault(a, []).append(b)
            into.setdefault(b, []).append(a)
        best: dict[frozenset, list[str]] = {}
        for start in sorted(arcs):
            back, front = {start}, [start]  # nodes from which the start is reached by ids above it
            while front:
                front = [*{v for w in front for v in into.get(w, ()) if v > start and v not in back}]
                back.update(front)
            path, on = [start], {start}
            work = [iter(arcs[start])]
            while work:
                for w in work[-1]:
                    if w == start and len(path) > 1:
                        key = frozenset(path)
                        if key not in best or path < best[key]:
                            best[key] = path[:]
                    elif w in back and w not in on and (max_length is None or len(path) < max_length):
                        path.append(w)
                        on.add(w)
                        work.append(iter(arcs.get(w, ())))
                        break
                else:
                    work.pop()
                    on.discard(path.pop())
        found = list(best.values())
        return pd.DataFrame({"path": found, "length": [len(p) for p in found]})

    return find


def simple_cycles(edges: DataFrame, components: DataFrame, max_length: int | None = None, task_arcs: int = 20_000) -> DataFrame:
    """``path, length``: simple cycles of two or more nodes, one per set of nodes (the smallest path), starting at the smallest id.

    Only arcs inside a component are followed, and only to ids above the start. Components of up to ``task_arcs`` arcs are searched
    each in one task, larger ones by joins. The number of cycles can grow exponentially with a component's size;
    all of them are reported unless the caller bounds their length by ``max_length``.
    """
    c = components.groupBy("component").count().where("count > 1").join(components, "component").select("node_id", "component")
    arcs = edges.where("source <> target").select("source", "target").distinct()
    arcs = arcs.join(c.select(F.col("node_id").alias("source"), F.col("component").alias("cs")), "source").join(c.select(F.col("node_id").alias("target"), F.col("component").alias("ct")), "target")
    arcs = materialize(arcs.where("cs = ct").select("source", "target", F.col("cs").alias("component")), "arcs")
    sizes = arcs.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > task_arcs).select("component")
    found = arcs.join(large, "component", "left_anti").groupBy("component").applyInPandas(_component_cycles(max_length), "path array<string>, length int")
    if not large.take(1):
        return found
    arcs = materialize(arcs.join(large, "component", "left_semi").select("source", "target"), "arcs")
    paths = arcs.where("source < target").select(F.col("source").alias("start"), F.array("source", "target").alias("path"), F.col("target").alias("at"))
    by_joins = None
    for length in count(2) if max_length is None else range(2, max_length + 1):
        paths = materialize(paths, "paths")
        if not paths.take(1):
            break
        closed = paths.join(arcs.select(F.col("source").alias("at"), F.col("target").alias("start")), ["at", "start"]).select("path", F.lit(length).alias("length"))
        if by_joins is None or closed.take(1):
            by_joins = closed if by_joins is None else by_joins.unionByName(closed)
        onward = arcs.select(F.col("source").alias("at"), F.col("target").alias("to"))
        paths = paths.join(onward, "at").where((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("to"))).select("start", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
    once = by_joins.groupBy(F.array_sort("path").alias("_set")).agg(F.min("path").alias("path"), F.first("length").alias("length")).select("path", "length")
    return found.unionByName(once)
