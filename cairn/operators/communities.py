"""Communities of an undirected graph by Leiden's method.

Modularity is raised by moving nodes between communities; communities are split into connected parts, the parts become the nodes
of a smaller graph, and so on until nothing moves. Levels whose components fit a task are solved there, component by component;
levels above that move by joins, half of the nodes at a time. Both take the same steps by the same gain.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import intelligence
from cairn.operators.graph import PropertyGraph

from cairn.session import discard, materialize

#: The least rise of modularity for which another round of moves by joins is made.
LEAST_RISE = 1e-3


def _merged(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs by source, parallel ones as one; those of a source in the order in which they come first."""
    key, first, which = np.unique(src * n + dst, return_index=True, return_inverse=True)
    order = np.lexsort((first, key // n))
    return key[order] // n, key[order] % n, np.bincount(which, w, len(key))[order]


def _move(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], degree: np.ndarray, community: np.ndarray, allowed: list[int] | None, gamma: float, total: float, rng: random.Random) -> tuple[bool, np.ndarray]:
    """Whether any node moved, and the communities after each node went where the gain is greatest, as often as its neighbours moved.

    ``allowed``: nodes only see neighbours of the same value. Plain lists, as numpy is slower for single nodes.
    """
    src, dst, w = arcs
    n, twice = len(degree), 2 * total
    start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist()
    sums = np.bincount(community, degree, n).tolist()
    near, weight, own_degree, at = dst.tolist(), w.tolist(), degree.tolist(), community.tolist()
    queue, waiting, moved = list(range(n)), bytearray(b"\1") * n, False
    rng.shuffle(queue)
    while queue:
        later = []
        for i in queue:
            waiting[i] = 0
            own, k = at[i], gamma * own_degree[i]
            beside = near[start[i] : start[i + 1]]
            to = {own: 0.0}
            for j, x in zip(beside, weight[start[i] : start[i + 1]]):
                if allowed is None or allowed[j] == allowed[i]:
                    c = at[j]
                    to[c] = to[c] + x if c in to else x
            if len(to) == 1:
                continue
            sums[own] -= own_degree[i]
            stays = top = to.pop(own) - k * sums[own] / twice
            best = own
            for c, x in to.items():
                gain = x - k * sums[c] / twice
                if gain > top or (gain == top and c < best):
                    top, best = gain, c
            if top <= stays + 1e-12:
                best = own
            sums[best] += own_degree[i]
            if best != own:
                at[i], moved = best, True
                for j in beside:
                    if not waiting[j] and at[j] != best:
                        waiting[j] = 1
                        later.append(j)
        queue = later
    return moved, np.array(at, dtype=np.int64)


def _leiden(n: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], gamma: float, seed: int, total: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Community numbers: local moving, refinement into well-connected parts, aggregation, until nothing moves.

    ``edges`` has the ends (from 0) and the weight of each edge, ``total`` is the weight of all edges of the whole graph, ``weights`` what
    lies inside each node of an aggregated one. A level takes time in proportion to its arcs, save for sorting.
    """
    rng = random.Random(seed)
    a, b, w = (x[edges[0] != edges[1]] for x in edges)
    arcs = _merged(np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel(), np.repeat(w, 2), n)
    loops = np.zeros(n) if weights is None else weights
    at = community = np.arange(n)  # where each node of the graph lies in this level
    while True:
        src, dst, w = arcs
        degree = np.bincount(src, w, n) + 2 * loops
        moved, community = _move(arcs, degree, community, None, gamma, total, rng)
        if not moved or len(np.unique(community)) == n:
            return community[at]
        parts = _move(arcs, degree, np.arange(n), community.tolist(), gamma, total, rng)[1]
        number = np.unique(parts, return_inverse=True)[1]
        k = int(number.max()) + 1
        if k == n:
            return community[at]
        p, q = number[src], number[dst]
        inner = p == q
        loops = np.bincount(number, loops, k) + np.bincount(p[inner], w[inner] / 2, k)
        above = np.empty(k, dtype=np.int64)
        above[number] = community
        first, which = np.unique(above, return_index=True, return_inverse=True)[1:]
        community, at, n = first[which], number[at], k
        arcs = _merged(p[~inner], q[~inner], w[~inner], k)


def _linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one task: each node takes the smallest label beside it, and its label's label, until nothing changes."""
    batches = list(parts)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    ids = pc.unique(pa.chunked_array([*rows["source"].chunks, *rows["target"].chunks]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = (pc.index_in(rows[c], ids).to_numpy() for c in ("source", "target"))
    label = np.arange(len(ids))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        for end in (a, b):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)  # the label's own node comes along
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield from pa.table({"node_id": ids, "component": ids.take(pa.array(label))}).to_batches(max_chunksize=100_000)


def components(nodes: DataFrame, edges: DataFrame, task_edges: int = 2_000_000) -> DataFrame:
    """``node_id, component``: connected components by smallest id; up to ``task_edges`` edges in one task, more by joins."""
    from cairn.operators.graph import _spread

    ids = nodes.select("node_id").distinct()
    if edges.count() <= task_edges:
        found = edges.select("source", "target").coalesce(1).mapInArrow(_linked, "node_id string, component string")
        return ids.join(found, "node_id", "full").select("node_id", F.coalesce("component", "node_id").alias("component"))
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return _spread(ids.withColumn("label", F.col("node_id")), materialize(both, "arcs")).withColumnRenamed("label", "component")


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> float:
    """The modularity of ``labels`` (``node_id, community_id``) over the simple undirected graph of ``edges``; 0 without edges."""
    arcs = _arcs(edges)
    both = arcs.unionByName(arcs.select(F.col("target").alias("source"), F.col("source").alias("target"), "w"))
    return _modularity(both, labels.select("node_id", F.col("community_id").alias("label")), None, gamma)


def _arcs(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, without loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct().withColumn("w", F.lit(1.0))


def _modularity(both: DataFrame, labels: DataFrame, inside: DataFrame | None, gamma: float) -> float:
    """``both`` has every edge in both directions, ``inside`` (``node_id, loop``) the weight inside each node of an aggregated graph."""
    a, b = labels.select(F.col("node_id").alias("source"), F.col("label").alias("la")), labels.select(F.col("node_id").alias("target"), F.col("label").alias("lb"))
    ends = both.join(a, "source").join(b, "target").select(F.col("la").alias("label"), "w", F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0).alias("within"))
    if inside is not None:
        own = inside.where("loop > 0").join(labels, "node_id").select("label", (2 * F.col("loop")).alias("w"), (2 * F.col("loop")).alias("within"))
        ends = ends.unionByName(own)
    each = ends.groupBy("label").agg(F.sum("w").alias("k"), F.sum("within").alias("within"))
    got = each.agg(F.sum("k").alias("m2"), F.sum("within").alias("within"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return got.within / got.m2 - gamma * got.squares / got.m2**2 if got.m2 else 0.0


def _moved(both: DataFrame, nodes: DataFrame, gamma: float, total: float, seed: int) -> DataFrame:
    """``node_id, label`` after rounds of moves by joins, each of half of the nodes, until modularity hardly rises; the best round's labels.

    ``nodes`` has ``node_id, k`` (weight of all ends) and ``loop`` (weight inside).
    """
    labels = best = nodes.select("node_id", F.col("node_id").alias("label"))
    top, idle, turn = _modularity(both, labels, nodes, gamma), 0, 0
    while idle < 2:  # two rounds, so that both halves had their turn
        turn += 1
        mine = nodes.join(labels, "node_id").select("node_id", "k", F.col("label").alias("own"))
        sums = mine.groupBy(F.col("own").alias("label")).agg(F.sum("k").alias("sum"))
        near = both.join(labels.withColumnRenamed("node_id", "target"), "target").groupBy(F.col("source").alias("node_id"), "label").agg(F.sum("w").alias("w"))
        stay = mine.select("node_id", F.col("own").alias("label"), F.lit(0.0).alias("w"))
        to = near.unionByName(stay).groupBy("node_id", "label").agg(F.sum("w").alias("w")).join(sums, "label").join(mine, "node_id")
        rest = F.col("sum") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - gamma * F.col("k") * rest / (2 * total), 9)
        choice = to.groupBy("node_id").agg(
            F.min(F.struct((-gain).alias("loss"), "label")).alias("b"), F.max(F.when(F.col("label") == F.col("own"), gain)).alias("stays"), F.first("own").alias("own")
        )
        goes = (-F.col("b.loss") > F.col("stays")) & (F.pmod(F.xxhash64("node_id", F.lit(seed + turn // 2)), F.lit(2)) == turn % 2)
        new = materialize(choice.select("node_id", F.when(goes, F.col("b.label")).otherwise(F.col("own")).alias("label")), "moves")
        got = _modularity(both, new, nodes, gamma)
        if labels is not best:
            discard(labels)
        labels = new
        if got > top:
            idle = 0 if got > top + LEAST_RISE else idle + 1
            discard(best)
            top, best = got, new
        else:
            idle += 1
    return best


def _solve(gamma: float, seed: int, total: float):
    def solve(rows: pa.Table) -> pa.Table:
        """One component: rows with a ``target`` are edges, those without one tell what lies inside a node."""
        ids = pc.unique(rows["source"])
        ids = ids.take(pc.sort_indices(ids))
        a = pc.index_in(rows["source"], ids).to_numpy().astype(np.int64)
        b = pc.fill_null(pc.index_in(rows["target"], ids, skip_nulls=True), -1).to_numpy().astype(np.int64)
        w = rows["w"].to_numpy()
        edge = b >= 0
        inside = np.zeros(len(ids))
        inside[a[~edge]] = w[~edge]
        a, b, w = a[edge], b[edge], w[edge]
        order = np.lexsort((w, b, a))
        labels = _leiden(len(ids), (a[order], b[order], w[order]), gamma, seed, total, inside)
        first, which = np.unique(labels, return_index=True, return_inverse=True)[1:]
        return pa.table({"node_id": ids, "label": ids.take(pa.array(first[which]))})

    return solve


def communities(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, seed: int = 42, group_edges: int = 2_000_000) -> DataFrame:
    """``node_id, community_id``: a number per community; every node is in one, a node without edges alone in its own.

    Connected components never share a community, so each is solved by itself, all in parallel. A component of more than ``group_edges``
    edges goes through levels of moves by joins until what is left of it fits a task, or nothing moves any more. ``modularity`` tells how
    good a result is; gains are relative to the whole graph's weight.
    """
    arcs = materialize(_arcs(edges), "arcs")
    total = float(arcs.count()) or 1.0
    parts = materialize(components(nodes, arcs, group_edges), "components")
    both = materialize(arcs.unionByName(arcs.select(F.col("target").alias("source"), F.col("source").alias("target"), "w")), "both")
    inside = both.groupBy(F.col("source").alias("node_id")).agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0.0))
    names = parts.select("node_id", F.col("node_id").alias("at"))  # where each node of the graph lies now
    done: list[DataFrame] = []  # label of what a node lies in, per level
    while True:
        owned = both.join(parts.withColumnRenamed("node_id", "source"), "source")
        sizes = materialize(owned.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
        large = sizes.where(F.col("n") > 2 * group_edges).select("component")
        small = sizes.where(F.col("n") <= 2 * group_edges).select("component")
        rows = owned.join(small, "component").where("source < target").select("component", "source", "target", "w")
        loops = inside.join(parts, "node_id").join(small, "component").select("component", F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target"), F.col("loop").alias("w"))
        done.append(materialize(rows.unionByName(loops).groupBy("component").applyInArrow(_solve(gamma, seed, total), "node_id string, label string"), "solved"))
        if not large.take(1):
            break
        held = materialize(owned.join(large, "component").select("component", "source", "target", "w"), "large")
        nodes_in = materialize(inside.join(parts.join(large, "component"), "node_id"), "inside")
        labels = _moved(held.select("source", "target", "w"), nodes_in.select("node_id", "k", "loop"), gamma, total, seed)
        a, b = labels.select(F.col("node_id").alias("source"), F.col("label").alias("la")), labels.select(F.col("node_id").alias("target"), F.col("label").alias("lb"))
        met = held.join(a, "source").join(b, "target")
        within = materialize(met.where("la = lb").select("source", "target"), "within")
        apart = materialize(components(labels.select("node_id"), within, group_edges).withColumnRenamed("component", "label"), "parts")  # connected parts
        if apart.where("node_id <> label").take(1) == []:
            done.append(apart)  # nothing moves: each node is a community
            break
        step = apart.withColumnRenamed("node_id", "at").withColumnRenamed("label", "to")
        names = materialize(names.join(step, "at", "left").select("node_id", F.coalesce("to", "at").alias("at")), "names")
        a, b = apart.select(F.col("node_id").alias("source"), F.col("label").alias("la")), apart.select(F.col("node_id").alias("target"), F.col("label").alias("lb"))
        met = materialize(held.join(a, "source").join(b, "target").groupBy("la", "lb").agg(F.sum("w").alias("w")), "met")
        both = met.where("la <> lb").select(F.col("la").alias("source"), F.col("lb").alias("target"), "w")
        own = met.where("la = lb").select(F.col("la").alias("label"), (F.col("w") / 2).alias("new"))
        inside = nodes_in.join(apart, "node_id").groupBy("label").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        inside = materialize(inside.join(own, "label", "left").select(F.col("label").alias("node_id"), "k", (F.col("loop") + F.coalesce("new", F.lit(0.0))).alias("loop")), "inside")
        parts = materialize(nodes_in.join(apart, "node_id").select(F.col("label").alias("node_id"), "component").distinct(), "components")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.withColumnRenamed("node_id", "at")
    labelled = materialize(names.join(found, "at", "left").select("node_id", F.coalesce("label", "at").alias("label")), "labels")
    # numbers by rank of the label: ranges of labels are numbered by themselves, behind all labels of the ranges before
    ranged = labelled.select("label").distinct().repartitionByRange("label").sortWithinPartitions("label")
    ranged = materialize(ranged.select("label", F.monotonically_increasing_id().alias("m")), "ranks")
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    numbered = ranged.withColumn("part", part).join(starts, "part").select("label", (F.col("start") + place).alias("community_id"))
    return labelled.join(numbered, "label").select("node_id", F.col("community_id").cast("int").alias("community_id"))


def clustering_graph(graph: PropertyGraph, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``node_id`` of what is clustered, and its links ``source, target``: files and the imports and calls between them; without files symbols, without links."""
    kind = lambda t: graph.nodes.where(F.col("node_type") == t).select("node_id").distinct()
    files = kind("file")
    if not files.take(1):
        return kind("symbol"), graph.edges.select("source", "target").limit(0)
    paths = graph.nodes.where("node_type = 'file'").groupBy("file_path").agg(F.min("node_id").alias("id"))
    links = intelligence.file_links(graph, resolved)
    a, b = paths.select(F.col("file_path").alias("source"), F.col("id").alias("a")), paths.select(F.col("file_path").alias("target"), F.col("id").alias("b"))
    return files, links.join(a, "source").join(b, "target").select(F.col("a").alias("source"), F.col("b").alias("target"))


def annotate(graph: PropertyGraph, resolved: DataFrame | None = None, gamma: float = 1.0, seed: int = 42) -> PropertyGraph:
    """The graph with the ``community_id`` of each node, its own or its file's, and ``is_bridge``."""
    nodes, links = clustering_graph(graph, resolved)
    found = materialize(communities(nodes, links, gamma, seed), "communities")
    return intelligence.annotate(graph, found, intelligence.bridge_nodes(links, found))
