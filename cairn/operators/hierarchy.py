"""Parent-child links to full hierarchies: path, depth, root, ancestors, descendants, cycles.

Each level of the recursion deals the nodes to partitions, follows the parent chains inside a partition
until they leave it, and keeps of every chain only its exit. The exits alone form the next, smaller
forest; when it fits one partition it is solved there, and the levels are expanded backwards by joins.
An edge carries the nodes that were contracted away, so no level is needed to rebuild a path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

_EDGE = "node string, parent string, via array<string>, in_cycle boolean"


def bare_name(c: Column) -> Column:
    """A class name as written in source: trimmed, without type arguments and module prefixes; blank is null."""
    cut = F.regexp_replace(c, r"[\[<(].*$", "")
    last = F.element_at(F.split(F.regexp_replace(cut, r"[\s\p{Z}]+", ""), r"\.|::"), -1)
    return F.when(last != "", last)


def parent_links(rows: DataFrame, child: str = "class_name", parent: str = "base") -> DataFrame:
    """``node, parent`` with one row per node of ``rows``; a node whose rows name no parent has a null one.

    Repeated rows and other spellings collapse. Where rows contradict each other the smallest parent
    holds. Null and blank children are no nodes. Parents that are declared nowhere become roots.
    """
    links = rows.select(bare_name(F.col(child)).alias("node"), bare_name(F.col(parent)).alias("parent"))
    named = links.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    undeclared = (
        named.where("parent is not null").select(F.col("parent").alias("node")).distinct()
        .join(named.select("node"), "node", "left_anti").select("node", F.lit(None).cast("string").alias("parent"))
    )
    return named.unionByName(undeclared)


#: Names in the lists that a task holds before it passes them on.
HELD_NAMES = 500_000


class _Fragment:
    """The rows of one partition: links, and rings that lie here as a whole. Lists are only made when a row is passed on."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.up = {n: (p, list(v)) for n, p, v in zip(rows["node"], rows["parent"], rows["via"])}
        #: Of a node on a ring: the ring in the order of its links, each node's place in it, and this node's place.
        self.ring: dict[str, tuple[list[str], dict[str, int], int]] = {}
        for n, c in zip(rows["node"], rows["in_cycle"]):
            if c:
                self._close(self.up[n][1], [n])
        self._find_rings()

    def _close(self, full: list[str], members: list[str]) -> None:
        at = {m: i for i, m in enumerate(full)}
        for m in members:
            self.ring[m] = full, at, at[m]

    def _find_rings(self) -> None:
        up, seen = self.up, set()
        for start in up:
            trail: list[str] = []
            at: dict[str, int] = {}
            n = start
            while n in up and n not in seen and n not in at and n not in self.ring and up[n][0] is not None:
                at[n] = len(trail)
                trail.append(n)
                n = up[n][0]
            if n in at:
                members, trail = trail[at[n] :], trail[: at[n]]
                self._close([x for m in members for x in (m, *up[m][1])], members)
                seen.update(members)
            while trail:
                m = trail.pop()
                seen.add(m)
                held = self.ring.get(up[m][0])
                if held and m in held[1]:  # on the ring, though an edge that was contracted passes over it
                    self.ring[m] = held[0], held[1], held[1][m]

    def _round(self, n: str) -> list[str]:
        """Once round the ring from the node after ``n`` to ``n``."""
        full, _, i = self.ring[n]
        return full[i + 1 :] + full[: i + 1]

    def row(self, n: str) -> tuple[str, str | None, list[str], bool]:
        """``node, parent, via, in_cycle``: the way to the first node another partition holds, or to the end."""
        if n in self.ring:
            return n, None, self._round(n), True
        out: list[str] = []
        at = n
        while True:
            parent, via = self.up[at]
            out += via
            if parent not in self.up:
                return n, parent, out, False
            out.append(parent)
            if parent in self.ring:  # what was contracted on the way may lie on the ring too
                passed = set(via)
                return n, None, out + [a for a in self._round(parent)[:-1] if a not in passed], False
            at = parent


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the chains inside one partition to the first node another partition holds, or to their end.

    A row without ``parent`` is finished: its ``via`` holds all nodes above it.
    """
    frames = list(parts)
    if not frames:
        return
    fragment = _Fragment(pd.concat(frames, ignore_index=True))
    columns, out, held = ["node", "parent", "via", "in_cycle"], [], 0
    for n in fragment.up:
        out.append(fragment.row(n))
        held += len(out[-1][2]) + 1
        if held >= HELD_NAMES:
            yield pd.DataFrame(out, columns=columns)
            out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def _fragments(edges: DataFrame, parts: int, level: int, partition_rows: int) -> DataFrame:
    """Deal the nodes to partitions so that about a quarter of the edges become local, whatever the shape.

    A coin is tossed for every name. Tails join the partition of a parent that shows heads, others stay with
    their own name. Children of a parent that has very many are left where they are, so that no partition
    gets a third of the rows; there are at most ``16 * parts`` such parents, which bounds the broadcast.
    """
    if parts == 1:
        return edges.coalesce(1).mapInPandas(_contract, _EDGE)
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 1
    crowd = max(2, partition_rows // 16)
    hot = edges.where("parent is not null").groupBy("parent").count().where(F.col("count") > crowd).select("parent", F.lit(True).alias("hot"))
    joins = F.col("hot").isNull() & heads(F.col("parent")) & ~heads(F.col("node"))
    dealt = edges.join(F.broadcast(hot), "parent", "left").withColumn("key", F.when(joins, F.col("parent")).otherwise(F.col("node")))
    return dealt.repartition(parts, "key").select("node", "parent", "via", "in_cycle").mapInPandas(_contract, _EDGE)


def resolve_forest(links: DataFrame, partition_rows: int = 200_000) -> DataFrame:
    """``node, above, in_cycle``: the nodes over each node, nearest first, up to its root.

    ``links`` has ``node`` (unique) and ``parent`` (null for roots, else some ``node``). For a node on a cycle
    ``above`` goes once round and ends with the node itself; below a cycle it ends with the cycle's last member.
    ``partition_rows`` bounds what one task holds; it decides on the depth of the recursion, not on the result.
    """
    edges = materialize(links.select("node", "parent", F.array().cast("array<string>").alias("via"), F.lit(False).alias("in_cycle")), "forest")
    levels: list[DataFrame] = []
    while True:
        parts = max(1, -(-edges.count() // partition_rows))
        cut = materialize(_fragments(edges, parts, len(levels) + 1, partition_rows), "forest")
        levels.append(cut)
        if parts == 1 or not cut.where("parent is not null").take(1):
            break
        targets = cut.where("parent is not null").select(F.col("parent").alias("node")).distinct()
        edges = materialize(cut.join(targets, "node", "left_semi").select(*cut.columns), "forest")
    solved = levels.pop().select("node", F.col("via").alias("above"), "in_cycle")
    while levels:
        cut = levels.pop()
        over = solved.select(F.col("node").alias("parent"), F.col("above").alias("rest"), F.col("in_cycle").alias("ring"))
        joined = cut.where("parent is not null").join(over, "parent").drop("in_cycle")
        at = F.array_position("rest", F.col("node")).cast("int")
        on_ring = F.col("ring") & (at > 0)
        turned = F.concat(F.slice("rest", at + 1, F.size("rest")), F.slice("rest", F.lit(1), at))
        # a cycle's member ends its own list; below the cycle it must not be named twice
        round_ = F.array_except(F.slice("rest", F.lit(1), F.size("rest") - 1), F.col("via"))
        rest = F.when(F.col("ring"), round_).otherwise(F.col("rest"))
        above = F.when(on_ring, turned).otherwise(F.concat("via", F.array("parent"), rest))
        here = cut.where("parent is null").select("node", F.col("via").alias("above"), "in_cycle")
        solved = materialize(here.unionByName(joined.select("node", above.alias("above"), on_ring.alias("in_cycle"))), "forest")
    return solved


def hierarchy(links: DataFrame, partition_rows: int = 200_000) -> DataFrame:
    """``node, path, depth, root, in_cycle, below_cycle`` for every node of ``links`` (see ``parent_links``).

    ``path`` runs from the root to the node. On and below a cycle there is no root: ``root`` and ``depth`` are
    null and ``path`` lists what the node reaches, farthest first, then the node. An empty table has no rows.
    """
    all_ = resolve_forest(links, partition_rows)
    rings = all_.where("in_cycle").select(F.col("node").alias("_last")).distinct()
    top = F.when(F.size("above") > 0, F.element_at("above", F.size("above")))
    rows = all_.withColumn("_last", top).join(rings.withColumn("_ring", F.lit(True)), "_last", "left")
    cyclic = F.coalesce(F.col("_ring"), F.lit(False))
    path = F.when(F.col("in_cycle"), F.reverse(F.col("above"))).otherwise(F.concat(F.reverse("above"), F.array("node")))
    return rows.select(
        "node", path.alias("path"),
        F.when(~cyclic, F.size("above")).alias("depth"),
        F.when(~cyclic, F.coalesce("_last", "node")).alias("root"),
        "in_cycle", (cyclic & ~F.col("in_cycle")).alias("below_cycle"),
    )


def ancestor_pairs(links: DataFrame, partition_rows: int = 200_000) -> DataFrame:
    """``node, ancestor``: every node with each node it reaches, a cycle's members with themselves too."""
    return resolve_forest(links, partition_rows).select("node", F.explode("above").alias("ancestor"))


def related_pairs(links: DataFrame, partition_rows: int = 200_000) -> DataFrame:
    """``class_a, class_b``: unordered pairs of which one reaches the other, each once, smaller name first."""
    rows = resolve_forest(links, partition_rows)
    pairs = rows.select("node", "in_cycle", F.explode("above").alias("other"))
    # two members of one cycle reach each other: their pair is taken from the smaller member's row
    from_ring = F.col("in_cycle") & (F.col("other") < F.col("node"))
    return pairs.where(~from_ring).select(F.least("node", "other").alias("class_a"), F.greatest("node", "other").alias("class_b"))
