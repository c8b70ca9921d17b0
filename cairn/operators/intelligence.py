"""Architectural questions about a property graph, each answered by a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.graph import PropertyGraph, simple_cycles, strongly_connected_components

#: Fixed values.
ENTRY_SYMBOL_NAMES = ("main", "run", "cli", "app")
ENTRY_FILE_NAMES = ("__main__.py", "main.py", "app.py", "index.js", "index.ts", "index.tsx")


def is_entry_symbol() -> Column:
    return F.col("name").isin(*ENTRY_SYMBOL_NAMES) | F.coalesce("qualified_name", F.lit("")).endswith(".main")


def dead_code(graph: PropertyGraph, include_generated: bool = False, include_public_api: bool = False) -> DataFrame:
    """``node_id`` of functions and methods that neither call nor are called, without dunders, entry points and public methods."""
    nodes = graph.nodes.where((F.col("node_type") == "symbol") & F.col("kind").isin("function", "method"))
    nodes = nodes.where(~F.coalesce(paths.is_dunder("name"), F.lit(False)) & ~F.coalesce(is_entry_symbol(), F.lit(False)))
    if not include_generated:
        nodes = nodes.where(~paths.is_generated_or_vendor("file_path"))
    if not include_public_api:
        nodes = nodes.where(~paths.is_public_method("name", "qualified_name"))
    used = graph.edges.where("edge_type = 'calls'").select(F.explode(F.array("source", "target")).alias("node_id"))
    return nodes.select("node_id").join(used, "node_id", "left_anti")


def god_nodes(graph: PropertyGraph, include_generated: bool = False, stddevs: float = 1.0, dependents: DataFrame | None = None) -> DataFrame:
    """``node_id, score``: files and symbols whose degree is at least the mean plus ``stddevs`` standard deviations (of the population).

    ``dependents`` (``fqn, n``) adds the number of files that consume a symbol's name. A single node is returned as it is.
    """
    nodes = graph.nodes.where(F.col("node_type").isin("file", "symbol"))
    if not include_generated:
        nodes = nodes.where(~paths.is_generated_or_vendor("file_path"))
    scored = nodes.join(graph.degrees(), "node_id").withColumn("score", F.col("in_degree") + F.col("out_degree"))
    if dependents is not None:
        fqn = F.when(F.col("node_type") == "symbol", F.coalesce("qualified_name", "name"))
        scored = scored.withColumn("fqn", fqn).join(dependents.select("fqn", "n"), "fqn", "left").withColumn("score", F.col("score") + F.coalesce("n", F.lit(0)))
    scored = scored.select("node_id", F.col("score").cast("double").alias("score"))
    limit = scored.agg((F.avg("score") + stddevs * F.stddev_pop("score")).alias("least"))
    return scored.join(F.broadcast(limit), F.col("score") >= F.col("least")).select("node_id", "score")  # one row


def file_import_graph(graph: PropertyGraph, resolved: DataFrame | None = None) -> DataFrame:
    """``source, target`` paths: which file imports which. Edges that lead to import nodes are resolved by ``resolved``
    (``node_id, file_path``, see ``resolution``); edges that lead to files count as they are."""
    where = graph.nodes.where("file_path is not null").select("node_id", "node_type", "file_path")
    a = where.select(F.col("node_id").alias("source"), F.col("file_path").alias("from_path"))
    b = where.where("node_type = 'file'").select("node_id", "file_path")
    if resolved is not None:
        b = b.unionByName(resolved.select("node_id", "file_path"))
    b = b.select(F.col("node_id").alias("target"), F.col("file_path").alias("to_path"))
    imports = graph.edges.where("edge_type = 'imports'").select("source", "target").distinct()
    found = imports.join(a, "source").join(b, "target").where("from_path <> to_path")
    return found.select(F.col("from_path").alias("source"), F.col("to_path").alias("target")).distinct()


def file_links(graph: PropertyGraph, resolved: DataFrame | None = None) -> DataFrame:
    """``source, target`` paths: imports and calls between different files, each pair at most once per kind."""
    where = graph.nodes.where("file_path is not null").select("node_id", "file_path")
    calls = graph.edges.where("edge_type = 'calls'").select("source", "target")
    calls = calls.join(where.select(F.col("node_id").alias("source"), F.col("file_path").alias("a")), "source").join(where.select(F.col("node_id").alias("target"), F.col("file_path").alias("b")), "target")
    return file_import_graph(graph, resolved).unionByName(calls.where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")))


def file_dependency_graph(graph: PropertyGraph, resolved: DataFrame | None = None) -> DataFrame:
    """``source, target`` paths, smaller first: imports and calls between different files, without direction."""
    return file_links(graph, resolved).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def entry_points(graph: PropertyGraph, resolved: DataFrame | None = None) -> DataFrame:
    """``node_id`` of files nothing imports or with an entry file's name, and of entry symbols."""
    imported = file_import_graph(graph, resolved).select(F.col("target").alias("file_path")).distinct().withColumn("imported", F.lit(True))
    files = graph.nodes.where("node_type = 'file'").join(imported, "file_path", "left")
    by_name = paths.file_name("file_path").isin(*ENTRY_FILE_NAMES)
    files = files.where(F.col("imported").isNull() | by_name).select("node_id")
    return files.unionByName(graph.nodes.where((F.col("node_type") == "symbol") & is_entry_symbol()).select("node_id")).distinct()


def orphan_modules(graph: PropertyGraph, resolved: DataFrame | None = None) -> DataFrame:
    """``file_path`` of files that neither import, call nor are imported or called; empty if there is but one file."""
    linked = file_dependency_graph(graph, resolved).select(F.explode(F.array("source", "target")).alias("file_path"))
    files = graph.nodes.where("node_type = 'file'").select("file_path").distinct()
    many = files.agg((F.count(F.lit(1)) > 1).alias("many"))
    return files.join(linked, "file_path", "left_anti").join(F.broadcast(many), F.col("many")).select("file_path")  # one row


def circular_dependencies(arcs: DataFrame, max_length: int | None = None) -> DataFrame:
    """``path, length`` of the simple cycles of a graph ``source, target`` (files, say), of any length unless ``max_length`` bounds it."""
    ends = arcs.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return simple_cycles(arcs, strongly_connected_components(ends, arcs), max_length)


def complexity_rankings(graph: PropertyGraph, include_generated: bool = False) -> DataFrame:
    """``node_id, complexity`` of symbols, to be ordered by complexity descending, then id."""
    nodes = graph.nodes.where("node_type = 'symbol' and complexity is not null")
    if not include_generated:
        nodes = nodes.where(~paths.is_generated_or_vendor("file_path"))
    return nodes.select("node_id", "complexity")


def churn_rankings(graph: PropertyGraph) -> DataFrame:
    """``node_id, churn`` of files and symbols that changed, to be ordered by churn descending, then id."""
    return graph.nodes.where(F.col("node_type").isin("file", "symbol") & (F.col("churn") > 0)).select("node_id", "churn")


def analyze(graph: PropertyGraph, resolved: DataFrame | None = None) -> dict[str, DataFrame]:
    """All analyses with their defaults."""
    return {
        "dead_code": dead_code(graph), "circular_dependencies": circular_dependencies(file_import_graph(graph, resolved)), "god_nodes": god_nodes(graph),
        "entry_points": entry_points(graph, resolved), "orphan_modules": orphan_modules(graph, resolved),
        "complexity": complexity_rankings(graph), "churn": churn_rankings(graph),
    }


def bridge_nodes(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``node_id`` of nodes with a successor in another community (``communities``: ``node_id, community_id``)."""
    a = communities.select(F.col("node_id").alias("source"), F.col("community_id").alias("ca"))
    b = communities.select(F.col("node_id").alias("target"), F.col("community_id").alias("cb"))
    return edges.join(a, "source").join(b, "target").where("ca <> cb").select(F.col("source").alias("node_id")).distinct()


def annotate(graph: PropertyGraph, communities: DataFrame, bridges: DataFrame) -> PropertyGraph:
    """Nodes with ``community_id`` (their own, else their file's) and ``is_bridge``."""
    own = communities.select("node_id", F.col("community_id").alias("_own"))
    files = graph.nodes.where("node_type = 'file'").join(communities, "node_id").select("file_path", communities["community_id"].alias("_files"))
    files = files.groupBy("file_path").agg(F.min("_files").alias("_files"))
    kept = graph.nodes.drop("community_id", "is_bridge")
    nodes = kept.join(own, "node_id", "left").join(files, "file_path", "left").join(bridges.select("node_id", F.lit(True).alias("_b")), "node_id", "left")
    return PropertyGraph(nodes.withColumn("community_id", F.coalesce("_own", "_files")).withColumn("is_bridge", F.coalesce("_b", F.lit(False))).drop("_own", "_files", "_b"), graph.edges)
