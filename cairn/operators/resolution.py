"""Names to files and symbols: module index, import resolution, call and base resolution, and the registry of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.graph import PropertyGraph


def module_index(files: DataFrame) -> DataFrame:
    """``key, file_path``: names a file can be imported by (stem, path, path without ending, dotted path, last part). Where
    files share a key the greatest path holds. Null, empty paths and empty keys are left out."""
    known = files.where("file_path is not null and file_path <> ''").select("file_path").distinct()
    bare = paths.without_ending("file_path")
    keys = F.array(paths.stem("file_path"), bare, paths.slashes("file_path"), F.replace(bare, F.lit("/"), F.lit(".")), F.substring_index(bare, "/", -1))
    return known.select(F.explode(keys).alias("key"), "file_path").where("key <> ''").groupBy("key").agg(F.max("file_path").alias("file_path"))


def import_candidates(module: str, source_path: str):
    """Keys to try for a module, in order, as an array column: each candidate and then its stem.

    A relative module is looked up from the importing file's directory, one directory up for each dot after the first.
    """
    m = paths.slashes(F.trim(F.col(module)))
    dotted = F.replace(m, F.lit("."), F.lit("/"))
    dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
    base = F.when(paths.parent(source_path) == ".", F.lit("")).otherwise(paths.parent(source_path))
    steps = F.split(base, "/")
    up = F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - (dots - 1), F.lit(0))), "/")
    rest = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.regexp_replace(F.concat_ws("/", up, rest), r"^/+|/+$", "")
    strip = lambda c: F.regexp_replace(c, r"^/+|/+$", "")
    whole = F.when(dots > 0, F.array(relative, F.concat(relative, F.lit(".py")))).otherwise(F.array(strip(m), strip(dotted), F.concat(strip(dotted), F.lit(".py"))))
    return F.flatten(F.transform(whole, lambda c: F.array(c, F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", ""))))


def resolve_modules(imports: DataFrame, index: DataFrame) -> DataFrame:
    """``node_id, file_path``: the file each import node's ``module`` means, seen from its ``file_path``; unknown ones have no row."""
    tried = imports.where("module is not null and trim(module) <> ''").select("node_id", F.posexplode(import_candidates("module", "file_path")).alias("rank", "key"))
    hits = tried.where("key <> ''").join(index, "key")
    return hits.groupBy("node_id").agg(F.min_by("file_path", "rank").alias("file_path"))


def symbol_keys(symbols: DataFrame) -> DataFrame:
    """``file_path, key, rank, seq, node_id``: what a symbol answers to inside its file: its qualified name (rank 0), its name and
    every dotted tail of the qualified name (rank 1). An equi-join on it replaces the search for a suffix."""
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = F.array_distinct(F.concat(tails, F.array("name")))
    seq = F.col("seq") if "seq" in symbols.columns else F.lit(0).cast("bigint")
    each = symbols.where("node_type = 'symbol'").select("file_path", "qualified_name", "node_id", seq.alias("seq"), F.explode(keys).alias("key"))
    return each.where("key is not null").select("file_path", "key", F.when(F.col("key") == F.col("qualified_name"), 0).otherwise(1).alias("rank"), "seq", "node_id")


def resolve_local(names: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """``names`` with ``node_id`` of the symbol ``name`` means inside ``file_path`` (null if none): an exact qualified name first,
    then the first symbol by ``seq`` and id."""
    best = symbol_keys(symbols).groupBy("file_path", "key").agg(F.min(F.struct("rank", "seq", "node_id")).alias("_b"))
    best = best.select("file_path", F.col("key").alias(name), F.col("_b.node_id").alias("node_id"))
    return names.join(best, ["file_path", name], "left")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``calls`` edges and proxy nodes of ``file_path, caller, callee, line``. A callee that is not in the file becomes a proxy node,
    even if the caller is unknown; only a known caller gets an edge."""
    a = resolve_local(calls, symbols, "caller").withColumnRenamed("node_id", "source")
    both = resolve_local(a, symbols, "callee").withColumnRenamed("node_id", "found")
    proxy = F.concat(F.lit("proxy:"), "file_path", F.lit(":"), "callee")
    edges = both.where("source is not null").select("source", F.coalesce("found", proxy).alias("target"), F.lit("calls").alias("edge_type"), "line")
    proxies = both.where("found is null").select(proxy.alias("node_id"), F.lit("proxy").alias("node_type"), "file_path", F.col("callee").alias("name")).distinct()
    return edges, proxies


def resolve_bases(inheritance: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inherits`` edges and proxy nodes of ``path, class_name, base, line``: every symbol of the file with the class's name inherits."""
    rows = inheritance.where("base is not null").withColumnRenamed("path", "file_path")
    proxy = F.concat(F.lit("proxy:"), "file_path", F.lit(":"), "base")
    named = symbols.where("node_type = 'symbol'").select("file_path", F.col("name").alias("class_name"), F.col("node_id").alias("source"))
    edges = rows.join(named, ["file_path", "class_name"]).select("source", proxy.alias("target"), F.lit("inherits").alias("edge_type"), "line")
    return edges, rows.select(proxy.alias("node_id"), F.lit("proxy").alias("node_type"), "file_path", F.col("base").alias("name")).distinct()


def providers(provides: DataFrame) -> DataFrame:
    """``fqn, file_path``: the one owner of each name; of several files the greatest path."""
    return provides.groupBy("fqn").agg(F.max("file_path").alias("file_path"))


def dependents(consumes: DataFrame) -> DataFrame:
    """``fqn, n``: how many files consume each name."""
    return consumes.groupBy("fqn").agg(F.count_distinct("file_path").alias("n"))


def update_registry(old: DataFrame, new: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A ``provides`` or ``consumes`` table after the files of ``touched`` (``file_path``) were read again, and the names nobody provides any more."""
    kept = old.join(touched.select("file_path").distinct(), "file_path", "left_anti").select("file_path", "fqn")
    after = kept.unionByName(new.select("file_path", "fqn")).distinct()
    return after, old.select("fqn").distinct().join(after.select("fqn").distinct(), "fqn", "left_anti")


def broken_proxies(removed: DataFrame, consumes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id`` of proxy nodes for names that vanished, in the files that consume them."""
    ids = removed.select("fqn").distinct().join(consumes, "fqn").select(F.concat(F.lit("proxy:"), "file_path", F.lit(":"), "fqn").alias("node_id")).distinct()
    return nodes.where("node_type = 'proxy'").select("node_id").join(ids, "node_id", "left_semi")


def flag_broken(graph: PropertyGraph, removed: DataFrame, consumes: DataFrame) -> PropertyGraph:
    """The graph with ``is_broken`` set on the proxies of names that vanished."""
    broken = broken_proxies(removed, consumes, graph.nodes).withColumn("_broken", F.lit(True))
    old = F.col("is_broken") if "is_broken" in graph.nodes.columns else F.lit(None).cast("boolean")
    nodes = graph.nodes.join(broken, "node_id", "left").withColumn("is_broken", F.coalesce("_broken", old)).drop("_broken")
    return PropertyGraph(nodes, graph.edges)


def registry_import_graph(provides: DataFrame, consumes: DataFrame) -> DataFrame:
    """``source, target``: consumer file to the file that provides the name."""
    owner = providers(provides).withColumnRenamed("file_path", "target")
    found = consumes.select("fqn", F.col("file_path").alias("source")).join(owner, "fqn")
    return found.where("source <> target").select("source", "target").distinct()
