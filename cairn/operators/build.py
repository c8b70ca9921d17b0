"""Graphs from scan records and parse results, whole or incrementally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import schemas
from cairn.functions import paths
from cairn.operators import resolution
from cairn.operators.graph import PropertyGraph, last_wins


def file_node_id(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_node_id(path: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit(":"), name)


def classify(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, change``: ``added``, ``modified``, ``unchanged`` or ``deleted`` against earlier fingerprints, by ``sha256``.

    Of repeated paths the row with the greatest ``mtime`` holds. Null paths are left out.
    """
    one = lambda df: df.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "sha256")).alias("r")).select("path", F.col("r.sha256").alias("sha256"))
    a = one(scan).withColumn("here", F.lit(True))
    b = one(cache).select("path", F.col("sha256").alias("old"), F.lit(True).alias("there"))
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("sha256").eqNullSafe(F.col("old")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def updated_cache(scan: DataFrame) -> DataFrame:
    """The fingerprints to keep for the next scan."""
    return last_wins(scan.select("path", "sha256", "size", "mtime"), ["path"], "mtime")


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame, inheritance: DataFrame, calls: DataFrame, now: float = 0.0) -> PropertyGraph:
    """The graph of parsed files. ``files``: scan records with ``language`` and ``parse_errors`` where parsed; the others as parse rows."""
    seen = [F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit(0).cast("bigint").alias("churn")]
    file_nodes = schemas.nodes(files.select(file_node_id("path").alias("node_id"), F.lit("file").alias("node_type"), F.col("path").alias("file_path"), *[c for c in files.columns if c != "path"], *seen))
    symbol_rows = symbols.select(symbol_node_id("path", "qualified_name").alias("node_id"), F.lit("symbol").alias("node_type"), F.col("path").alias("file_path"), *[c for c in symbols.columns if c != "path"], *seen)
    symbol_nodes = schemas.nodes(last_wins(symbol_rows, ["node_id"], "start_line"))
    import_id = F.concat(F.lit("import:"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), "module")
    import_nodes = schemas.nodes(imports.select(import_id.alias("node_id"), F.lit("import").alias("node_type"), F.col("path").alias("file_path"), *[c for c in imports.columns if c != "path"], *seen).dropDuplicates(["node_id"]))
    contains = symbol_rows.select(file_node_id("file_path").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("edge_type"), F.col("start_line").alias("line"))
    import_edges = imports.select(file_node_id("path").alias("source"), import_id.alias("target"), F.lit("imports").alias("edge_type"), F.col("start_line").alias("line"))
    inherit_edges, base_nodes = resolution.resolve_bases(inheritance, symbol_nodes)
    call_edges, callee_nodes = resolution.resolve_calls(calls.withColumnRenamed("path", "file_path"), symbol_nodes)
    proxies = last_wins(base_nodes.unionByName(callee_nodes), ["node_id"]).select("*", *seen, F.lit(False).alias("is_broken"))
    nodes = file_nodes.unionByName(symbol_nodes).unionByName(import_nodes).unionByName(schemas.nodes(proxies))
    edges = contains.unionByName(import_edges).unionByName(inherit_edges).unionByName(call_edges)
    return PropertyGraph(nodes, schemas.edges(edges))


def provides_consumes(symbols: DataFrame, imports: DataFrame, inheritance: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file_path, fqn``: names each file provides, and names it consumes by import, inheritance or call."""
    provides = symbols.select(F.col("path").alias("file_path"), F.col("qualified_name").alias("fqn"))
    from_names = F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.transform("names", lambda n: F.concat_ws(".", "module", n))).otherwise(F.array("module"))
    consumes = imports.select(F.col("path").alias("file_path"), F.explode(from_names).alias("fqn"))
    consumes = consumes.unionByName(inheritance.select(F.col("path").alias("file_path"), F.col("base").alias("fqn"))).unionByName(calls.select(F.col("path").alias("file_path"), F.col("callee").alias("fqn")))
    return provides.where("fqn is not null").distinct(), consumes.where("fqn is not null").distinct()


def update(graph: PropertyGraph, changes: DataFrame, fresh: PropertyGraph, now: float) -> PropertyGraph:
    """The graph after the files of ``changes`` (``path, change``): what belongs to deleted and modified files goes, ``fresh`` (built of
    added and modified files) comes, modified files keep ``first_seen`` and count one more churn, unchanged ones get a new ``last_seen``."""
    gone = changes.where(F.col("change").isin("deleted", "modified", "added")).select(F.col("path").alias("file_path")).distinct()
    same = changes.where("change = 'unchanged'").select(F.col("path").alias("file_path"), F.lit(now).alias("_now")).distinct()
    old_files = graph.nodes.where("node_type = 'file'").select("node_id", F.col("first_seen").alias("_first"), (F.col("churn") + 1).alias("_churn"))
    kept = graph.nodes.join(gone, "file_path", "left_anti").join(same, "file_path", "left")
    kept = kept.withColumn("last_seen", F.when(F.col("node_type") == "file", F.coalesce("_now", "last_seen")).otherwise(F.col("last_seen"))).drop("_now")
    new = fresh.nodes.join(old_files, "node_id", "left").withColumn("first_seen", F.coalesce("_first", "first_seen")).withColumn("churn", F.coalesce("_churn", "churn")).drop("_first", "_churn")
    dropped = graph.nodes.join(gone, "file_path", "left_semi").select("node_id")
    edges = graph.remove_nodes(dropped).edges.unionByName(fresh.edges)
    return PropertyGraph(kept.select(*graph.nodes.columns).unionByName(new.select(*graph.nodes.columns)), edges)


def extension_counts(records: DataFrame) -> DataFrame:
    """``extension, n`` of tracked files, ``(no extension)`` for none; order by n descending, then extension."""
    e = paths.ending("path")
    return records.where("path is not null").select("path").distinct().groupBy(F.when(e == "", "(no extension)").otherwise(e).alias("extension")).agg(F.count(F.lit(1)).alias("n"))
