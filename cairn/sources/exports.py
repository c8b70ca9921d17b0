"""Exports of a graph: JSON, GraphML, Cypher, Markdown and a note vault, as text lines that Spark writes or one small file."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import intelligence, queries, timeline, views
from cairn.operators.graph import PropertyGraph
from cairn.session import materialize

#: Colours of communities, and what a note says of an empty list.
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")
NO_SYMBOLS, NO_IMPORTS, NO_CALLERS = "_No symbols parsed._", "_No imports detected._", "_No cross-file callers detected._"
RANKED = 25


def _literal(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind in ("int", "bigint", "double", "boolean", "smallint", "float"):
        return c.cast("string")
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _properties(df: DataFrame, names: dict[str, str]) -> Column:
    """``{a: 1, b: 'x'}`` of the columns that are not null, by sorted property name."""
    kinds = dict(df.dtypes)
    each = [F.concat(F.lit(f"{shown}: "), _literal(c, kinds[c])) for shown, c in sorted((s, c) for c, s in names.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *each), F.lit("}"))


def cypher_nodes(graph: PropertyGraph) -> DataFrame:
    """``node_id, statement``."""
    n = graph.nodes
    label = F.replace(F.initcap(F.replace(F.coalesce("node_type", F.lit("Node")), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    props = _properties(n, {c: ("id" if c == "node_id" else c) for c in n.columns})
    return n.select("node_id", F.concat(F.lit("CREATE (:"), label, F.lit(" "), props, F.lit(");")).alias("statement"))


def cypher_edges(graph: PropertyGraph) -> DataFrame:
    """``source, target, edge_type, statement``."""
    e = graph.edges
    props = _properties(e, {c: c for c in e.columns if c not in ("source", "target", "seq")})
    text = F.concat(
        F.lit("MATCH (a {id: "), _literal("source", "string"), F.lit("}), (b {id: "), _literal("target", "string"), F.lit("}) CREATE (a)-[:"),
        F.upper(F.coalesce("edge_type", F.lit("RELATED"))), F.lit(" "), props, F.lit("]->(b);"),
    )
    return e.select("source", "target", "edge_type", text.alias("statement"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_nodes(graph: PropertyGraph) -> DataFrame:
    """``node_id, element``: attributes that are lists or objects are written as JSON."""
    data = [F.concat(F.lit(f'<data key="{c}">'), _xml(F.to_json(c) if k.startswith(("array", "struct", "map")) else F.col(c).cast("string")), F.lit("</data>")) for c, k in sorted(graph.nodes.dtypes) if c != "node_id"]
    return graph.nodes.select("node_id", F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('">'), F.concat_ws("", *data), F.lit("</node>")).alias("element"))


def graphml_edges(graph: PropertyGraph) -> DataFrame:
    """``source, target, element``; parallel edges collapse."""
    one = graph.edges.groupBy("source", "target").agg(F.max("edge_type").alias("edge_type"))
    text = F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"><data key="edge_type">'), _xml(F.coalesce("edge_type", F.lit(""))), F.lit("</data></edge>"))
    return one.select("source", "target", text.alias("element"))


def vis_nodes(graph: PropertyGraph) -> DataFrame:
    """``id, label, title, color`` for a network viewer."""
    community = F.col("community_id") if "community_id" in graph.nodes.columns else F.lit(None).cast("int")
    n = graph.nodes if "module" in graph.nodes.columns else graph.nodes.withColumn("module", F.lit(None).cast("string"))
    palette = F.array(*map(F.lit, PALETTE))
    color = F.when(community.isNull(), "#888888").otherwise(F.element_at(palette, (F.pmod(community, F.lit(len(PALETTE))) + 1).cast("int")))
    return n.select(F.col("node_id").alias("id"), views.node_label(F.col("module")).alias("label"), F.col("node_id").alias("title"), color.alias("color"))


def vis_edges(graph: PropertyGraph) -> DataFrame:
    return graph.edges.select(F.col("source").alias("from"), F.col("target").alias("to"), F.coalesce("edge_type", F.lit("")).alias("label"), F.lit("to").alias("arrows"))


def note_name(c: Column) -> Column:
    """A name fit for a file: separators and blanks become dashes, at most 120 characters."""
    clean = F.substring(F.replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "-"), F.lit(" "), F.lit("-")), 1, 120)
    return F.when(clean == "", "note").otherwise(clean)


def file_notes(graph: PropertyGraph) -> DataFrame:
    """``name, body``: a note per file with its symbols, imports and incoming calls. Lists are bounded by one file's content."""
    n = graph.nodes
    module = F.col("module") if "module" in n.columns else F.lit(None).cast("string")
    files = n.where("node_type = 'file'").select("node_id", "file_path", "language", "churn")
    label = F.coalesce("qualified_name", "name")
    to = n.select(F.col("node_id").alias("target"), F.col("node_type").alias("t"), label.alias("label"), module.alias("module"))
    out = graph.edges.join(to, "target").where("(edge_type = 'contains' and t = 'symbol') or (edge_type = 'imports' and module is not null)")
    link = F.concat(F.lit("- [[Symbols/"), note_name(F.col("label")), F.lit("|"), F.col("label"), F.lit("]]"))
    parts = out.groupBy(F.col("source").alias("node_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("edge_type") == "contains", link))).alias("symbols"),
        F.array_sort(F.collect_set(F.when(F.col("edge_type") == "imports", F.concat(F.lit("- `"), F.col("module"), F.lit("`"))))).alias("imports"),
    )
    callers = n.where("node_type = 'symbol'").select(F.col("node_id").alias("source"), label.alias("label"))
    into = graph.edges.where("edge_type = 'calls'").select("source", F.col("target").alias("node_id")).join(files.select("node_id"), "node_id", "left_semi")
    calls = into.join(callers, "source").groupBy("node_id").agg(F.array_sort(F.collect_set(link)).alias("calls"))
    section = lambda c, none: F.concat_ws("\n", F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(F.lit(none))))
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "file_path"), F.lit(""), F.concat(F.lit("- language: `"), F.coalesce("language", F.lit("unknown")), F.lit("`")),
        F.concat(F.lit("- churn: "), F.coalesce("churn", F.lit(0)).cast("string")), F.lit("\n## Symbols\n"), section("symbols", NO_SYMBOLS),
        F.lit("\n## Imports\n"), section("imports", NO_IMPORTS), F.lit("\n## Incoming calls\n"), section("calls", NO_CALLERS), F.lit(""),
    )
    return files.join(parts, "node_id", "left").join(calls, "node_id", "left").select(note_name(F.col("file_path")).alias("name"), body.alias("body"))


def symbol_notes(graph: PropertyGraph) -> DataFrame:
    """``name, body``: a note per symbol name with the kind, file, line and complexity of each symbol that has it."""
    n = graph.nodes.where("node_type = 'symbol'")
    get = lambda c, kind="string": (F.col(c) if c in n.columns else F.lit(None)).cast(kind)
    label = F.coalesce("qualified_name", "name")
    line = F.concat(F.lit("- "), F.coalesce(get("kind"), F.lit("symbol")), F.lit(" in [[Files/"), note_name(F.col("file_path")), F.lit("|"), F.col("file_path"), F.lit("]]"))
    line = F.concat(line, F.coalesce(F.concat(F.lit(", line "), get("start_line")), F.lit("")), F.coalesce(F.concat(F.lit(", complexity "), get("complexity")), F.lit("")))
    one = n.where(label.isNotNull()).groupBy(note_name(label).alias("name")).agg(F.min(label).alias("title"), F.array_sort(F.collect_set(line)).alias("lines"))
    return one.select("name", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("body"))


def report(graph: PropertyGraph) -> dict:
    """The analyses of a graph, rankings cut to the first ones."""
    top = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(RANKED).collect()]
    return {
        "god_nodes": top(intelligence.god_nodes(graph), F.desc("score"), "node_id"), "complexity": top(intelligence.complexity_rankings(graph), F.desc("complexity"), "node_id"),
        "churn": top(intelligence.churn_rankings(graph), F.desc("churn"), "node_id"), "dead_code": top(intelligence.dead_code(graph), "node_id"),
        "entry_points": top(intelligence.entry_points(graph), "node_id"), "orphan_modules": top(intelligence.orphan_modules(graph), "file_path"),
        "circular_dependencies": top(intelligence.circular_dependencies(intelligence.file_import_graph(graph)), "length", "path"),
    }


def _write(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".part", path)
    return path


def export_json(graph: PropertyGraph, path: str) -> str:
    """The graph document in one file, for graphs a single reader can take; larger ones: ``graph.node_link().write``."""
    stats = queries.statistics(graph).first().asDict()
    each = lambda df: [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.toLocalIterator()]
    doc = {"metadata": {"statistics": stats}, "nodes": each(graph.nodes.withColumnRenamed("node_id", "id")), "edges": each(graph.edges), "intelligence": report(graph)}
    return _write(path, json.dumps(doc, sort_keys=True, indent=2, default=str))


def export_cypher(graph: PropertyGraph, path: str) -> str:
    """A folder of statement files: nodes first, then edges."""
    cypher_nodes(graph).select("statement").write.mode("overwrite").text(os.path.join(path, "nodes"))
    cypher_edges(graph).select("statement").write.mode("overwrite").text(os.path.join(path, "edges"))
    return path


def export_graphml(graph: PropertyGraph, path: str) -> str:
    """One document, its elements read range by range; for graphs beyond one reader write ``graphml_nodes`` and ``graphml_edges`` as text."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for c in sorted(graph.nodes.columns):
            if c != "node_id":
                f.write(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>\n')
        f.write('<key id="edge_type" for="edge" attr.name="edge_type" attr.type="string"/>\n<graph edgedefault="directed">\n')
        for part in (graphml_nodes(graph), graphml_edges(graph)):
            for r in part.select("element").toLocalIterator(prefetchPartitions=True):
                f.write(r.element + "\n")
        f.write("</graph>\n</graphml>\n")
    os.replace(path + ".part", path)
    return path


def export_markdown(graph: PropertyGraph, path: str) -> str:
    stats, found = queries.statistics(graph).first().asDict(), report(graph)
    lines = ["# Graph report", "", *[f"- {k}: {v}" for k, v in stats.items()]]
    for title, rows in found.items():
        lines += ["", f"## {title.replace('_', ' ').capitalize()}", "", *([f"- {', '.join(str(v) for v in r.values())}" for r in rows] or ["_None._"])]
    return _write(path, "\n".join(lines) + "\n")


def export_obsidian(graph: PropertyGraph, path: str) -> str:
    """A vault of file and symbol notes and an index. ``path`` is a folder that all executors share; tasks write the notes."""
    def write(parts):
        for part in parts:
            for folder, name, body in zip(part["folder"], part["name"], part["body"]):
                _write(os.path.join(path, folder, f"{name}.md"), body)
            yield part[["folder", "name"]]

    notes = file_notes(graph).withColumn("folder", F.lit("Files")).unionByName(symbol_notes(graph).withColumn("folder", F.lit("Symbols")))
    written = materialize(notes.mapInPandas(write, "folder string, name string"), "notes")
    index = os.path.join(path, "Index.md")
    os.makedirs(path, exist_ok=True)
    with open(index, "w", encoding="utf-8") as f:
        f.write("# Index\n\n")
        for r in written.where("folder = 'Files'").orderBy("name").toLocalIterator():
            f.write(f"- [[Files/{r.name}]]\n")
    return index


def dumps(store: timeline.Timeline, what: str, **options) -> Iterator[str]:
    """JSON lines of a timeline: ``timeline`` (snapshots), ``changes`` (``snapshot_from, snapshot_to``: nodes, then edges) or ``churn`` (rates of all nodes)."""
    if what == "timeline":
        tables = [store.rows("snapshots").orderBy("snapshot_id")]
    elif what == "changes":
        nodes, edges = store.delta(options["snapshot_from"], options["snapshot_to"])
        tables = [nodes.orderBy("kind", "node_id"), edges.orderBy("kind", "source", "target")]
    elif what == "churn":
        tables = [timeline.churn_rates(store.rows("nodes"), store.rows("snapshots"), **options).orderBy(F.desc("rate"), "node_id")]
    else:
        raise ValueError(f"unknown dump {what}")
    for t in tables:
        for r in t.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator():
            yield r.json


FORMATS: dict[str, tuple[str, Callable[[PropertyGraph, str], str]]] = {
    "json": ("graph.json", export_json), "graphml": ("graph.graphml", export_graphml), "cypher": ("cypher", export_cypher), "markdown": ("report.md", export_markdown), "obsidian": ("vault", export_obsidian),
}


def export_all(graph: PropertyGraph, folder: str, formats: list[str]) -> dict[str, str]:
    """Exports by format name, whatever its case; ValueError names the unknown ones."""
    wanted = [f.lower() for f in formats]
    unknown = sorted(set(wanted) - set(FORMATS))
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(unknown)}; known: {', '.join(sorted(FORMATS))}")
    return {f: FORMATS[f][1](graph, os.path.join(folder, FORMATS[f][0])) for f in wanted}


