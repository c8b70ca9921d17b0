"""Projections of a graph for display and for assistant contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import queries
from cairn.operators.graph import PropertyGraph

#: Budgets of context profiles.
CONTEXT_PROFILES = {
    "minimal": {"nodes": 4, "import_edges": 12, "edges": 8, "neighbors": 3, "chars": 1_800, "value_chars": 100},
    "small": {"nodes": 8, "import_edges": 32, "edges": 16, "neighbors": 6, "chars": 4_000, "value_chars": 140},
    "medium": {"nodes": 16, "import_edges": 96, "edges": 32, "neighbors": 12, "chars": 8_000, "value_chars": 180},
    "full": {"nodes": 40, "import_edges": 256, "edges": 96, "neighbors": 24, "chars": 16_000, "value_chars": 240},
    "max": {"nodes": 120, "import_edges": 1_000, "edges": 240, "neighbors": 48, "chars": 60_000, "value_chars": 320},
}


def context_profile(name: str | None) -> dict:
    """A profile by name; ``media`` is ``medium``, unknown names are ``small``."""
    name = {"media": "medium"}.get((name or "small").lower(), (name or "small").lower())
    return CONTEXT_PROFILES.get(name, CONTEXT_PROFILES["small"])


def collapse(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the parents (``node_id, parent``) of their ends, where they have one; edges inside a parent vanish."""
    a = parents.select(F.col("node_id").alias("source"), F.col("parent").alias("pa"))
    b = parents.select(F.col("node_id").alias("target"), F.col("parent").alias("pb"))
    moved = edges.join(a, "source", "left").join(b, "target", "left")
    return moved.select(F.coalesce("pa", "source").alias("source"), F.coalesce("pb", "target").alias("target"), "edge_type").where("source <> target")


def _containers(graph: PropertyGraph) -> DataFrame:
    inside = graph.edges.where("edge_type = 'contains'").groupBy(F.col("target").alias("node_id")).agg(F.min("source").alias("parent"))
    return inside


def file_level_view(graph: PropertyGraph, limit: int = 500) -> DataFrame:
    """``source, target, edge_type``: imports and calls rolled up to files, each once, between the first ``limit`` files by id."""
    shown = graph.nodes.where("node_type = 'file'").select("node_id").orderBy("node_id").limit(limit)
    edges = collapse(graph.edges.where(F.col("edge_type").isin("imports", "calls")).select("source", "target", "edge_type"), _containers(graph)).distinct()
    kept = edges.join(shown.withColumnRenamed("node_id", "source"), "source", "left_semi").join(shown.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return kept.select("source", "target", "edge_type")


def collapsed_weights(graph: PropertyGraph) -> DataFrame:
    """``source, target, n, width``: edges between files with a width of 1 (2 if there are calls) plus 0.5 per repeat, at most 10."""
    edges = collapse(graph.edges.where("edge_type <> 'contains'").select("source", "target", "edge_type"), _containers(graph))
    sums = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("edge_type") == "calls", 2.0).otherwise(1.0)).alias("w"))
    return sums.select("source", "target", "n", F.least(F.lit(10.0), F.col("w") + 0.5 * (F.col("n") - 1)).alias("width"))


def view_filters(graph: PropertyGraph) -> DataFrame:
    """``node_id`` and whether it is a god, fragile, tech-debt or root node by its share of the maxima, or a bridge (null without communities)."""
    bridge = F.coalesce("is_bridge", F.lit(False)) if "is_bridge" in graph.nodes.columns else F.lit(None).cast("boolean")
    m = queries.node_metrics(graph).join(graph.nodes.select("node_id", bridge.alias("bridge")), "node_id")
    many = lambda c, t: (F.col(c) > 0) & ((F.col(c) >= 0.5 * F.col(f"max_{c}")) | (F.col(c) > t))
    debt = (F.col("churn") > 0) & (F.col("churn") >= 0.3 * F.col("max_churn")) & (F.col("complexity") >= 0.3 * F.col("max_complexity"))
    return m.select("node_id", many("in_degree", 8).alias("god"), many("out_degree", 8).alias("fragile"), debt.alias("tech_debt"), (F.col("in_degree") == 0).alias("root"), "bridge")


def priority_sample(graph: PropertyGraph, limit: int = 2500) -> DataFrame:
    """``node_id, node_type``: the first ``limit`` nodes, files before symbols before imports before others, each by id."""
    rank = F.when(F.col("node_type") == "file", 0).when(F.col("node_type") == "symbol", 1).when(F.col("node_type") == "import", 2).otherwise(3)
    return graph.nodes.where(F.coalesce("node_type", F.lit("")) != "external").orderBy(rank, "node_id").limit(limit).select("node_id", "node_type")


def full_view(graph: PropertyGraph, limit: int = 2500, edge_limit: int = 6000) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``priority_sample`` with the external nodes next to them, and the first edges between all these by source, target and type."""
    chosen = priority_sample(graph, limit).select("node_id")
    ends = graph.edges.select(F.col("source").alias("node_id"), F.col("target").alias("other")).unionByName(graph.edges.select(F.col("target").alias("node_id"), F.col("source").alias("other")))
    near = ends.join(chosen, "node_id", "left_semi").select(F.col("other").alias("node_id")).distinct()
    external = graph.nodes.where("node_type = 'external'").select("node_id").join(near, "node_id", "left_semi")
    shown = chosen.unionByName(external)
    a, b = shown.withColumnRenamed("node_id", "source"), shown.withColumnRenamed("node_id", "target")
    edges = graph.edges.select("source", "target", "edge_type").join(a, "source", "left_semi").join(b, "target", "left_semi")
    return graph.nodes.join(shown, "node_id", "left_semi"), edges.select("source", "target", "edge_type").orderBy("source", "target", "edge_type").limit(edge_limit)


def first_match(graph: PropertyGraph, text: str) -> DataFrame:
    """``node_id`` of the first node by id whose label or id contains a text of at least two characters; shorter texts match none."""
    needle = F.lit(text.strip().lower())
    hit = F.contains(F.lower(node_label()), needle) | F.contains(F.lower("node_id"), needle)
    return graph.nodes.where(hit if len(text.strip()) >= 2 else F.lit(False)).select("node_id").orderBy("node_id").limit(1)


def node_fingerprint() -> Column:
    return F.sha2(F.to_json(F.struct("node_id", "node_type", "name", "qualified_name", "file_path", "kind", "complexity", "churn")), 256)


def client_delta(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """``part, id, kind``: nodes and edges (by source, target and type) added, removed or changed for a viewer."""
    a = old.nodes.select("node_id", node_fingerprint().alias("old"))
    b = new.nodes.select("node_id", node_fingerprint().alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated")
    nodes = a.join(b, "node_id", "full_outer").select(F.lit("node").alias("part"), F.col("node_id").alias("id"), kind.alias("kind")).where("kind is not null")
    key = F.concat_ws("|", "source", "target", "edge_type").alias("id")
    x, y = old.edges.select(key).distinct(), new.edges.select(key).distinct()
    added = y.join(x, "id", "left_anti").select(F.lit("edge").alias("part"), "id", F.lit("added").alias("kind"))
    return nodes.unionByName(added).unionByName(x.join(y, "id", "left_anti").select(F.lit("edge").alias("part"), "id", F.lit("removed").alias("kind")))


def viewer_search(graph: PropertyGraph, text: str, limit: int = 24) -> DataFrame:
    joined = F.lower(F.concat_ws(" ", "node_id", "name", "qualified_name", "file_path", "node_type"))
    return graph.nodes.where(F.contains(joined, F.lit(text.lower()))).select("node_id").orderBy("node_id").limit(limit)


def node_label(module: Column | None = None) -> Column:
    """What a node is called; ``module`` gives the module of import nodes where there are any."""
    t, module = F.col("node_type"), F.lit(None).cast("string") if module is None else module
    return F.coalesce(F.when(t == "file", F.col("file_path")).when(t == "symbol", F.coalesce("qualified_name", "name")).when(t == "import", module).otherwise(F.col("name")), F.col("node_id"))


def context_rank(graph: PropertyGraph) -> DataFrame:
    """``node_id, position``: nodes by bridge, complexity, churn and degree, all descending, then id; for the first ones of a context."""
    each = graph.nodes.join(graph.degrees(), "node_id")
    bridge = F.coalesce(F.col("is_bridge"), F.lit(False)) if "is_bridge" in graph.nodes.columns else F.lit(False)
    keys = [bridge.cast("int"), F.coalesce("complexity", F.lit(0)), F.coalesce("churn", F.lit(0)), F.col("in_degree") + F.col("out_degree")]
    return each.select("node_id", *[k.cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)])


def top_context_nodes(graph: PropertyGraph, n: int) -> DataFrame:
    return context_rank(graph).orderBy(*[F.desc(f"k{i}") for i in range(4)], "node_id").limit(n)


def fit_lines(lines: DataFrame, budget: int, group: str, order: str, text: str) -> DataFrame:
    """Per group the longest run of first lines whose length, one more for every line end between, stays within the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.length(F.col(text)) + 1).over(w) - 1
    return lines.withColumn("_used", running).where(F.col("_used") <= budget).drop("_used")


def neighbors_for_context(graph: PropertyGraph, node_id: str, limit: int) -> DataFrame:
    """The first edges at a node with their direction; a loop counts as outgoing."""
    at = graph.edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    out = F.col("source") == node_id
    named = at.select(F.when(out, "outgoing").otherwise("incoming").alias("direction"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("neighbor"), "edge_type")
    return named.orderBy("direction", "neighbor", "edge_type").limit(limit)


def clean_messages(messages: DataFrame, conversation: str, order: str, keep: int = 12) -> DataFrame:
    """The last ``keep`` messages of each conversation, of those the ones of users and assistants with a text."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    last = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
    return last.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))


def compact_nodes(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """What a context tells of nodes: id, type, label, path, kind, complexity, churn and degree, by id."""
    get = lambda c: F.col(c) if c in graph.nodes.columns else F.lit(None)
    near = PropertyGraph(graph.nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi"), graph.edges)
    module = F.col("module") if "module" in graph.nodes.columns else None
    each = near.nodes.join(near.degrees(), "node_id").select(
        "node_id", "node_type", node_label(module).alias("label"), "file_path", get("kind").alias("kind"), get("complexity").alias("complexity"),
        get("churn").alias("churn"), (F.col("in_degree") + F.col("out_degree")).alias("degree"),
    )
    return each.orderBy("node_id")


#: The parts of a context in their order: heading, and what fills it.
CONTEXT_PARTS = (
    ("Who imports whom", lambda g, p, at: g.edges.where("edge_type = 'imports'").select("source", "target").orderBy("source", "target").limit(p["import_edges"])),
    ("Nodes that matter most", lambda g, p, at: compact_nodes(g, top_context_nodes(g, p["nodes"]))),
    ("The chosen node", lambda g, p, at: compact_nodes(g, g.nodes.where(F.col("node_id") == at)) if at else None),
    ("Links of the chosen node", lambda g, p, at: neighbors_for_context(g, at, p["neighbors"]) if at else None),
    ("Some edges", lambda g, p, at: g.edges.select("source", "target", "edge_type").orderBy("source", "target", "edge_type").limit(p["edges"])),
)
CUT_SHORT = "(cut to the size of the profile)"


def graph_context(graph: PropertyGraph, selected: str | None = None, size: str | None = None, title: str = "workspace") -> str:
    """A text about a graph within a profile's budget, made of ``CONTEXT_PARTS``; only the first few nodes and edges are collected."""
    p = context_profile(size)
    at = selected if selected and graph.has_node(selected) else None
    counts = {k: v for k, v in queries.statistics(graph).first().asDict().items() if v}
    text = f"{title} ({size or 'small'} profile): " + ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in counts.items())
    for heading, part in CONTEXT_PARTS:
        rows = part(graph, p, at)
        if rows is None:
            continue
        short = [paths.truncated(c, p["value_chars"], p["value_chars"] - 3, "...").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
        lines = [r.json for r in rows.select(F.to_json(F.struct(*short)).alias("json")).collect()]
        if lines:
            text += f"\n\n## {heading}\n" + "\n".join(lines)
    if len(text) <= p["chars"]:
        return text
    room = p["chars"] - len(CUT_SHORT) - 1
    return text[: max(0, text.rfind("\n", 0, room + 1))] + "\n" + CUT_SHORT
