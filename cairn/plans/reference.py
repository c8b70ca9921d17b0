"""Queries of the graph engine's own operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import build, communities, intelligence, queries as q, resolution, timeline, views
from cairn.operators.graph import PropertyGraph, strongly_connected_components
from cairn.plans import projection
from cairn.session import load, work_dir
from cairn.sources import exports, extract
from cairn.sources.ignore import IgnoreMatcher
from cairn.streaming import changes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a query with its SQL (over the projected graph unless ``plain``)."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else projection.oracle(sql)
        return f

    return keep


# -- counts, degrees, statistics ---------------------------------------------------------------------------------


@query("SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type")
def graph_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def graph_edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS node_count, count(*) FILTER (node_type = 'file') AS file_count, count(*) FILTER (node_type = 'symbol') AS symbol_count,
  count(*) FILTER (node_type = 'import') AS import_count, count(*) FILTER (node_type = 'proxy') AS proxy_count, (SELECT count(*) FROM edges) AS edge_count FROM nodes""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.statistics(projection.graph(spark, sf_dir))


_DEGREES = """WITH deg AS (SELECT n.node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes n
  LEFT JOIN (SELECT target, count(*) AS i FROM edges GROUP BY 1) a ON a.target = n.node_id LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY 1) b ON b.source = n.node_id) """


@query(_DEGREES + "SELECT node_id, in_degree, out_degree FROM deg")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).degrees()


@query(_DEGREES + "SELECT node_id, in_degree FROM deg ORDER BY in_degree DESC, node_id LIMIT 25")
def in_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).degrees().orderBy(F.desc("in_degree"), "node_id").limit(25).select("node_id", "in_degree")


@query(_DEGREES + "SELECT node_id, out_degree FROM deg ORDER BY out_degree DESC, node_id LIMIT 25")
def out_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).degrees().orderBy(F.desc("out_degree"), "node_id").limit(25).select("node_id", "out_degree")


@query(_DEGREES + """SELECT node_id, in_degree, out_degree, coalesce(churn, 0) AS churn, coalesce(complexity, 0) AS complexity, max(in_degree) OVER () AS max_in_degree,
  max(out_degree) OVER () AS max_out_degree, max(coalesce(churn, 0)) OVER () AS max_churn, max(coalesce(complexity, 0)) OVER () AS max_complexity FROM deg JOIN nodes USING (node_id)""")
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.node_metrics(projection.graph(spark, sf_dir))


# -- analyses ----------------------------------------------------------------------------------------------------

_PARTS = "', '".join(paths.GENERATED_PARTS)
_GENERATED = "(list_has_any(string_split(lower(file_path), '/'), ['" + _PARTS + "']) OR " + " OR ".join(f"lower(file_path) LIKE '%{e}'" for e in paths.GENERATED_ENDINGS) + ")"
_PUBLIC = "(NOT starts_with(name, '_') AND regexp_matches(regexp_extract(coalesce(qualified_name, ''), '([^.]*)\\.[^.]*$', 1), '^[A-Z]'))"
_ENTRY = "(coalesce(name IN ('main', 'run', 'cli', 'app'), false) OR coalesce(qualified_name LIKE '%.main', false))"
_DEAD = f"""SELECT node_id FROM nodes WHERE node_type = 'symbol' AND kind IN ('function', 'method') AND NOT (length(name) > 4 AND name LIKE '\\_\\_%\\_\\_' ESCAPE '\\') AND NOT {_ENTRY}
  AND NOT {_GENERATED} AND node_id NOT IN (SELECT source FROM edges WHERE edge_type = 'calls' UNION ALL SELECT target FROM edges WHERE edge_type = 'calls')"""


@query(_DEAD + f" AND NOT {_PUBLIC}")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.dead_code(projection.graph(spark, sf_dir))


@query(_DEAD)
def dead_code_incl_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.dead_code(projection.graph(spark, sf_dir), include_public_api=True)


_GOD = _DEGREES + f""", scored AS (SELECT node_id, CAST(in_degree + out_degree + EXTRA AS DOUBLE) AS score FROM deg JOIN nodes n USING (node_id) JOINED WHERE NOT {_GENERATED})
  SELECT node_id, score FROM scored WHERE score >= (SELECT avg(score) + stddev_pop(score) FROM scored)"""


@query(_GOD.replace("EXTRA", "0").replace("JOINED", ""))
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.god_nodes(projection.graph(spark, sf_dir))


def _consumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names consumed per nation's folder: the parts its line items are about."""
    items = load(spark, sf_dir, "lineitem").where("l_discount >= 0.09")
    return items.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("file_path"), F.concat(F.lit("part_"), F.col("l_partkey")).alias("fqn")).distinct()


_CONSUMES = "SELECT DISTINCT concat('s', l_suppkey) AS file_path, concat('part_', l_partkey) AS fqn FROM lineitem WHERE l_discount >= 0.09"


@query(
    _GOD.replace("EXTRA", "coalesce(d.n, 0)").replace("JOINED", f"LEFT JOIN (SELECT fqn, count(*) AS n FROM ({_CONSUMES}) c GROUP BY fqn) d ON n.node_type = 'symbol' AND d.fqn = coalesce(n.qualified_name, n.name)")
)
def god_nodes_with_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.god_nodes(projection.graph(spark, sf_dir), dependents=resolution.dependents(_consumes(spark, sf_dir)))


_IMPORTS = """SELECT DISTINCT a.file_path AS source, b.file_path AS target FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target
  WHERE e.edge_type = 'imports' AND b.node_type = 'file' AND a.file_path <> b.file_path"""
_DEPENDS = """SELECT DISTINCT least(a.file_path, b.file_path) AS source, greatest(a.file_path, b.file_path) AS target FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target
  WHERE e.edge_type IN ('imports', 'calls') AND a.file_path <> b.file_path"""


@query(_IMPORTS)
def file_import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.file_import_graph(projection.graph(spark, sf_dir))


@query(_DEPENDS)
def file_dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.file_dependency_graph(projection.graph(spark, sf_dir))


@query(f"""SELECT node_id FROM nodes WHERE (node_type = 'file' AND (file_path NOT IN (SELECT target FROM ({_IMPORTS}) i) OR list_last(string_split(file_path, '/')) IN
  ('__main__.py', 'main.py', 'app.py', 'index.js', 'index.ts', 'index.tsx'))) OR (node_type = 'symbol' AND {_ENTRY})""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.entry_points(projection.graph(spark, sf_dir))


@query(f"WITH linked AS ({_DEPENDS}) SELECT file_path FROM nodes WHERE node_type = 'file' AND file_path NOT IN (SELECT source FROM linked UNION ALL SELECT target FROM linked)")
def orphan_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.orphan_modules(projection.graph(spark, sf_dir))


@query(f"SELECT node_id, complexity FROM nodes WHERE node_type = 'symbol' AND complexity IS NOT NULL AND NOT {_GENERATED} ORDER BY complexity DESC, node_id LIMIT 25")
def complexity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.complexity_rankings(projection.graph(spark, sf_dir)).orderBy(F.desc("complexity"), "node_id").limit(25)


@query("SELECT node_id, churn FROM nodes WHERE churn > 0 ORDER BY churn DESC, node_id LIMIT 25")
def churn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.churn_rankings(projection.graph(spark, sf_dir)).orderBy(F.desc("churn"), "node_id").limit(25)


@query(f"SELECT file_path FROM nodes WHERE node_type = 'file' AND {_GENERATED}")
def generated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).nodes.where((F.col("node_type") == "file") & paths.is_generated_or_vendor("file_path")).select("file_path")


@query(f"SELECT node_id FROM nodes WHERE node_type = 'symbol' AND {_PUBLIC}")
def public_api_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).nodes.where((F.col("node_type") == "symbol") & paths.is_public_method("name", "qualified_name")).select("node_id")


# -- cycles, components, communities ---------------------------------------------------------------------------

_REACH = "WITH reach(a, b) AS (SELECT source, target FROM links UNION SELECT r.a, t.target FROM reach r JOIN links t ON t.source = r.b), ids AS (SELECT source AS id FROM links UNION SELECT target FROM links) "


@query(_REACH + """, pairs AS (SELECT x.a AS id, min(x.b) AS first_ FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
  SELECT id AS node_id, least(id, coalesce(first_, id)) AS component FROM ids LEFT JOIN pairs USING (id)""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = projection.links(spark, sf_dir)
    return strongly_connected_components(arcs.select(F.explode(F.array("source", "target")).alias("node_id")), arcs)


@query("""WITH walk(start_, at_, path) AS (SELECT source, target, [source, target] FROM trade WHERE source < target
    UNION ALL SELECT w.start_, t.target, list_append(w.path, t.target) FROM walk w JOIN trade t ON t.source = w.at_ WHERE t.target > w.start_ AND NOT list_contains(w.path, t.target)),
  closed AS (SELECT path FROM walk w JOIN trade t ON t.source = w.at_ AND t.target = w.start_)
  SELECT min(array_to_string(path, '>')) AS path, CAST(any_value(len(path)) AS INT) AS length FROM closed GROUP BY list_sort(path)""")
def circular_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intelligence.circular_dependencies(projection.trade(spark, sf_dir))
    return found.select(F.array_join("path", ">").alias("path"), "length")


@query("""WITH RECURSIVE_ both_ways AS (SELECT source AS a, target AS b FROM edges WHERE edge_type = 'imports' UNION SELECT target, source FROM edges WHERE edge_type = 'imports')
  SELECT count(*) AS files, count(DISTINCT a) AS linked FROM both_ways""".replace("RECURSIVE_ ", ""))
def import_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = projection.graph(spark, sf_dir).edges.where("edge_type = 'imports'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("a").alias("linked"))


@query("""SELECT DISTINCT e.source AS node_id FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target WHERE e.edge_type = 'imports' AND a.region <> b.region""")
def bridge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    given = g.nodes.where("node_type = 'file'").select("node_id", F.col("region").alias("community_id"))
    return intelligence.bridge_nodes(g.edges.where("edge_type = 'imports'"), given)


@query("""WITH bridges AS (SELECT DISTINCT e.source AS node_id FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target WHERE e.edge_type = 'imports' AND a.region <> b.region),
  files AS (SELECT file_path, min(region) AS region FROM nodes WHERE node_type = 'file' GROUP BY 1)
  SELECT f.region AS community_id, count(*) AS n, count(*) FILTER (n.node_id IN (SELECT node_id FROM bridges)) AS bridges FROM nodes n LEFT JOIN files f USING (file_path) GROUP BY f.region""")
def annotated_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    given = g.nodes.where("node_type = 'file'").select("node_id", F.col("region").alias("community_id"))
    marked = intelligence.annotate(g, given, intelligence.bridge_nodes(g.edges.where("edge_type = 'imports'"), given))
    return marked.nodes.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_bridge"), True)).alias("bridges"))


@query()
def communities_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = projection.links(spark, sf_dir)
    return communities.communities(arcs.select(F.explode(F.array("source", "target")).alias("node_id")).distinct(), arcs)


# -- query interface ---------------------------------------------------------------------------------------------


@query("SELECT node_id, kind FROM nodes WHERE node_type = 'symbol' AND file_path LIKE 'asia/%' AND kind = 'function' ORDER BY node_id LIMIT 50")
def query_by_type_prefix_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.query_graph(projection.graph(spark, sf_dir), "symbol", "asia/", "function", 50).select("node_id", "kind")


@query("SELECT node_id FROM nodes WHERE contains(lower(concat_ws(chr(1), node_id, name, qualified_name, file_path)), 'order_1') ORDER BY node_id LIMIT 25")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.search_nodes(projection.graph(spark, sf_dir), "Order_1").select("node_id")


_MOST = "(SELECT node_id FROM (SELECT target AS node_id, count(*) AS n FROM edges GROUP BY 1) t ORDER BY n DESC, node_id LIMIT 1)"
_IN = "SELECT 'incoming' AS direction, e.source AS neighbor, e.edge_type, n.node_type, n.file_path FROM edges e JOIN nodes n ON n.node_id = e.source WHERE e.target = " + _MOST
_OUT = "SELECT 'outgoing' AS direction, e.target AS neighbor, e.edge_type, n.node_type, n.file_path FROM edges e JOIN nodes n ON n.node_id = e.target WHERE e.source = " + _MOST


def _most_used(g: PropertyGraph) -> str:
    top = g.edges.groupBy("target").count().orderBy(F.desc("count"), "target").first()
    return top[0] if top else ""


@query(_IN)
def neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return q.get_neighbors(g, _most_used(g), "in")


@query(_OUT)
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return q.get_neighbors(g, _most_used(g), "out")


@query(_IN + " UNION ALL " + _OUT)
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return q.get_neighbors(g, _most_used(g))


@query(f"SELECT CASE WHEN source = {_MOST} THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN source = {_MOST} THEN target ELSE source END AS neighbor, edge_type FROM edges WHERE source = {_MOST} OR target = {_MOST} ORDER BY 1, 2, 3 LIMIT 12")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return views.neighbors_for_context(g, _most_used(g), views.context_profile("media")["neighbors"])


# -- timeline ------------------------------------------------------------------------------------------------------

_HEADS = "SELECT snapshot_id, count(*) AS node_count FROM snapshot_rows GROUP BY snapshot_id"


@query(_HEADS)
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.snapshot_rows(spark, sf_dir).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("node_count"))


@query("""SELECT node_id, CASE WHEN a.attrs_hash IS NULL THEN 'added' WHEN b.attrs_hash IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM (SELECT * FROM snapshot_rows WHERE snapshot_id = 2) a
  FULL JOIN (SELECT * FROM snapshot_rows WHERE snapshot_id = 3) b USING (node_id) WHERE a.attrs_hash IS DISTINCT FROM b.attrs_hash""")
def snapshot_delta_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.delta_nodes(projection.snapshot_rows(spark, sf_dir), 2, 3)


_YEAR_EDGES = "SELECT DISTINCT CAST(year(o_orderdate) - 1994 AS BIGINT) AS snapshot_id, concat('c', o_custkey) AS source, o_orderpriority AS target FROM orders"


@query(f"""WITH e AS ({_YEAR_EDGES}), a AS (SELECT source, target FROM e WHERE snapshot_id = 2), b AS (SELECT source, target FROM e WHERE snapshot_id = 3)
  SELECT *, 'added' AS kind FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y""", plain=True)
def snapshot_delta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select((F.year("o_orderdate") - 1994).cast("bigint").alias("snapshot_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.col("o_orderpriority").alias("target"))
    return timeline.delta_edges(rows, 2, 3)


@query("SELECT snapshot_id, attrs_hash, CAST(snapshot_id * 10 AS DOUBLE) AS created_at FROM snapshot_rows WHERE node_id = 'file:c7'")
def node_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.snapshot_rows(spark, sf_dir)
    heads = rows.select("snapshot_id", (F.col("snapshot_id") * 10).cast("double").alias("created_at")).distinct()
    return timeline.node_history(rows, heads, "file:c7").select("snapshot_id", "attrs_hash", "created_at")


_RATES = """WITH ids AS (SELECT DISTINCT snapshot_id FROM snapshot_rows WHERE snapshot_id BETWEEN LOW AND HIGH), steps AS (SELECT snapshot_id AS b, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS a FROM ids),
  here AS (SELECT DISTINCT node_id FROM snapshot_rows JOIN ids USING (snapshot_id)), pairs AS (SELECT h.node_id, x.attrs_hash AS old, y.attrs_hash AS new FROM here h CROSS JOIN steps s
    LEFT JOIN snapshot_rows x ON x.node_id = h.node_id AND x.snapshot_id = s.a LEFT JOIN snapshot_rows y ON y.node_id = h.node_id AND y.snapshot_id = s.b WHERE s.a IS NOT NULL)
  SELECT node_id, count(*) FILTER (old IS NOT NULL AND new IS DISTINCT FROM old) AS changes, count(*) FILTER (old IS NOT NULL AND new IS DISTINCT FROM old) / ((SELECT count(*) FROM ids) - 1) AS rate FROM pairs GROUP BY node_id"""


@query(_RATES.replace("LOW", "0").replace("HIGH", "99"))
def churn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.snapshot_rows(spark, sf_dir)
    return timeline.churn_rates(rows, rows)


@query(_RATES.replace("LOW", "2").replace("HIGH", "5"))
def churn_rate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.snapshot_rows(spark, sf_dir)
    return timeline.churn_rates(rows, rows, 5, 2)


# -- resolution and registry -------------------------------------------------------------------------------------

_STEM = "regexp_replace(list_last(string_split(file_path, '/')), '\\.[^.]*$', '')"
_BARE = "regexp_replace(file_path, '\\.[^.]*$', '')"
_FILES = "files AS (SELECT DISTINCT file_path FROM nodes WHERE node_type = 'file')"
_INDEX = f"""{_FILES}, named AS (SELECT {_STEM} AS key, file_path FROM files UNION ALL SELECT {_BARE}, file_path FROM files UNION ALL SELECT file_path, file_path FROM files
  UNION ALL SELECT replace({_BARE}, '/', '.'), file_path FROM files UNION ALL SELECT list_last(string_split({_BARE}, '/')), file_path FROM files),
  idx AS (SELECT key, max(file_path) AS file_path FROM named WHERE key <> '' GROUP BY key)"""


@query(f"WITH {_INDEX} SELECT key, file_path FROM idx")
def module_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.module_index(projection.graph(spark, sf_dir).nodes.where("node_type = 'file'"))


_MODULE = f"""CASE abs(hash_) % 5 WHEN 0 THEN replace({_BARE}, '/', '.') WHEN 1 THEN file_path WHEN 2 THEN {_STEM} WHEN 3 THEN concat('.', {_STEM}) ELSE concat('nowhere.', {_STEM}, '_x') END"""


@query(f"""WITH {_INDEX}, imports AS (SELECT concat('import:', file_path) AS node_id, file_path, {_MODULE} AS module FROM (SELECT file_path, length(file_path) AS hash_ FROM files) f),
  bases AS (SELECT node_id, CASE WHEN starts_with(module, '.') THEN concat(regexp_replace(file_path, '/[^/]*$', ''), '/', replace(module[2:], '.', '/')) ELSE module END AS m, starts_with(module, '.') AS rel FROM imports),
  tried AS (SELECT node_id, unnest(CASE WHEN rel THEN [m, concat(m, '.py')] ELSE [m, replace(m, '.', '/'), concat(replace(m, '.', '/'), '.py')] END) AS c, unnest(CASE WHEN rel THEN [1, 2] ELSE [1, 2, 3] END) AS r FROM bases),
  keys AS (SELECT node_id, c AS key, r * 2 AS rank_ FROM tried UNION ALL SELECT node_id, regexp_replace(list_last(string_split(c, '/')), '\\.[^.]*$', ''), r * 2 + 1 FROM tried)
  SELECT node_id, arg_min(i.file_path, rank_) AS file_path FROM keys k JOIN idx i USING (key) WHERE key <> '' GROUP BY node_id""")
def module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = projection.graph(spark, sf_dir).nodes.where("node_type = 'file'").select("file_path").distinct()
    stem, bare, n = paths.stem("file_path"), paths.without_ending("file_path"), F.length("file_path") % 5
    module = F.when(n == 0, F.replace(bare, F.lit("/"), F.lit("."))).when(n == 1, F.col("file_path")).when(n == 2, stem).when(n == 3, F.concat(F.lit("."), stem)).otherwise(F.concat(F.lit("nowhere."), stem, F.lit("_x")))
    imports = files.select(F.concat(F.lit("import:"), "file_path").alias("node_id"), "file_path", module.alias("module"))
    return resolution.resolve_modules(imports, resolution.module_index(files))


_SYMBOLS = "SELECT concat('symbol:', path, ':', qualified_name) AS node_id, path AS file_path, name, qualified_name FROM (SELECT DISTINCT path, name, qualified_name FROM parsed_symbols WHERE qualified_name IS NOT NULL) s"


def _parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "parsed_symbols").where("qualified_name is not null").select("path", "name", "qualified_name").distinct()
    return rows.select(build.symbol_node_id("path", "qualified_name").alias("node_id"), F.lit("symbol").alias("node_type"), F.col("path").alias("file_path"), "name", "qualified_name")


@query(f"""WITH symbols AS ({_SYMBOLS}), calls AS (SELECT DISTINCT file_path, qualified_name AS caller, CASE WHEN length(name) % 3 = 0 THEN concat(name, '_gone') ELSE name END AS callee FROM symbols),
  best AS (SELECT c.file_path, c.caller, c.callee, min(s.node_id) FILTER (s.qualified_name = c.callee) AS exact_, min(s.node_id) AS any_ FROM calls c LEFT JOIN symbols s
    ON s.file_path = c.file_path AND (s.qualified_name = c.callee OR s.name = c.callee OR s.qualified_name LIKE concat('%.', replace(c.callee, '_', '\\_')) ESCAPE '\\') GROUP BY 1, 2, 3)
  SELECT concat('symbol:', file_path, ':', caller) AS source, coalesce(exact_, any_, concat('proxy:', file_path, ':', callee)) AS target, 'calls' AS edge_type FROM best""", plain=True)
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _parsed_symbols(spark, sf_dir)
    callee = F.when(F.length("name") % 3 == 0, F.concat("name", F.lit("_gone"))).otherwise(F.col("name"))
    calls = symbols.select("file_path", F.col("qualified_name").alias("caller"), callee.alias("callee"), F.lit(1).alias("line")).distinct()
    return resolution.resolve_calls(calls, symbols)[0].select("source", "target", "edge_type")


@query(f"""WITH symbols AS ({_SYMBOLS}) SELECT s.node_id AS source, concat('proxy:', i.path, ':', i.base) AS target, i.line FROM parsed_inheritance i JOIN symbols s ON s.file_path = i.path AND s.name = i.class_name
  WHERE i.base IS NOT NULL""", plain=True)
def inheritance_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = resolution.resolve_bases(load(spark, sf_dir, "parsed_inheritance"), _parsed_symbols(spark, sf_dir))
    return edges.select("source", "target", "line")


_PROVIDES = "SELECT DISTINCT concat('s', l_suppkey) AS file_path, concat('part_', l_partkey) AS fqn FROM lineitem WHERE l_quantity >= 40"


def _provides(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").where("l_quantity >= 40")
    return items.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("file_path"), F.concat(F.lit("part_"), F.col("l_partkey")).alias("fqn")).distinct()


@query(f"SELECT fqn, max(file_path) AS file_path FROM ({_PROVIDES}) p GROUP BY fqn", plain=True)
def registry_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.providers(_provides(spark, sf_dir))


@query(f"SELECT fqn, count(DISTINCT file_path) AS n FROM ({_CONSUMES}) c GROUP BY fqn", plain=True)
def registry_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.dependents(_consumes(spark, sf_dir))


@query(f"""WITH p AS ({_PROVIDES}), owner AS (SELECT fqn, max(file_path) AS target FROM p GROUP BY fqn)
  SELECT DISTINCT c.file_path AS source, o.target FROM ({_CONSUMES}) c JOIN owner o USING (fqn) WHERE c.file_path <> o.target""", plain=True)
def registry_import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.registry_import_graph(_provides(spark, sf_dir), _consumes(spark, sf_dir))


_TOUCHED = "file_path LIKE 's%7'"
_REMOVED = f"SELECT DISTINCT fqn FROM ({_PROVIDES}) p WHERE fqn NOT IN (SELECT fqn FROM ({_PROVIDES}) k WHERE NOT {_TOUCHED})"


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _provides(spark, sf_dir)
    touched = old.where(_TOUCHED).select("file_path")
    return resolution.update_registry(old, old.limit(0), touched)[1]


@query(_REMOVED, plain=True)
def registry_removed_fqns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(spark, sf_dir)


@query(f"SELECT DISTINCT concat('proxy:', file_path, ':', fqn) AS node_id FROM ({_CONSUMES}) c WHERE fqn IN ({_REMOVED}) AND file_path LIKE 's%2'", plain=True)
def broken_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    consumes = _consumes(spark, sf_dir)
    proxies = consumes.where("file_path like 's%2'").select(F.concat(F.lit("proxy:"), "file_path", F.lit(":"), "fqn").alias("node_id"), F.lit("proxy").alias("node_type"))
    return resolution.broken_proxies(_removed(spark, sf_dir), consumes, proxies)


# -- scans and builds ----------------------------------------------------------------------------------------------

_SCANS = """WITH ranked AS (SELECT path, sha256, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, sha256 DESC) AS new_, row_number() OVER (PARTITION BY path ORDER BY mtime ASC NULLS LAST, sha256 ASC) AS old_
  FROM file_records WHERE path IS NOT NULL), a AS (SELECT path, sha256 FROM ranked WHERE new_ = 1 AND path NOT LIKE '%7.%'), b AS (SELECT path, sha256 FROM ranked WHERE old_ = 1 AND path NOT LIKE '%3.%')"""


@query(_SCANS + """ SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.sha256 IS NOT DISTINCT FROM b.sha256 THEN 'unchanged' ELSE 'modified' END AS change
  FROM (SELECT *, path AS p FROM a) a FULL JOIN (SELECT *, path AS p FROM b) b USING (path)""".replace("b.path IS NULL", "b.p IS NULL").replace("a.path IS NULL", "a.p IS NULL"), plain=True)
def fingerprint_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "file_records").select("path", "sha256", "mtime")
    first = records.where("path is not null").groupBy("path").agg(F.min(F.struct(F.col("mtime").isNull(), "mtime", "sha256")).alias("r")).select("path", "r.sha256", "r.mtime")
    return build.classify(records.where("path not like '%7.%'"), first.where("path not like '%3.%'"))


@query("""SELECT extension, count(*) AS n FROM (SELECT DISTINCT path, CASE WHEN regexp_extract(list_last(string_split(path, '/')), '.(\\.[^.]+)$', 1) = '' THEN '(no extension)'
  ELSE lower(regexp_extract(list_last(string_split(path, '/')), '.(\\.[^.]+)$', 1)) END AS extension FROM file_records WHERE path IS NOT NULL) t GROUP BY extension""", plain=True)
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.extension_counts(load(spark, sf_dir, "file_records"))


@query("""SELECT language, count(*) AS files FROM (SELECT DISTINCT file_path, CASE lower(regexp_extract(file_path, '(\\.[^.]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript'
  WHEN '.cjs' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' END AS language FROM file_nodes) t
  WHERE language IS NOT NULL GROUP BY language""", plain=True)
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "file_nodes").select("file_path").distinct()
    nodes = files.select(build.file_node_id("file_path").alias("node_id"), F.lit("file").alias("node_type"), paths.language("file_path").alias("language"))
    return q.language_histogram(PropertyGraph(nodes, nodes))


@query("SELECT count(*) AS file_count, CAST(sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE concat('%', chr(10)) THEN 0 ELSE 1 END) AS BIGINT) AS line_count FROM documents WHERE path IS NOT NULL AND text IS NOT NULL", plain=True)
def workspace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.sources import workspace

    texts = load(spark, sf_dir, "documents").where("path is not null and text is not null")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rest = F.when((F.col("text") == "") | F.col("text").endswith("\n"), 0).otherwise(1)
    return workspace.metrics(texts.select((newlines + rest).alias("line_count")))


@query("""SELECT DISTINCT path FROM file_records WHERE path IS NOT NULL AND NOT (concat('/', path) LIKE '%/node_modules/%' OR concat('/', path) LIKE '%/.git/%' OR concat('/', path) LIKE '%/__pycache__/%'
  OR concat('/', path) LIKE '%/.venv/%' OR path LIKE '%.pyc' OR (regexp_matches(path, '(^|/)docs/') ) OR (regexp_matches(path, '[0-4]\\.go$') AND NOT regexp_matches(path, '(^|/)[^/]*1\\.go$')))""", plain=True)
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    matcher = IgnoreMatcher(extra=("docs/", "*[0-4].go", "!*1.go"))

    def keep(parts):
        for part in parts:
            yield part[[not matcher.is_ignored(p) for p in part["path"]]]

    return load(spark, sf_dir, "file_records").where("path is not null").select("path").distinct().mapInPandas(keep, "path string")


@query("""WITH f AS (SELECT DISTINCT node_id, file_path, CAST(length(file_path) AS BIGINT) AS churn FROM file_nodes), c AS (SELECT *, length(file_path) % 4 AS k FROM f)
  SELECT node_id, CASE k WHEN 1 THEN churn + 1 WHEN 2 THEN 0 ELSE churn END AS churn, CAST(9 AS DOUBLE) AS last_seen, CAST(CASE WHEN k = 2 THEN 9 ELSE 1 END AS DOUBLE) AS first_seen FROM c WHERE k <> 0""", plain=True)
def incremental_update_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by length of path modulo 4: deleted, modified, added, unchanged."""
    files = load(spark, sf_dir, "file_nodes").select("node_id", "file_path").distinct().withColumn("k", F.length("file_path") % 4)
    node = lambda df, first, last, churn: df.select("node_id", F.lit("file").alias("node_type"), "file_path", F.lit(first).alias("first_seen"), F.lit(last).alias("last_seen"), churn.cast("bigint").alias("churn"))
    none = files.select(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("calls").alias("edge_type")).limit(0)
    old = PropertyGraph(node(files.where("k <> 2"), 1.0, 5.0, F.length("file_path")), none)
    fresh = PropertyGraph(node(files.where("k in (1, 2)"), 9.0, 9.0, F.lit(0)), none)
    change = F.element_at(F.array(*map(F.lit, ("deleted", "modified", "added", "unchanged"))), F.col("k") + 1)
    after = build.update(old, files.select(F.col("file_path").alias("path"), change.alias("change")), fresh, 9.0)
    return after.nodes.select("node_id", "churn", "last_seen", "first_seen")


@query()
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, read from the texts of all files."""
    return extract.flatten(extract.parse_files(load(spark, sf_dir, "documents")), "symbols")


@query()
def built_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph built from all texts."""
    from cairn.session import materialize

    parsed = materialize(extract.parse_files(load(spark, sf_dir, "documents")), "parsed")
    parts = {w: extract.flatten(parsed, w) for w in ("symbols", "imports", "inheritance", "calls")}
    g = build.build(parsed.select("path", "language", F.col("errors").alias("parse_errors")), **parts)
    return g.edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


# -- views and contexts --------------------------------------------------------------------------------------------

_UP = "WITH up AS (SELECT target AS node_id, min(source) AS parent FROM edges WHERE edge_type = 'contains' GROUP BY 1), moved AS (SELECT coalesce(a.parent, e.source) AS source, coalesce(b.parent, e.target) AS target, edge_type FROM edges e LEFT JOIN up a ON a.node_id = e.source LEFT JOIN up b ON b.node_id = e.target WHERE edge_type <> 'contains') "


@query(_UP + ", shown AS (SELECT node_id FROM nodes WHERE node_type = 'file' ORDER BY node_id LIMIT 500) SELECT DISTINCT source, target, edge_type FROM moved WHERE source <> target AND source IN (SELECT node_id FROM shown) AND target IN (SELECT node_id FROM shown)")
def file_level_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_level_view(projection.graph(spark, sf_dir))


@query(_UP + "SELECT source, target, count(*) AS n, CAST(least(10.0, max(CASE edge_type WHEN 'calls' THEN 2.0 ELSE 1.0 END) + 0.5 * (count(*) - 1)) AS DOUBLE) AS width FROM moved WHERE source <> target GROUP BY 1, 2")
def collapsed_view_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.collapsed_weights(projection.graph(spark, sf_dir))


@query(_DEGREES + """, m AS (SELECT node_id, in_degree, out_degree, coalesce(churn, 0) AS churn, coalesce(complexity, 0) AS complexity FROM deg JOIN nodes USING (node_id)),
  t AS (SELECT max(in_degree) AS mi, max(out_degree) AS mo, max(churn) AS mc, max(complexity) AS mx FROM m)
  SELECT node_id, in_degree > 0 AND (in_degree >= 0.5 * mi OR in_degree > 8) AS god, out_degree > 0 AND (out_degree >= 0.5 * mo OR out_degree > 8) AS fragile,
  churn > 0 AND churn >= 0.3 * mc AND complexity >= 0.3 * mx AS tech_debt, in_degree = 0 AS root, coalesce(churn = 4, false) AS bridge FROM m, t""")
def view_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return views.view_filters(PropertyGraph(g.nodes.withColumn("is_bridge", F.col("churn") == 4), g.edges))


@query("SELECT node_id, node_type FROM nodes ORDER BY CASE node_type WHEN 'file' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END, node_id LIMIT 2500")
def priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.priority_sample(projection.graph(spark, sf_dir))


@query("""WITH old AS (SELECT node_id, complexity FROM nodes WHERE coalesce(complexity, 0) <> 3), new AS (SELECT node_id, CASE WHEN complexity = 5 THEN 6 ELSE complexity END AS complexity FROM nodes WHERE coalesce(complexity, 0) <> 4)
  SELECT 'node' AS part, coalesce(o.node_id, n.node_id) AS id, CASE WHEN o.node_id IS NULL THEN 'added' WHEN n.node_id IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM old o FULL JOIN new n ON n.node_id = o.node_id
  WHERE o.node_id IS NULL OR n.node_id IS NULL OR o.complexity IS DISTINCT FROM n.complexity
  UNION ALL SELECT 'edge', concat_ws('|', source, target, edge_type), 'removed' FROM (SELECT DISTINCT source, target, edge_type FROM edges WHERE edge_type = 'imports') e""")
def client_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    seen = F.coalesce("complexity", F.lit(0))
    new = g.nodes.where(seen != 4).withColumn("complexity", F.when(F.col("complexity") == 5, 6).otherwise(F.col("complexity")))
    return views.client_delta(PropertyGraph(g.nodes.where(seen != 3), g.edges), PropertyGraph(new, g.edges.where("edge_type <> 'imports'")))


@query("SELECT node_id FROM nodes WHERE contains(lower(concat_ws(' ', node_id, name, qualified_name, file_path, node_type)), 'europe/nation_1') ORDER BY node_id LIMIT 24")
def viewer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.viewer_search(projection.graph(spark, sf_dir), "Europe/Nation_1")


@query(_DEGREES + "SELECT node_id FROM deg JOIN nodes USING (node_id) ORDER BY coalesce(complexity, 0) DESC, coalesce(churn, 0) DESC, in_degree + out_degree DESC, node_id LIMIT 40")
def context_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.top_context_nodes(projection.graph(spark, sf_dir), views.context_profile("full")["nodes"]).select("node_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(length(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS used FROM events) e WHERE used <= 300", plain=True)
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fit_lines(load(spark, sf_dir, "events"), 300, "user_id", "event_id", "props").select("user_id", "event_id")


@query("""SELECT user_id, event_id, role FROM (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'system' END AS role,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) e WHERE n <= 12 AND role IN ('user', 'assistant')""", plain=True)
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant").otherwise("system")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", role.alias("role"), F.col("props").alias("text"))
    return views.clean_messages(rows, "user_id", "event_id").select("user_id", "event_id", "role")


# -- events ----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
  g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
  SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 7200000000 AS due, count(*) AS n FROM g GROUP BY user_id, run""", plain=True)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = changes.debounce(load(spark, sf_dir, "events"), gap="2 hours", keys=("user_id",))
    return runs.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("due").alias("due"), "n")


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS f, CAST(length(props) AS BIGINT) AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  walk AS (SELECT user_id, event_id, f, l, n, false AS grew FROM p WHERE n = 1 UNION ALL SELECT p.user_id, p.event_id, CASE WHEN p.f > w.f OR p.l > w.l THEN p.f ELSE w.f END,
    CASE WHEN p.f > w.f OR p.l > w.l THEN p.l ELSE w.l END, p.n, p.f > w.f OR p.l > w.l FROM walk w JOIN p ON p.user_id = w.user_id AND p.n = w.n + 1)
  SELECT user_id, event_id FROM walk WHERE grew""", plain=True)
def growth_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = load(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("file_count"), F.length("props").cast("bigint").alias("line_count"))
    return changes.growth_triggers(polls, "user_id", "event_id", chunk=1000).select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100", plain=True)
def activity_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.activity_ring(load(spark, sf_dir, "events")).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value <= 10) AS errors, round(avg(value), 6) AS mean_duration FROM events GROUP BY event_type", plain=True)
def activity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("value") > 10).alias("ok"), F.col("value").alias("duration"))
    return changes.activity_stats(rows, "event_type").withColumn("mean_duration", F.round("mean_duration", 6))


@query("SELECT item_id, CASE WHEN length(passage) > 120 THEN concat(left(passage, 117), '...') ELSE passage END AS passage FROM eval_items", plain=True)
def truncate_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.summarize_args(load(spark, sf_dir, "eval_items").select("item_id", "passage"), "passage")


@query("SELECT user_id, arg_max(event_type, ts) AS change FROM events GROUP BY user_id", plain=True)
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("change"), "ts")
    return changes.latest_changes(rows, "user_id").withColumnRenamed("path", "user_id")


# -- exports ---------------------------------------------------------------------------------------------------------

_PROPS = "concat('{', concat_ws(', ', concat('churn: ', churn), concat('complexity: ', complexity), concat('file_path: ''', file_path, ''''), concat('id: ''', node_id, ''''), concat('kind: ''', kind, ''''), concat('name: ''', name, ''''), concat('node_type: ''', node_type, ''''), concat('qualified_name: ''', qualified_name, ''''), concat('region: ', region)), '}')"
for _c in ("churn", "complexity", "kind", "name", "qualified_name", "region"):
    _PROPS = _PROPS.replace(f"concat('{_c}: ', {_c})", f"('{_c}: ' || {_c})").replace(f"concat('{_c}: ''', {_c}, '''')", f"('{_c}: ''' || {_c} || '''')")


@query(f"SELECT node_id, concat('CREATE (:', upper(left(node_type, 1)), substr(node_type, 2), ' ', {_PROPS}, ');') AS statement FROM nodes")
def cypher_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.cypher_nodes(projection.graph(spark, sf_dir))


@query("SELECT source, target, edge_type, concat('MATCH (a {id: ''', source, '''}), (b {id: ''', target, '''}) CREATE (a)-[:', upper(edge_type), ' {edge_type: ''', edge_type, '''}]->(b);') AS statement FROM edges")
def cypher_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.cypher_edges(projection.graph(spark, sf_dir))


@query("""SELECT source, target, concat('<edge source="', source, '" target="', target, '"><data key="edge_type">', max(edge_type), '</data></edge>') AS element FROM edges GROUP BY source, target""")
def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.graphml_edges(projection.graph(spark, sf_dir))


@query("SELECT node_id AS id, coalesce(CASE node_type WHEN 'file' THEN file_path ELSE coalesce(qualified_name, name) END, node_id) AS label, node_id AS title, '#888888' AS color FROM nodes")
def vis_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.vis_nodes(projection.graph(spark, sf_dir))


_NOTE = lambda c: f"coalesce(nullif(left(replace(regexp_replace({c}, '[\\\\/:*?\"<>|]', '-', 'g'), ' ', '-'), 120), ''), 'note')"
_LINK = f"concat('- [[Symbols/', {_NOTE('label')}, '|', label, ']]')"


@query(f"""WITH named AS (SELECT node_id, node_type, coalesce(qualified_name, name) AS label FROM nodes),
  inside AS (SELECT e.source AS node_id, string_agg(DISTINCT {_LINK}, chr(10) ORDER BY {_LINK}) AS list_ FROM edges e JOIN named n ON n.node_id = e.target WHERE e.edge_type = 'contains' AND n.node_type = 'symbol' GROUP BY 1),
  files AS (SELECT node_id, file_path, churn, CASE lower(regexp_extract(file_path, '(\\.[^.]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' END AS language FROM nodes WHERE node_type = 'file')
  SELECT {_NOTE('file_path')} AS name, concat('# ', file_path, chr(10), chr(10), '- language: `', coalesce(language, 'unknown'), '`', chr(10), '- churn: ', coalesce(churn, 0), chr(10), chr(10), '## Symbols', chr(10), chr(10),
    coalesce(list_, '_No symbols parsed._'), chr(10), chr(10), '## Imports', chr(10), chr(10), '_No imports detected._', chr(10), chr(10), '## Incoming calls', chr(10), chr(10), '_No cross-file callers detected._', chr(10)) AS body
  FROM files LEFT JOIN inside USING (node_id)""")
def file_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return exports.file_notes(PropertyGraph(g.nodes.withColumn("language", paths.language("file_path")), g.edges))


@query(f"SELECT {_NOTE('label')} AS name, count(*) AS n FROM (SELECT DISTINCT coalesce(qualified_name, name) AS label, kind, file_path, complexity FROM nodes WHERE node_type = 'symbol') s WHERE label IS NOT NULL GROUP BY 1")
def symbol_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of symbol notes with the lines of each."""
    return exports.symbol_notes(projection.graph(spark, sf_dir)).select("name", (F.size(F.split("body", "\n")) - 3).cast("bigint").alias("n"))


@query("""SELECT node_id, concat('<node id="', node_id, '">', CASE WHEN churn IS NULL THEN '' ELSE concat('<data key="churn">', churn, '</data>') END, CASE WHEN complexity IS NULL THEN '' ELSE concat('<data key="complexity">', complexity, '</data>') END,
  CASE WHEN file_path IS NULL THEN '' ELSE concat('<data key="file_path">', file_path, '</data>') END, CASE WHEN kind IS NULL THEN '' ELSE concat('<data key="kind">', kind, '</data>') END, CASE WHEN name IS NULL THEN '' ELSE concat('<data key="name">', name, '</data>') END,
  concat('<data key="node_type">', node_type, '</data>'), CASE WHEN qualified_name IS NULL THEN '' ELSE concat('<data key="qualified_name">', qualified_name, '</data>') END, CASE WHEN region IS NULL THEN '' ELSE concat('<data key="region">', region, '</data>') END, '</node>') AS element FROM nodes""")
def graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.graphml_nodes(projection.graph(spark, sf_dir))


@query("SELECT source AS \"from\", target AS \"to\", edge_type AS label, 'to' AS arrows FROM edges")
def vis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.vis_edges(projection.graph(spark, sf_dir))


@query("SELECT node_id, coalesce(CASE node_type WHEN 'file' THEN file_path ELSE coalesce(qualified_name, name) END, node_id) AS label FROM nodes")
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).nodes.select("node_id", views.node_label().alias("label"))


@query("SELECT node_id FROM nodes WHERE contains(lower(coalesce(CASE node_type WHEN 'file' THEN file_path ELSE coalesce(qualified_name, name) END, node_id)), 'part_1') OR contains(lower(node_id), 'part_1') ORDER BY node_id LIMIT 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.first_match(projection.graph(spark, sf_dir), "Part_1")


_SHOWN = "WITH shown AS (SELECT node_id FROM nodes ORDER BY CASE node_type WHEN 'file' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END, node_id LIMIT 2500) "


@query(_SHOWN + "SELECT source, target, edge_type FROM edges WHERE source IN (SELECT node_id FROM shown) AND target IN (SELECT node_id FROM shown) ORDER BY source, target, edge_type LIMIT 6000")
def full_view_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.full_view(projection.graph(spark, sf_dir))[1]


@query(_DEGREES + f"SELECT node_id, n.node_type, coalesce(CASE n.node_type WHEN 'file' THEN file_path ELSE coalesce(qualified_name, name) END, node_id) AS label, file_path, kind, complexity, churn, in_degree + out_degree AS degree FROM deg JOIN nodes n USING (node_id) WHERE node_id = {_MOST}")
def compact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return views.compact_nodes(g, g.nodes.where(F.col("node_id") == _most_used(g)))


# -- primitives, the store, builds -------------------------------------------------------------------------------------


@query(f"""SELECT node_id, (SELECT count(*) FROM edges WHERE target = node_id) AS in_degree, (SELECT count(*) FROM edges WHERE source = node_id) AS out_degree,
  EXISTS (SELECT 1 FROM edges WHERE source = node_id AND target = node_id) AS has_loop, true AS has_node, false AS has_other FROM nodes WHERE node_id = {_MOST}""")
def node_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    at = _most_used(g)
    row = (at, g.in_degree(at), g.out_degree(at), g.has_edge(at, at), g.has_node(at), g.has_node("no such node"))
    return spark.createDataFrame([row], "node_id string, in_degree bigint, out_degree bigint, has_loop boolean, has_node boolean, has_other boolean")


_SHOW = ("node_type", "file_path", "name", "kind", "complexity", "churn")


@query(f"SELECT node_id, {', '.join(_SHOW)} FROM nodes WHERE node_id = {_MOST}")
def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    at = _most_used(g)
    got = g.get_node(at)
    return spark.createDataFrame([(at, *(got.get(c) for c in _SHOW))], "node_id string, node_type string, file_path string, name string, kind string, complexity bigint, churn bigint")


@query(f"SELECT source, target, min(edge_type) AS edge_type FROM edges WHERE target = {_MOST} AND source = (SELECT min(source) FROM edges WHERE target = {_MOST}) GROUP BY 1, 2")
def edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    at = _most_used(g)
    first = g.in_edges(at).agg(F.min("source")).first()[0]
    return spark.createDataFrame([(first, at, g.get_edge(first, at)["edge_type"])], "source string, target string, edge_type string")


@query("SELECT DISTINCT target AS node_id FROM edges WHERE source = (SELECT source FROM (SELECT source, count(*) AS n FROM edges GROUP BY 1) t ORDER BY n DESC, source LIMIT 1)")
def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    top = g.edges.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    return g.neighbors(top[0] if top else "")


@query(f"SELECT node_id, CASE WHEN node_id = {_MOST} THEN 99 ELSE churn END AS churn FROM nodes")
def attribute_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return g.set_node_attr(_most_used(g), "churn", 99).nodes.select("node_id", "churn")


_GONE = "SELECT node_id FROM nodes WHERE file_path LIKE 'asia/%'"


@query(f"SELECT edge_type, count(*) AS n FROM edges WHERE source NOT IN ({_GONE}) AND target NOT IN ({_GONE}) GROUP BY edge_type")
def files_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return g.remove_nodes(g.nodes.where("file_path like 'asia/%'")).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(node_type, '-') AS node_type, count(*) AS n FROM (SELECT node_type FROM nodes UNION ALL SELECT NULL FROM nodes WHERE node_type = 'file') t GROUP BY 1")
def edges_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from every file to a node that is not there yet."""
    g = projection.graph(spark, sf_dir)
    new = g.nodes.where("node_type = 'file'").select(F.col("node_id").alias("source"), F.concat(F.lit("new:"), "node_id").alias("target"), F.lit("calls").alias("edge_type"))
    return g.add_edges(new.unionByName(new)).nodes.groupBy(F.coalesce("node_type", F.lit("-")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT node_id, CASE WHEN node_type = 'file' THEN 'seen' ELSE name END AS name, CASE WHEN node_type = 'file' THEN NULL ELSE churn END AS churn FROM nodes")
def nodes_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file replaced by a node with another name and nothing else."""
    g = projection.graph(spark, sf_dir)
    new = g.nodes.where("node_type = 'file'").select("node_id", "node_type", F.lit("seen").alias("name"))
    return g.add_nodes(new).nodes.select("node_id", "name", "churn")


def _recorded(spark: SparkSession, sf_dir: str) -> timeline.Timeline:
    """A store of two snapshots: all nodes, then those outside Asia with a greater churn."""
    store = timeline.Timeline(spark, f"{work_dir(spark)}/timeline-{uuid.uuid4().hex}")
    g = projection.graph(spark, sf_dir)
    store.record(g, "all", 1.0)
    kept = g.nodes.where("file_path is null or file_path not like 'asia/%'").withColumn("churn", F.col("churn") + 1)
    store.record(PropertyGraph(kept, g.edges.where("edge_type = 'contains'")), "less", 2.0)
    return store


@query(f"""SELECT 1 AS snapshot_id, 'all' AS label, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count
  UNION ALL SELECT 2, 'less', (SELECT count(*) FROM nodes WHERE node_id NOT IN ({_GONE})), (SELECT count(*) FROM edges WHERE edge_type = 'contains')""")
def recorded_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir).snapshots().select("snapshot_id", "label", "node_count", "edge_count")


@query(f"SELECT node_id, node_type, churn + 1 AS churn FROM nodes WHERE node_id NOT IN ({_GONE})")
def loaded_snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir).load().nodes.select("node_id", "node_type", "churn")


@query(f"""SELECT 'nodes' AS part, CASE WHEN node_id IN ({_GONE}) THEN 'removed' ELSE 'modified' END AS kind, count(*) AS n FROM nodes GROUP BY 1, 2
  UNION ALL SELECT 'edges', 'removed', count(*) FROM (SELECT DISTINCT source, target FROM edges WHERE edge_type <> 'contains') e""")
def recorded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.delta_counts(*_recorded(spark, sf_dir).delta(1, 2))


_BUILT = """WITH s AS (SELECT * FROM parsed_symbols WHERE qualified_name IS NOT NULL), i AS (SELECT * FROM parsed_inheritance WHERE base IS NOT NULL),
  ids AS (SELECT DISTINCT concat('symbol:', path, ':', qualified_name) AS node_id, path, name FROM s)"""


def _built(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the given parse rows: symbols, an import of every base by its file, and bases."""
    symbols = load(spark, sf_dir, "parsed_symbols").where("qualified_name is not null")
    bases = load(spark, sf_dir, "parsed_inheritance").where("base is not null")
    imports = bases.select("path", F.col("base").alias("module"), F.coalesce("line", F.lit(0)).alias("start_line"))
    calls = spark.createDataFrame([], "path string, caller string, callee string, line int")
    files = load(spark, sf_dir, "file_records").select("path").distinct()
    return build.build(files, symbols.select("path", "name", "kind", "start_line", "end_line", "docstring", "complexity", "qualified_name"), imports, bases, calls)


@query(_BUILT + """ SELECT 'file' AS node_type, (SELECT count(DISTINCT coalesce(path, '')) FROM file_records) AS n UNION ALL SELECT 'symbol', (SELECT count(DISTINCT node_id) FROM ids)
  UNION ALL SELECT 'import', (SELECT count(*) FROM (SELECT DISTINCT path, base, coalesce(line, 0) FROM i) x) UNION ALL SELECT 'proxy', (SELECT count(*) FROM (SELECT DISTINCT path, base FROM i) y)""", plain=True)
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(_BUILT + """, named AS (SELECT DISTINCT node_id, path, name FROM (SELECT concat('symbol:', path, ':', qualified_name) AS node_id, path, name, row_number() OVER (PARTITION BY path, qualified_name ORDER BY start_line DESC) AS r FROM s) x WHERE r = 1)
  SELECT 'contains' AS edge_type, (SELECT count(*) FROM s) AS n UNION ALL SELECT 'imports', (SELECT count(*) FROM i) UNION ALL SELECT 'inherits', (SELECT count(*) FROM i JOIN named ON named.path = i.path AND named.name = i.class_name)""", plain=True)
def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT concat('proxy:', file_path, ':', fqn) AS node_id, CASE WHEN fqn IN ({_REMOVED}) THEN true END AS is_broken FROM ({_CONSUMES}) c", plain=True)
def proxies_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    consumes = _consumes(spark, sf_dir)
    proxies = consumes.select(F.concat(F.lit("proxy:"), "file_path", F.lit(":"), "fqn").alias("node_id"), F.lit("proxy").alias("node_type"))
    return resolution.flag_broken(PropertyGraph(proxies, proxies), _removed(spark, sf_dir), consumes).nodes.select("node_id", "is_broken")


@query("SELECT path, arg_max(sha256, mtime) AS sha256 FROM file_records WHERE path IS NOT NULL AND mtime IS NOT NULL GROUP BY path HAVING count(DISTINCT (mtime, sha256)) = count(DISTINCT mtime)", plain=True)
def fingerprint_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints kept for the next scan, where the newest record is unambiguous."""
    records = load(spark, sf_dir, "file_records").where("path is not null and mtime is not null")
    clear = records.groupBy("path").agg(F.count_distinct(F.struct("mtime", F.coalesce("sha256", F.lit("")))).alias("a"), F.count_distinct("mtime").alias("b")).where("a = b").select("path")
    return build.updated_cache(records).join(clear, "path", "left_semi").select("path", "sha256")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
