import random
import time

from pyspark.sql import functions as F

from cairn.operators import communities, intelligence as i, queries as q, resolution, views
from cairn.operators.graph import PropertyGraph, simple_cycles, strongly_connected_components

NODE = "node_id string, node_type string, file_path string, name string, qualified_name string, kind string, complexity long, churn long"


def graph(spark, nodes, edges):
    rows = [(n[0], *n[1:], *[None] * (8 - len(n))) for n in nodes]
    return PropertyGraph(spark.createDataFrame(rows, NODE), spark.createDataFrame(edges, "source string, target string, edge_type string"))


def files(*names):
    return [(f"file:{n}.py", "file", f"{n}.py") for n in names]


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_primitives(spark):
    g = graph(spark, [(x, "file") for x in "ABC"], [("A", "B", "calls"), ("B", "A", "calls"), ("B", "C", "calls")])
    assert g.in_degree("B") == 1 and ids(g.neighbors("B")) == ["A", "C"] and g.has_edge("A", "B") and not g.has_edge("C", "A") and not g.has_node("Z")
    assert {tuple(r) for r in g.strongly_connected_components().collect()} == {("A", "A"), ("B", "A"), ("C", "C")}
    less = g.remove_nodes(spark.createDataFrame([("C",)], "node_id string"))
    assert (less.number_of_nodes(), less.number_of_edges()) == (2, 2)
    more = g.add_edges(spark.createDataFrame([("A", "new", "calls")], "source string, target string, edge_type string"))
    assert more.has_node("new") and more.get_node("new") == {} and more.get_edge("A", "new") == {"edge_type": "calls"}
    assert g.set_node_attr("A", "name", "x").get_node("A")["name"] == "x"
    up = g.add_nodes(spark.createDataFrame([("A", "symbol")], "node_id string, node_type string"))
    assert up.get_node("A") == {"node_type": "symbol"} and up.number_of_nodes() == 3
    for bad in (lambda: g.get_node("Z"), lambda: g.get_edge("A", "C")):
        try:
            bad()
        except KeyError:
            continue
        raise AssertionError
    assert g.node_link().count() == 6 and len(g.to_pandas()[0]) == 3 and PropertyGraph.empty(spark).number_of_nodes() == 0


def test_components_and_cycles_agree_at_every_size(spark):
    rnd = random.Random(7)
    arcs = spark.createDataFrame([(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(85)], "source string, target string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(60)], "node_id string")
    whole = {tuple(r) for r in strongly_connected_components(nodes, arcs).collect()}
    assert whole == {tuple(r) for r in strongly_connected_components(nodes, arcs, task_arcs=3).collect()} and len(whole) == 60
    comp = strongly_connected_components(nodes, arcs)
    assert {tuple(r.path) for r in simple_cycles(arcs, comp, 6).collect()} == {tuple(r.path) for r in simple_cycles(arcs, comp, 6, task_arcs=1).collect()}


def test_dead_code(spark):
    sym = lambda n, qn=None, kind="function", path="a.py": (f"symbol:{path}:{qn or n}", "symbol", path, n, qn or n, kind)
    nodes = [sym("used"), sym("lone"), sym("main"), sym("__init__"), sym("add_node", "Graph.add_node"), sym("_unused", "Graph._unused"), sym("calls_only"), sym("v", path="vendor/x.py")]
    g = graph(spark, nodes, [("symbol:a.py:calls_only", "symbol:a.py:used", "calls")])
    assert ids(i.dead_code(g)) == ["symbol:a.py:Graph._unused", "symbol:a.py:lone"]
    assert ids(i.dead_code(g, include_public_api=True, include_generated=True)) == ["symbol:a.py:Graph._unused", "symbol:a.py:Graph.add_node", "symbol:a.py:lone", "symbol:vendor/x.py:v"]


def test_god_entry_orphan(spark):
    assert ids(i.god_nodes(graph(spark, [], [("x", "y", "calls")]))) == []
    assert [tuple(r) for r in i.god_nodes(graph(spark, files("a"), [])).collect()] == [("file:a.py", 0.0)]
    g = graph(spark, [*files("alpha", "beta"), ("symbol:alpha.py:main", "symbol", "alpha.py", "main", "main", "function")], [("file:beta.py", "file:alpha.py", "imports")])
    assert ids(i.entry_points(g)) == ["file:beta.py", "symbol:alpha.py:main"]
    assert ids(i.orphan_modules(g)) == [] and ids(i.orphan_modules(graph(spark, files("a", "b"), [("q", "r", "calls")]))) == ["a.py", "b.py"]
    assert ids(i.orphan_modules(graph(spark, files("solo"), [("q", "r", "calls")]))) == []
    both = graph(spark, files("a", "b"), [("file:a.py", "file:b.py", "imports"), ("file:b.py", "file:a.py", "imports")])
    assert [r.path for r in i.circular_dependencies(i.file_import_graph(both)).collect()] == [["a.py", "b.py"]]


def test_communities(spark):
    clique = lambda p: [(f"{p}{a}", f"{p}{b}") for a in range(4) for b in range(a)]
    arcs = spark.createDataFrame([*clique("l"), *clique("r"), ("l0", "r0")], "source string, target string")
    nodes = spark.createDataFrame([(f"{p}{k}",) for p in "lr" for k in range(4)] + [("alone",)], "node_id string")
    got = {r.node_id: r.community_id for r in communities.communities(nodes, arcs).collect()}
    assert len(got) == 9 and len({got[f"l{k}"] for k in range(4)}) == 1 and len(set(got.values())) == 3
    bridges = i.bridge_nodes(arcs, spark.createDataFrame(list(got.items()), "node_id string, community_id long"))
    assert ids(bridges) == ["l0"]
    assert communities.modularity(arcs, spark.createDataFrame(list(got.items()), "node_id string, community_id long")) > 0.4


def test_communities_are_as_good_by_joins(spark):
    """Planted communities of 12 nodes in one component: levels of moves by joins find what one task finds, a modularity at most 0.05 lower."""
    rnd = random.Random(3)
    arcs = [(f"n{a}", f"n{b}") for a in range(144) for b in range(a) if rnd.random() < (0.6 if a // 12 == b // 12 else 0.01)]
    edges, nodes = spark.createDataFrame(arcs, "source string, target string"), spark.createDataFrame([(f"n{k}",) for k in range(144)] + [("lone",)], "node_id string")
    whole = communities.communities(nodes, edges)
    joined = communities.communities(nodes, edges, group_edges=100)
    q = communities.modularity(edges, whole)
    assert joined.count() == whole.count() == 145 and q > 0.6 and communities.modularity(edges, joined) > q - 0.05


def test_many_communities_in_one_task_take_linear_time(spark):
    """A ring of 150,000 nodes is one component of tens of thousands of communities."""
    n = 150_000
    edges = spark.range(n).select(F.format_string("n%06d", "id").alias("source"), F.format_string("n%06d", (F.col("id") + 1) % n).alias("target"))
    began = time.perf_counter()
    found = communities.communities(edges.select(F.col("source").alias("node_id")), edges).toPandas()
    assert time.perf_counter() - began < 60
    assert len(found) == n and found["community_id"].nunique() > 100 and communities.modularity(edges, spark.createDataFrame(found)) > 0.98


def test_connected_components_agree_at_every_size(spark):
    rnd = random.Random(5)
    arcs = [(f"n{rnd.randrange(90)}", f"n{rnd.randrange(90)}") for _ in range(50)] + [(f"m{k:02d}", f"m{k + 1:02d}") for k in range(40)]
    edges, nodes = spark.createDataFrame(arcs, "source string, target string"), spark.createDataFrame([(x,) for e in arcs for x in e] + [("lone",)], "node_id string")
    whole = sorted(tuple(r) for r in communities.components(nodes, edges).collect())
    assert whole == sorted(tuple(r) for r in communities.components(nodes, edges, task_edges=3).collect())
    assert ("lone", "lone") in whole and ("m40", "m00") in whole and len(whole) == len({x for e in arcs for x in e}) + 1


def test_clustering_graph_and_annotation(spark):
    g = graph(spark, [*files("a", "b", "c"), ("symbol:a.py:f", "symbol", "a.py", "f"), ("symbol:b.py:g", "symbol", "b.py", "g")], [("symbol:a.py:f", "symbol:b.py:g", "calls")])
    nodes, links = communities.clustering_graph(g)
    assert ids(nodes) == ["file:a.py", "file:b.py", "file:c.py"] and [tuple(sorted(r)) for r in links.collect()] == [("file:a.py", "file:b.py")]
    got = {r.node_id: (r.community_id, r.is_bridge) for r in communities.annotate(g).nodes.collect()}
    assert got["symbol:a.py:f"][0] == got["file:a.py"][0] == got["file:b.py"][0] != got["file:c.py"][0] and not any(b for _, b in got.values())
    only = graph(spark, [("symbol:x", "symbol", None, "x")], [])
    assert ids(communities.clustering_graph(only)[0]) == ["symbol:x"] and communities.clustering_graph(only)[1].count() == 0


def test_resolution(spark):
    f = spark.createDataFrame([("pkg/a.py",), ("pkg/b.py",), ("c.py",)], "file_path string")
    index = resolution.module_index(f)
    imports = [("1", "pkg/a.py", "pkg.b"), ("2", "pkg/a.py", ".b"), ("3", "pkg/a.py", "..c"), ("4", "c.py", "nothing.here"), ("5", "c.py", None), ("6", "c.py", " "), ("7", "c.py", "pkg/b.py")]
    got = {tuple(r) for r in resolution.resolve_modules(spark.createDataFrame(imports, "node_id string, file_path string, module string"), index).collect()}
    assert got == {("1", "pkg/b.py"), ("2", "pkg/b.py"), ("3", "c.py"), ("7", "pkg/b.py")}
    symbols = spark.createDataFrame([("s1", "symbol", "a.py", "f", "A.f", 2), ("s2", "symbol", "a.py", "f", "B.f", 1), ("s3", "symbol", "a.py", "g", "g", 3)], "node_id string, node_type string, file_path string, name string, qualified_name string, seq long")
    calls = spark.createDataFrame([("a.py", "g", "f", 1), ("a.py", "g", "A.f", 2), ("a.py", "nobody", "h", 3)], "file_path string, caller string, callee string, line int")
    edges, proxies = resolution.resolve_calls(calls, symbols)
    assert {(r.source, r.target) for r in edges.collect()} == {("s3", "s2"), ("s3", "s1")} and ids(proxies) == ["proxy:a.py:h"]


def test_queries_and_views(spark):
    nodes = [*files("a", "b"), ("symbol:a.py:f", "symbol", "a.py", "f", "f", "function", 3, 1)]
    g = graph(spark, nodes, [("file:a.py", "symbol:a.py:f", "contains"), ("symbol:a.py:f", "file:b.py", "calls"), ("symbol:a.py:f", "symbol:a.py:f", "calls")])
    assert ids(q.search_nodes(g, "A.PY")) == ["file:a.py", "symbol:a.py:f"] and q.get_neighbors(g, "symbol:a.py:f").count() == 4
    for bad in (lambda: q.search_nodes(g, " "), lambda: q.query_graph(g, limit=0), lambda: q.get_neighbors(g, "x", "up")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
    assert [tuple(r) for r in views.file_level_view(g).collect()] == [("file:a.py", "file:b.py", "calls")]
    assert [tuple(r) for r in views.collapsed_weights(g).collect()] == [("file:a.py", "file:b.py", 1, 2.0)]
    text = views.graph_context(g, "file:a.py", "minimal")
    assert "## The chosen node" in text and len(text) <= 1_800 and views.context_profile("media")["nodes"] == 16 and views.context_profile("odd")["nodes"] == 8
    assert q.statistics(g).first().file_count == 2 and q.symbol_count(g) == 1 and q.symbol_count(g, "b.py") == 0 and ids(q.file_metadata(g, "b.py")) == ["file:b.py"]


def test_long_cycles_are_found(spark):
    ring = [(f"n{i:03d}", f"n{(i + 1) % 70:03d}") for i in range(70)]
    rows = i.circular_dependencies(spark.createDataFrame(ring, "source string, target string")).collect()
    assert [(r.path, r.length) for r in rows] == [([a for a, _ in ring], 70)]
