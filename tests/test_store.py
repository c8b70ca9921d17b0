import json
import os
import random

from cairn import schemas
from cairn.operators import build
from cairn.operators.graph import PropertyGraph
from cairn.operators.queries import GraphStore
from cairn.operators.timeline import Timeline
from cairn.sources import documents, exports, extract, workspace
from cairn.sources.ignore import IgnoreMatcher
from cairn.streaming import changes

EDGES = "source string, target string, edge_type string"


def graph(spark, nodes, edges=()):
    rows = spark.createDataFrame([(*n, *[None] * (5 - len(n))) for n in nodes], "node_id string, node_type string, file_path string, churn long, qualified_name string")
    return PropertyGraph(schemas.nodes(rows), schemas.edges(spark.createDataFrame(list(edges), EDGES)))


def test_timeline(spark, tmp_path):
    t = Timeline(spark, str(tmp_path))
    assert t.latest() is None and t.load().number_of_nodes() == 0
    a = ("file:a.py", "file", "a.py", 0)
    assert t.record(graph(spark, [a]), "first", 1.0) == 1
    s = ("symbol:a.py:f", "symbol", "a.py", 0, "f")
    assert t.record(graph(spark, [("file:a.py", "file", "a.py", 1), s], [("file:a.py", s[0], "contains")] * 2), None, 2.0) == 2
    assert t.record(graph(spark, [("file:a.py", "file", "a.py", 1)])) == 3
    nodes, edges = t.delta(1, 2)
    assert {tuple(r) for r in nodes.collect()} == {("file:a.py", "modified"), (s[0], "added")} and edges.count() == 1
    assert t.load(2).number_of_edges() == 1 and t.snapshots().where("snapshot_id = 2").first().edge_count == 2
    assert t.history("file:a.py").count() == 3 and t.churn_rate("a.py") == 0.5 and t.churn_rate("a.py", 2, 1) == 1.0 and t.churn_rate("none.py") == 0.0
    store = GraphStore(t)
    assert store.summary()["data"]["node_count"] == 1 and store.get_node("zz")["status"] == "error" and store.get_changes(0, 1)["status"] == "error"
    assert GraphStore(t, 0.001)._answer(lambda g: g.nodes.crossJoin(spark.range(10**10)).selectExpr("sum(id) s"))["error"].startswith("timed out")
    assert store.search_nodes("A.PY")["data"][0]["node_id"] == "file:a.py" and store.get_churn("a.py")["data"]["rate"] == 0.5 and store.get_timeline()["data"]["count"] == 3
    assert store.get_dead_code()["data"] == [] and store.get_circular_deps()["data"] == [] and store.get_entry_points()["data"] == [{"node_id": "file:a.py"}]
    assert store.get_god_nodes()["status"] == store.get_complexity()["status"] == store.query_graph(limit=5)["status"] == store.get_neighbors("file:a.py")["status"] == "ok"


def test_ignore():
    m = IgnoreMatcher({"": ["*.log", "build/", "!keep.log", "/target", "docs/*.txt"], "sub": ["*.tmp", "/only.py", "!important.log"]})
    ignored = ["a.log", "x/y/a.log", "build/a.py", "x/build/b.py", "target", "target/z", "docs/a.txt", "sub/a.tmp", "sub/d/a.tmp", "sub/only.py", "node_modules/x.js", "a.pyc", ".git/config"]
    kept = ["keep.log", "x/target", "docs/d/a.txt", "a.tmp", "sub/d/only.py", "sub/important.log", "", "src/a.py", "builder/a.py"]
    assert [p for p in ignored if not m.is_ignored(p)] == [] and [p for p in kept if m.is_ignored(p)] == []
    assert m.is_ignored("build", True) and not m.is_ignored("build")


def test_ignore_files_of_the_caller(tmp_path):
    (tmp_path / "own").write_text("# none\n*.bin\n!keep.bin\n")
    m = IgnoreMatcher.from_file(str(tmp_path / "own"), ("/top",))
    assert m.is_ignored("a/x.bin") and not m.is_ignored("a/keep.bin") and m.is_ignored("top") and not m.is_ignored("a/top") and not IgnoreMatcher.from_file(str(tmp_path / "none")).is_ignored("a")
    m.ignore_file(str(tmp_path), str(tmp_path / "cache" / "scan.db"))
    m.ignore_file(str(tmp_path), "/elsewhere/other.db")
    assert m.is_ignored("cache/scan.db") and not m.is_ignored("a/cache/scan.db") and not m.is_ignored("elsewhere/other.db")


def test_dumps_and_vault(spark, tmp_path):
    t = Timeline(spark, str(tmp_path / "t"))
    s, r = ("symbol:a.py:f", "symbol", "a.py", 1, "f"), ("symbol:b.py:g", "symbol", "b.py", 1, "g")
    f = [("file:a.py", "file", "a.py", 0), ("file:b.py", "file", "b.py", 0)]
    g = graph(spark, [*f, s, r], [("file:a.py", s[0], "contains"), (r[0], "file:a.py", "calls")])
    t.record(graph(spark, f), "one", 1.0)
    t.record(g, "two", 2.0)
    lines = lambda *a, **k: [json.loads(x) for x in exports.dumps(t, *a, **k)]
    assert [x["label"] for x in lines("timeline")] == ["one", "two"] and len(lines("changes", snapshot_from=1, snapshot_to=2)) == 4 and {x["rate"] for x in lines("churn")} == {0.0}
    exports.export_obsidian(g, str(tmp_path / "vault"))
    note = (tmp_path / "vault" / "Files" / "a.py.md").read_text()
    assert "[[Symbols/f|f]]" in note and "[[Symbols/g|g]]" in note.split("## Incoming calls")[1] and exports.NO_CALLERS in (tmp_path / "vault" / "Files" / "b.py.md").read_text()
    assert "[[Files/b.py|b.py]]" in (tmp_path / "vault" / "Symbols" / "g.md").read_text() and (tmp_path / "vault" / "Index.md").read_text() == "# Index\n\n- [[Files/a.py]]\n- [[Files/b.py]]\n"
    exports.export_obsidian(graph(spark, []), str(tmp_path / "none"))
    assert (tmp_path / "none" / "Index.md").read_text() == "# Index\n\n"


def test_workspace(spark, tmp_path):
    files = {"main.py": "a\nb\n", "utils.py": "x\ny", "pkg/__init__.py": "", ".gitignore": "*.log\nignored/\n", "n.log": "no\n", "ignored/x.py": "no"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    got = workspace.read_workspace(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == [".gitignore", "main.py", "pkg/__init__.py", "utils.py"]
    assert tuple(workspace.metrics(got).first()) == (4, 6)
    records, change = workspace.scan(spark, str(tmp_path))
    cache = build.updated_cache(records).cache()
    assert cache.count() == 4 and {r.change for r in change.collect()} == {"added"}
    (tmp_path / "main.py").write_text("changed")
    (tmp_path / "new.py").write_text("")
    os.remove(tmp_path / "utils.py")
    got = {r.path: r.change for r in workspace.scan(spark, str(tmp_path), cache)[1].collect()}
    assert got == {"main.py": "modified", "new.py": "added", "utils.py": "deleted", ".gitignore": "unchanged", "pkg/__init__.py": "unchanged"}
    info = workspace.workspace_info(spark, str(tmp_path))
    assert info["ignore_files"] == [".gitignore"] and [r.path for r in info["directories"].collect()] == ["pkg"]
    assert workspace.read_workspace(spark, str(tmp_path / "none")).count() == 0 and workspace.metrics_increased((1, 1), (1, 2)) and not workspace.metrics_increased((2, 2), (2, 1))


SOURCES = {
    "a.py": 'import os\nfrom .b import x as y, z\nclass A(m.Base, B[int]):\n    """D"""\n    def f(self):\n        "doc"\n        if self.g(x) and y:\n            return helper(1)\n',
    "b.js": "import d, { e as f } from './m';\n// Says it.\nexport class C extends D { run(a) { if (a && go(a)) { return 'x{'; } } }\nconst k = (z) => { call(z); };\nfunction g() {}\n",
    "c.ts": "export class T implements I { get(x: number): string { return String(x); } }",
    "d.go": 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype S struct {\n\tA int\n}\n// Doc of M.\nfunc (s *S) M(a int) int {\n\tfmt.Println(a)\n\treturn f(a)\n}\n',
    "e.rs": "use std::io::{self, Read};\nstruct P { a: u8 }\nimpl Show for P { fn show(&self) -> u8 { helper(self.a) } }\ntrait Q { fn q(&self); }\nfn main() { println!(\"{}\", 'x'); run(); }\n",
    "bad.py": "def ok():\n    return 1\n\ndef broken(:\n    pass\n",
    "f.txt": "nothing",
}


def test_extract(spark):
    df = extract.parse_files(spark.createDataFrame([*SOURCES.items(), (None, "x"), ("z.py", None), ("empty.py", "")], "path string, text string"))
    got = {r.path: r.asDict(True) for r in df.collect()}
    assert sorted(got) == ["a.py", "b.js", "bad.py", "c.ts", "d.go", "e.rs", "empty.py"]
    names = lambda p: {(s["qualified_name"], s["kind"]) for s in got[p]["symbols"]}
    assert names("a.py") == {("A", "class"), ("A.f", "function")} and names("b.js") == {("C", "class"), ("C.run", "method"), ("k", "function"), ("g", "function")}
    assert names("d.go") == {("p.S", "class"), ("p.S.M", "method")} and names("e.rs") == {("P", "class"), ("P.show", "method"), ("Q", "trait"), ("Q.q", "method"), ("main", "function")}
    assert {(b["class_name"], b["base"]) for p in got for b in got[p]["inheritance"]} == {("A", "m.Base"), ("A", "B"), ("C", "D"), ("T", "I"), ("P", "Show")}
    assert got["a.py"]["imports"][1] == {"module": ".b", "names": ["x", "z"], "start_line": 2, "is_relative": True} and [x["module"] for x in got["d.go"]["imports"]] == ["fmt", "a/b"]
    assert ("A.f", "helper") in {(c["caller"], c["callee"]) for c in got["a.py"]["calls"]} and ("p.S.M", "Println") in {(c["caller"], c["callee"]) for c in got["d.go"]["calls"]}
    assert got["bad.py"]["errors"] and [s["name"] for s in got["bad.py"]["symbols"]] == ["ok"] and got["d.go"]["symbols"][1]["docstring"] == "Doc of M."


def test_build_and_update(spark):
    def built(sources):
        parsed = extract.parse_files(spark.createDataFrame(sources, "path string, text string"))
        parts = {w: extract.flatten(parsed, w) for w in ("symbols", "imports", "inheritance", "calls")}
        return build.build(parsed.select("path", "language"), **parts, now=1.0)

    a, b = ("a.py", "from b import g\ndef f():\n    g()\n    h()\ndef h(): pass\n"), ("b.py", "def g(): pass\n")
    g = built([a, b])
    assert {(r.source, r.target) for r in g.edges.where("edge_type = 'calls'").collect()} == {("symbol:a.py:f", "proxy:a.py:g"), ("symbol:a.py:f", "symbol:a.py:h")}
    change = spark.createDataFrame([("a.py", "modified"), ("b.py", "unchanged")], "path string, change string")
    after = build.update(g, change, built([("a.py", "def f2(): pass\n")]), 2.0)
    got = {r.node_id: r for r in after.nodes.collect()}
    assert set(got) == {"file:a.py", "symbol:a.py:f2", "file:b.py", "symbol:b.py:g"} and got["file:a.py"].churn == 1 and got["file:a.py"].first_seen == 1.0 and got["file:b.py"].last_seen == 2.0
    assert {r.edge_type for r in after.edges.collect()} == {"contains"}


def test_exports_and_documents(spark, tmp_path):
    g = graph(spark, [("file:it's.py", "file", "it's.py", 0), ("symbol:x", "symbol", "it's.py", 1, "x\\y")], [("file:it's.py", "symbol:x", "contains")])
    lines = {r.statement for r in exports.cypher_nodes(g).collect()}
    assert "CREATE (:File {churn: 0, file_path: 'it\\'s.py', id: 'file:it\\'s.py', node_type: 'file'});" in lines
    out = exports.export_all(g, str(tmp_path), ["JSON", "graphml", "cypher", "markdown", "obsidian"])
    assert all(os.path.exists(p) for p in out.values()) and "<node id=" in open(out["graphml"]).read()
    back = documents.read_graph_document(spark, out["json"])
    assert back.number_of_nodes() == 2 and back.number_of_edges() == 1 and back.get_node("symbol:x")["qualified_name"] == "x\\y"
    for path, error in ((str(tmp_path / "none.json"), FileNotFoundError), (out["markdown"], ValueError)):
        try:
            documents.read_graph_document(spark, path)
        except error:
            continue
        raise AssertionError(path)
    try:
        exports.export_all(g, str(tmp_path), ["pdf"])
    except ValueError as e:
        assert "pdf" in str(e)


def test_streams(spark, tmp_path):
    events = [("a.py", "created", f"2024-01-01 00:00:{s:02d}") for s in (0, 10, 59)]
    df = spark.createDataFrame(events, "path string, change string, ts string").selectExpr("path", "change", "cast(ts as timestamp) ts")
    assert sorted(r.n for r in changes.debounce(df, gap="30 seconds").collect()) == [1, 2]
    src = str(tmp_path / "in")
    df.write.parquet(src)
    live = changes.debounce(spark.readStream.schema(df.schema).parquet(src), gap="30 seconds", watermark="1 seconds")
    run = live.writeStream.format("memory").queryName("runs").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert [r.n for r in spark.sql("select n from runs").collect()] == [2]
    store, seen = Timeline(spark, str(tmp_path / "store")), []
    parse = lambda paths_: graph(spark, [(f"file:{r.path}", "file", r.path, 0) for r in paths_.collect()])
    for _ in range(2):  # the second run finds nothing new
        job = changes.fold_changes(spark.readStream.schema(df.schema).parquet(src), store, parse, str(tmp_path / "cp"), lambda: 1.0, lambda d, e, n: seen.append((d.count(), e.count())))
        job.processAllAvailable()
        job.stop()
    assert store.latest() == 1 and store.load().has_node("file:a.py") and seen == []
    more = [("b.py", "created", "2024-01-01 00:02:00"), ("a.py", "modified", "2024-01-01 00:02:01"), ("notes.txt", "created", "2024-01-01 00:02:02")]
    spark.createDataFrame(more, "path string, change string, ts string").selectExpr("path", "change", "cast(ts as timestamp) ts").write.mode("append").parquet(src)
    here = lambda: spark.createDataFrame([("b.py",)], "path string")
    job = changes.fold_changes(spark.readStream.schema(df.schema).parquet(src), store, parse, str(tmp_path / "cp"), lambda: 2.0, lambda d, e, n: seen.append(({tuple(r) for r in d.collect()}, e.count())), present=here)
    job.processAllAvailable()
    job.stop()
    assert seen == [({("file:b.py", "added"), ("file:a.py", "removed")}, 0)] and store.latest() == 2  # a.py is gone by now
    whole = Timeline(spark, str(tmp_path / "whole"))
    job = changes.fold_changes(spark.readStream.schema(df.schema).parquet(src), whole, parse, str(tmp_path / "cp2"), lambda: 1.0, rebuild=lambda: graph(spark, [("file:z.py", "file", "z.py", 0)]))
    job.processAllAvailable()
    job.stop()
    assert whole.latest() == 1 and whole.load().has_node("file:z.py")
    polls = spark.createDataFrame([("w", i, f, 1) for i, f in enumerate([2, 2, 3, 1, 3, 4])], "workspace string, poll int, file_count int, line_count int")
    assert sorted(r.poll for r in changes.growth_triggers(polls, chunk=2).collect()) == [2, 5]
    assert changes.envelope(polls.limit(1)).first().status == "ok"


def test_growth_keeps_the_whole_pair(spark):
    """The mark is the pair of the last growth, so a lower count makes later ones count as growth."""
    schema = "workspace string, poll int, file_count int, line_count int"
    few = spark.createDataFrame([("w", i, f, n) for i, (f, n) in enumerate([(2, 10), (3, 5), (3, 6), (3, 6)])] + [("v", 0, None, 1), (None, 1, 1, 1)], schema)
    for chunk in (1, 2, 100):
        assert sorted(r.poll for r in changes.growth_triggers(few, chunk=chunk).collect()) == [1, 2]
    rnd = random.Random(5)
    logs = {w: [(rnd.randrange(12), rnd.randrange(12)) for _ in range(60)] for w in ("a", "b", "c")}
    expected = set()
    for w, pairs in logs.items():
        mark = pairs[0]
        for i, p in enumerate(pairs[1:], 1):
            if p[0] > mark[0] or p[1] > mark[1]:
                expected.add((w, i))
                mark = p
    rows = spark.createDataFrame([(w, i, *p) for w, pairs in logs.items() for i, p in enumerate(pairs)], schema)
    for chunk in (1, 7, 1000):
        assert {(r.workspace, r.poll) for r in changes.growth_triggers(rows, chunk=chunk).collect()} == expected
    assert changes.growth_triggers(rows.limit(0)).count() == 0


def test_store_answers(spark, tmp_path):
    t = Timeline(spark, str(tmp_path))
    store = GraphStore(t)
    assert store.summary()["data"]["empty"] and store.get_timeline("x")["data"]["node_history"] == [] and store.get_changes(1, 2)["data"]["added_nodes"] == []
    assert store.get_churn("a.py")["data"]["rate"] == 0.0 and store.query_graph()["data"] == {"count": 0, "limit": 50, "nodes": [], "empty": True}
    f = [(f"file:{x}.py", "file", f"{x}.py", 1) for x in "abc"]
    t.record(graph(spark, f[:2], [("file:a.py", "file:b.py", "imports")]), "first", 1.0)
    t.record(graph(spark, f[1:], [("file:b.py", "file:c.py", "imports"), ("file:c.py", "file:c.py", "calls")]), "second", 2.0)
    d = store.get_changes(1, 2)["data"]
    assert (d["added_nodes"], d["removed_nodes"], d["modified_nodes"]) == (["file:c.py"], ["file:a.py"], []) and d["removed_edges"] == [("file:a.py", "file:b.py")]
    assert d["added_edges"] == [("file:b.py", "file:c.py"), ("file:c.py", "file:c.py")] and d["counts"]["added_edges"] == 2 and len(store.get_changes(1, 2, limit=1)["data"]["added_edges"]) == 1
    n = store.get_neighbors("file:c.py")["data"]
    assert [(x["node_id"], x["edge"]["edge_type"]) for x in n["incoming"]] == [("file:b.py", "imports"), ("file:c.py", "calls")] and n["incoming"][0]["node"]["file_path"] == "b.py"
    assert [x["node_id"] for x in n["outgoing"]] == ["file:c.py"] and store.get_neighbors("file:c.py", "out")["data"]["incoming"] == []
    g = store.get_graph(include_nodes=True, include_edges=True, limit=1)["data"]
    assert (g["label"], g["latest_snapshot_id"], g["current"], g["node_count"], g["edge_count"]) == ("second", 2, True, 2, 2) and [x["node_id"] for x in g["nodes"]] == ["file:b.py"] and len(g["edges"]) == 1
    h = store.get_timeline("file:a.py")["data"]
    assert h["count"] == 2 and not h["empty"] and [(x["snapshot_id"], x["attrs"]["churn"]) for x in h["node_history"]] == [(1, 1)]
    assert store.get_node("")["error"] == "node_id is required" and store.get_node("zz")["error"] == "no node zz" and store.get_neighbors("zz")["error"] == "no node zz" and store.get_neighbors("file:c.py", "up")["status"] == "error"
    page = store.get_churn(limit=1)
    assert page["more"] and len(page["data"]) == 1 and store.get_entry_points(limit=1, offset=1)["data"] == [] and store.get_complexity(limit=0)["status"] == "error"
