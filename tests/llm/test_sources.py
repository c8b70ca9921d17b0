import random

import pytest

from cairn.llm import documented, handwritten, validity
from cairn.llm.syntax.ecmascript import EcmaScript
from cairn.llm.syntax.go import Go
from cairn.llm.syntax.rust import Rust

P = validity.Parsers()
GOOD = {
    "js": [
        "import a, {b as c} from 'x';\nexport const f = async (a, {b, c=2}, ...r) => { await a; };\nclass A extends B.C { static x = 1; #p; get y() { return this.#p; } async *g() { yield* x; } }",
        "for (const x of y) { if (!x || x.y === null) continue; else { z(); } }\nlabel: for (;;) { break label }\nconst r = a ? /[({]+/g : b / c / d;\nlog(`p ${s} ok ${a ? `x${b}` : '}'}`);\nexport default function () {}",
        "const {a, b: [c, d], ...e} = f?.g?.[1] ?? h?.(2);\nx = y\nz = function () { return };\nvar fn = x => ({ a, b, [c]: 1, get d() { return 1 }, async e() {}, 'f': 2, 3: 4 });",
        "switch (x) { case 1: case 2: foo(); break; default: bar() }\ntry { a } catch { b } finally { c }\ndo x++; while (x < 5)\nnew Foo; new Foo.Bar(1).x(); a **= 2; !function(e,t){x}(1,2);(()=>{var e={}})();",
        "\ufeff#!/usr/bin/env node\nlet n = 1_000n + 0xff - .5e10\nimport.meta.url; import('x').then(y => y)\n[1,,2,...x];[a, b] = [b, a]; ({a} = b);\nx.if.class = 5 // `unclosed",
        "if (ok) /a[/)]b/g.test(x)\nwhile (x) {} /re/.exec(y); const q = (a + b) / c / d;",
        "/* multi\nline */ const s = 'it\\'s', t = \"a\\\nb\";\r\nif (a)\r\n  b()\r\nelse c()\r\n",
    ],
    "cjs": ["const x = require('x');\nmodule.exports = { x };\nwith (x) { y }\nvar await_ = 010;"],
    "ts": [
        "interface A<T extends B = C> extends D<E> { a?: string; readonly b: number[]; (x: number): string; [k: string]: any; m<U>(x: U): asserts x is string }\ntype M = { readonly [K in keyof T]?: T[K] };",
        "export abstract class P<T> extends Q<T> implements R { private readonly x: number = 1; constructor(private a: string) { super(); } abstract foo(): void; static async bar<T>(x: T): Promise<Map<string, T[]>> { return x as unknown as any; } y!: string; }",
        "enum E { A, B = 1 }\nfunction f(this: W, x: any, ...y: Array<Array<number>>): x is string { const a = <any>x; foo<Bar>(1); return a!.b![0]!; }\nimport { type C, D } from 'c';\nlet v: typeof import('x').y; let q = a < b && c > d;",
        "type T1 = `a${infer U}b${string}`; let z: Array<Array<Array<number>>> = a >> b >>> c;",
        "type X = string | (() => void) | [a: string, ...c: T[]];\ntype C1 = T extends (infer U)[] ? U : never;\ndeclare module 'x' { export function y(): void; }\nconst g = async <T,>(x: T): Promise<T> => x;",
    ],
    "jsx": ["export function P() {\n  return (\n    <div className=\"w\" {...props} onClick={() => { a }}>\n      <p>Don't {x ? <b>y</b> : null}</p>\n <br/>{/* c */}<></>{l.map(x => <Li key={x}>{x}</Li>)}\n </div>\n );\n}\nif (a < b) { c > d }"],
    "tsx": ["const f = (a: number): JSX.Element => <A<string> x={a as any} />;".replace("<A<string>", "<A"), "const g = <T,>(x: T) => <b>{x}</b>;"],
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\nconst m = 1\n\ntype S struct {\n\tA, B int `json:"a"`\n\t*T\n}\n\nfunc (s *S) F(a, b int, c ...string) (int, error) {\n\tif err := g(); err != nil {\n\t\treturn 0, err\n\t} else if x == (T{1}) {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t}\n\tswitch t := x.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\treturn 1, nil\n}\n',
        "package b\nfunc G[T any, K comparable](x []T) map[K]T {\n\tgo func() { ch <- 1 }()\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\ta := []map[string]int{{\"x\": 1}, nil}\n\tdefer a[1:2].f()\nL:\n\tfor {\n\t\tbreak L\n\t}\n\treturn nil\n}\nvar r = strings.IndexRune(s, '{')",
        "package c",
    ],
    "rs": [
        "#![allow(x)]\nuse std::{io, fmt::{self as f, *}};\n#[derive(Debug)]\npub struct A<'a, T: Clone + 'a> where T: B { pub(crate) x: &'a mut T, y: [u8; 4] }\nimpl<'a, T> C<T> for A<'a, T> { type X = u8; fn f(&mut self, (a, b): (u8, u8)) -> Result<(), Box<dyn E + Send>> { let x = &self.y[1..]; Ok(()) } }",
        "fn main() { let v: Vec<Vec<u8>> = x.iter().map(|&x| x as u32 + 1).collect::<Vec<_>>(); match v { Some(1..=5 | 7) if a => {} E::B { ref c, .. } => (), _ => return, } if let Some(x) = y && z { } else { } while let Some(_) = i.next() {} 'a: loop { break 'a; } println!(\"{}\", '\\''); unsafe { *p = S { a: 1, ..d }; } x?.await }",
        "pub trait T: A + B { const C: u8 = 1; fn g<F>(&self, f: F) -> impl Fn(u8) -> u8 where F: FnOnce() -> u8; }\nenum E { A(u8), B { x: i8 } = 5, C }\nmacro_rules! m { ($x:expr) => { $x }; }\nstatic S: &str = r#\"a \"q\" b\"#;\nmod n { pub use super::*; }",
        "",
    ],
    "py": ["def f[T](x: T, /, *, y=1) -> T:\n    match x:\n        case {'a': [b, *_]} if b: return f'{x!r:>{w}}'\n", "\ufeffx = 1\r\n"],
}
BAD = {
    "js": ["function f( {", "const x = ;", "foo(]", "class A { x y }", "import x from;", "let = 5 6", "return 5", "<<<<<<< HEAD\na\n", "a b", "const x: number = 1;", "interface A { a: 1 }", "'abc\n'", "function () {}", "var x = “a”;", "{ a: 1, b: 2 }", "def f(x):\n  pass", "var 1a = 2;", "foo(1,,2)", "else { }", "<div></div>", "`abc", "/* x", "enum X {}", "@@ -1 +1 @@", "with (x) {}}"],
    "cjs": ["import x from 'x';", "export default 1;"],
    "ts": ["interface A { a: ; }", "type X = ;", "function f(x: ) {}", "let x: Map<string = 1;", "enum { A }", "const x = <div>a</div>;", "+ const a = 1;\n- const b"],
    "jsx": ["const x = <div><p></div>;", "return (<div>", "const a = <div>{x</div>;", "const t: string = 'a';"],
    "go": ["", "func f() {}", "package a\nfunc f( {\n}", "package a\nfunc f() {\n\tx := \n}", "package a\nvar x = “a”", "package a\n<<<<<<< HEAD\n", "package a\nfunc f() { if x { }", "package a\nimport logging", "package a\nfunc f() { a b }", "package a\nx = 1"],
    "rs": ["fn f( {}", "fn f() { let x = ; }", "fn f() { a b }", "struct A { x u8 }", "fn f() -> { }", "fn f() { \"abc }", "use a::;", "let x = 1;", "fn f() { match x { A => } }", "<<<<<<< HEAD", "def f(): pass"],
    "py": ["def f(:\n pass", "print 'x'", "return 1", "if x:\n", "x = “a”", "class A:\nx"],
}


@pytest.mark.parametrize("suffix", sorted(GOOD))
def test_good(suffix):
    assert [t for t in GOOD[suffix] if not P.valid(suffix, t)] == []


@pytest.mark.parametrize("suffix", sorted(BAD))
def test_bad(suffix):
    assert [t for t in BAD[suffix] if P.valid(suffix, t)] == []


def test_remembered_results_do_not_change_answers():
    for make in (Go, Rust, EcmaScript):
        p = make()
        suffix = {Go: "go", Rust: "rs", EcmaScript: "js"}[make]
        for _ in range(2):
            assert all(p.check(t) for t in GOOD[suffix]) and not any(p.check(t) for t in BAD[suffix])
            p.language.trim(0)


def test_deep_and_long():
    assert P.valid("js", "x = " + "[" * 3000 + "]" * 3000 + ";") and not P.valid("js", "x = " + "[" * 3000 + "]" * 2999 + ";")
    chain = "if (a) {\n} " + "else if (b) {\n} " * 3000
    assert P.valid("js", chain) and P.valid("js", "x = " + "a ? b : " * 3000 + "c;") and not P.valid("js", chain + "else else")
    assert P.valid("rs", "fn f() { if a {} " + "else if b {} " * 2000 + "}") and P.valid("ts", "type A = " + "B extends C ? D : " * 1000 + "E;")
    assert P.valid("go", "package a\n" + "var x = 1\n" * 20_000) and P.valid("rs", "fn f() {" + " a();" * 20_000 + "}")


def test_chains_of_any_length():
    n = 20_000
    assert P.valid("js", "x = " + "a ? b : " * n + "c;") and not P.valid("js", "x = " + "a ? b : " * n + "c d;")
    assert P.valid("js", "if (a) {\n} " + "else if (b) {\n} " * n) and P.valid("ts", "type A = " + "B extends C ? D : " * 5000 + "E;")
    assert P.valid("rs", "fn f() { if a {} " + "else if b {} " * n + "}") and P.valid("go", "package a\nfunc f() { if a {} " + "else if b {} " * n + "}\n")
    assert P.valid("js", "x = " + "!" * n + "c;") and P.valid("js", "a = " * n + "c;") and P.valid("js", "while (x) " * n + "c;")


def test_suffixes_of_one_family_are_told_apart():
    jsx = "import R from 'react';\nexport const A = () => { return <div className='x'>{a}</div>; };\n"
    tsx = "import R from 'react';\ninterface P { a: string }\nexport const A = (p: P) => { return <div>{p.a}</div>; };\n"
    script, module = "const x = require('y');\nwith (x) { a = 010; }\nmodule.exports = x;\n", "import a from 'b';\nexport default a;\n"
    cases = [("js", jsx, "jsx"), ("ts", jsx, "jsx"), ("py", jsx, "jsx"), ("go", jsx, "jsx"), ("ts", tsx, "tsx"), ("mjs", script, "cjs"), ("cjs", module, "js"), ("js", "const x: number = 1;\n", "ts")]
    assert [validity.diagnose(s, t, P) for s, t, _ in cases] == [(False, found) for _, _, found in cases]


DOC = "path string, text string, source string, collected_at timestamp, suffix string, repo string, seen int, digest string, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(p, t, s, None, "x", "y", 1, "z", "w") for p, t, s in rows], DOC)


def records(spark, paths):
    return spark.createDataFrame([(p, 1, "t") for p in paths], "path string, size long, text string")


def test_syntax_status(spark):
    rows = [
        ("a/ok.py", "x = 1", "o/a"), ("a/bad.py", "x = (", "o/a"), ("a/js.py", "const f = () => { return `x`; };\n", "o/a"), ("a/go.js", "package a\n\nfunc f() int {\n\treturn 1\n}\n", "o/a"),
        ("a/null.py", None, "o/a"), ("a/blank.go", " \n\u2003\ufeff ", "o/a"), ("a/doc.md", "(", "o/a"), (None, "(", "o/a"), ("a/unrecorded.py", "(", "o/a"), ("a/UP.PY", "(", None),
    ]
    wanted = records(spark, [r[0] for r in rows if r[0] != "a/unrecorded.py"] * 2)
    got = {r.path: (r.valid, r.parses_as, r.fault) for r in validity.syntax_status(wanted, docs(spark, rows)).collect()}
    assert got == {
        "a/ok.py": (True, None, None), "a/bad.py": (False, None, "corrupt"), "a/js.py": (False, "javascript", "wrong_suffix"), "a/go.js": (False, "go", "wrong_suffix"), "a/UP.PY": (False, None, "corrupt"),
    }
    rates = {(r.repo, r.language): (r.files, r.invalid, r.wrong_suffix, r.share) for r in validity.fault_rates(validity.syntax_status(wanted, docs(spark, rows))).collect()}
    assert rates["o/a", "python"] == (3, 2, 1, 2 / 3) and rates[None, "python"] == (1, 1, 0, 1.0)
    assert validity.syntax_status(records(spark, []), docs(spark, [])).count() == 0


SYMBOL = "path string, name string, kind string, start_line int, qualified_name string, docstring string, text string"


def test_function_pairs(spark):
    py = 'def good(a):\n    """Adds what is new."""\n    return a\n\n\ndef todo():\n    """TODO"""\n\n\nclass K:\n    def name_it(self):\n        """Names it."""\n        def inner(): pass\n\n    async def last(self, x: dict[str, int] = {"a)": 1}) -> int:\n        # a note\n        r\'\'\'Says (x).\n\n        Args:\n            x: y\n        \'\'\'\n'
    js = "/** Opens the gate. */\nexport function open() { return '{'; }\n\n// Far away.\n\nfunction far() {}\n// eslint-disable-next-line\nfunction tool() {}\n/**\n * @param a\n * @returns\n */\nconst bare = (a) => { return /[{]/; };\nclass C {\n  // Closes after use.\n  // ------\n  static close() {}\n}\n"
    rs = "/// Counts.\n#[inline]\npub fn tally() -> u8 { 1 }\n// ====\nfn ruler() {}\n/// À compléter\nfn later<'a>(x: &'a str) {}\n"
    go = "package p\n\n// balance_all\nfunc BalanceAll() {}\n\n// Takes locks in order.\nfunc (x *T) Take() {\n\tx.f('{')\n}\nfunc broken( {\n"
    rows = [("a.py", py, "o/r"), ("b.js", js, "o/r"), ("c.rs", rs, "o/r"), ("d.go", go, "o/r"), ("e.py", None, "o/r"), ("f.js", "", "o/r")]
    lines = {"a.py": [("good", 1), ("todo", 6), ("name_it", 11), ("last", 15)], "b.js": [("open", 2), ("far", 6), ("tool", 8), ("bare", 13), ("close", 17)], "c.rs": [("tally", 3), ("ruler", 5), ("later", 7)], "d.go": [("BalanceAll", 4), ("Take", 7)], "e.py": [("x", 1)], "f.js": [("y", 1)]}
    symbols = [(p, n, "function", line, f"Q.{n}", "stale", "t") for p, found in lines.items() for n, line in found] * 2
    symbols += [("a.py", "K", "class", 10, None, None, "t"), ("a.py", None, "function", None, None, None, "t"), (None, "z", "method", 1, "z", None, "t")]
    got = {r.qualified_name: r for r in documented.function_pairs(spark.createDataFrame(symbols, SYMBOL), docs(spark, rows)).collect()}
    assert set(got) == {"Q.good", "Q.last", "Q.open", "Q.close", "Q.tally", "Q.Take"}
    assert all(r.valid for r in got.values()) and got["Q.open"].code == "export function open() { return '{'; }" and got["Q.good"].description == "Adds what is new."
    assert documented.function_pairs(spark.createDataFrame([], SYMBOL), docs(spark, [])).count() == 0


def test_templates_are_counted(spark):
    many = [(f"f{i}.py", f'def job{i}():\n    """Handled elsewhere."""\n', "o/r") for i in range(documented.TEMPLATE_NAMES)]
    long = [(f"g{i}.py", f'def run{i}():\n    """Safe to call twice, keeps the order."""\n', "o/r") for i in range(documented.TEMPLATE_NAMES)]
    symbols = [(p, n, "function", 1, n, None, "t") for p, n in [(f"f{i}.py", f"job{i}") for i in range(20)] + [(f"g{i}.py", f"run{i}") for i in range(20)]]
    got = [r.path for r in documented.function_pairs(spark.createDataFrame(symbols, SYMBOL), docs(spark, many + long)).collect()]
    assert len(got) == 20 and all(p.startswith("g") for p in got)


def test_functions_that_do_not_parse_and_attributes_of_several_lines(spark):
    ts = "// Opens the gate.\n@Input({\n  a: [1],\n})\nfunction gate() {}\n\n// Breaks off.\nfunction off(a { return 1; }\n\n// Comes after it.\nfunction after() { return 2; }\n"
    rs = "/// Counts all.\n#[cfg(any(\n    a,\n    b,\n))]\n#[inline]\nfn count() {}\n"
    py = 'def ok():\n    """Says what it does."""\n    return 1\n\n\ndef broken():\n    """Says it too."""\n    return (\n\n\ndef last():\n    """Comes last of all."""\n'
    rows = [("a.ts", ts, "o/r"), ("b.rs", rs, "o/r"), ("c.py", py, "o/r")]
    lines = [("a.ts", "gate", 5), ("a.ts", "off", 8), ("a.ts", "after", 11), ("b.rs", "count", 7), ("c.py", "ok", 1), ("c.py", "broken", 6), ("c.py", "last", 11)]
    symbols = spark.createDataFrame([(p, n, "function", line, n, None, "t") for p, n, line in lines], SYMBOL)
    assert {r.qualified_name for r in documented.function_pairs(symbols, docs(spark, rows)).collect()} == {"gate", "after", "count", "ok", "last"}


HAND = "import logging\nfrom a.b import c\n\n\ndef work(item, other):\n    for part in item:\n        other.append(part)\n    return other\n"


def test_not_handwritten(spark):
    getters = "class Msg:\n" + "".join(f"    def get_x_{i}(self):\n        return self._f[{i}]\n\n" for i in range(5))
    mini = "(function(){var n={};" + "".join(f"if(a===b){{t+={i}}}else throw new Error('x');" for i in range(30)) + "})();"
    data = "TABLE = [\n" + "\n".join(", ".join(str(i * j * 7919 % 65536) for j in range(20)) + "," for i in range(1, 20)) + "\n]\n"
    cases = {
        "r/src/vendor/pkg/a.py": (HAND, "vendored"), "r/Third_Party/x/a.py": (HAND, "vendored"), "r/src/vendor_portal/a.py": (HAND, None), "r/a/copy.py": ("# Bundled copy of lib 1.2.3, do not patch here.\n" + HAND, "vendored"),
        "r/a/gen.py": ("# Code generated by tool. DO NOT EDIT.\n" + HAND, "generated"), "r/a/hand.py": ("# Not generated: please edit by hand.\n" + HAND, None), "r/a/was.py": ("# Used to be auto-generated; rewritten by hand since.\n" + HAND, None),
        "r/a/late.py": (HAND + '\nTEXT = """\n# Code generated by {tool}. DO NOT EDIT.\n"""\n', None), "r/a/plain.py": (getters, "generated"), "r/a/app.js": (mini, "minified"), "r/a/table.py": (data, "data"), "r/a/ok.py": (HAND, None),
        "r/a/help.js": ("const HELP = \"" + "words of help " * 60 + "\";\nfunction show() {\n  return HELP;\n}\n", None), "r/a/blank.py": (" \n", None), "r/vendor/null.py": (None, None), "r/vendor/readme.md": ("x", None), "r/static/lib-1.2.3.js": ("/*! lib v1.2.3 | (c) lib authors | MIT licence */\n" + "function a() {}\n", "vendored"),
    }
    rows = [(p, t, "own/r") for p, (t, _) in cases.items()] + [(None, mini, "own/r")]
    got = {r.path: r.kind for r in handwritten.not_handwritten(records(spark, [*cases, *cases, None]), docs(spark, rows)).collect()}
    assert got == {p: k for p, (_, k) in cases.items() if k}
    assert handwritten.not_handwritten(records(spark, []), docs(spark, [])).count() == 0


def test_shared_subtrees(spark):
    lib = [("x.py", HAND), ("sub/y.py", HAND.replace("work", "rest"))]
    rows = [(f"{r}/a/lib/{p}", t, f"{o}/{r}") for o, r in (("one", "r1"), ("two", "r2")) for p, t in lib]
    rows += [("r3/a/lib/x.py", HAND + "# changed\n", "three/r3"), ("r1/b/copy.py", HAND.replace("work", "play"), "one/r1"), ("r1/c/copy2.py", HAND.replace("work", "play"), "one/r1")]
    got = {r.path for r in handwritten.not_handwritten(records(spark, [r[0] for r in rows]), docs(spark, rows)).collect()}
    assert got == {"r2/a/lib/x.py", "r2/a/lib/sub/y.py"}  # the copy, not the original nor copies within one repository


def test_short_remarks_are_kept_in_large_corpora(spark):
    said = ["Not thread safe."] * 25 + ["重复调用时返回缓存结果。"] * 60 + [f"Reads the block of number {i} again." for i in range(600)]
    text = "".join(f'def job{i}():\n    """{d}"""\n' for i, d in enumerate(said))
    symbols = [("a.py", f"job{i}", "function", 2 * i + 1, f"job{i}", None, "t") for i in range(len(said))]
    assert documented.function_pairs(spark.createDataFrame(symbols, SYMBOL), docs(spark, [("a.py", text, "o/r")])).count() == len(said)


def test_long_headers_docstrings_and_source_maps_are_read_whole():
    bundle = "function add(a, b) {\n  return a + b;\n}\n//# sourceMappingURL=data:application/json;base64," + "eyJ2" * 2000 + "\n"
    assert handwritten.verdict("r/src/app.js", bundle)[0] == "minified"
    code = '\n\n\ndef add(a, b):\n    """Adds two numbers and returns the sum."""\n    return a + b\n'
    prose = "Some words about the module and what it is for.\n" * 200
    assert handwritten.verdict("r/src/a.py", '"""' + prose + 'Vendored from tool 1.2.\n"""' + code)[0] == "vendored"
    assert handwritten.verdict("r/src/b.py", "# some words about it\n" * 500 + "# Code generated by tool. DO NOT EDIT.\n" + code)[0] == "generated"
    assert handwritten.verdict("r/src/c.py", '"""' + prose + '"""' + code)[0] is None


def test_places_headers_and_white_space_are_weighed():
    kind = lambda p, t: handwritten.verdict(p, t)[0]
    plain = "def f():\n    return 1\n"
    assert kind("r/deps/a.py", plain) is None and kind("r/external/a.py", plain) is None and kind("r/vendor/a.py", plain) is None
    assert kind("r/vendor/pkg/a.py", plain) == "vendored" and kind("r/deps/a.py", "# Copyright the lib authors.\n" + plain) == "vendored"
    assert handwritten.verdict("r/deps/pkg/a.py", plain) == (None, "pkg")
    assert kind("r/a.py", "# This module used to be big.\n# Code generated by protoc. DO NOT EDIT.\n" + plain) == "generated"
    assert kind("r/a.py", "# Used to be generated by protoc.\n# Do not edit without asking.\n" + plain) is None and kind("r/a.py", "# DO NOT EDIT\n" + plain) == "generated"
    assert kind("r/a.py", "a = 1\nb = 2\nc = 3\n" + "\n" * 500) is None
    assert kind("r/a.py", "# Do not modify: " + "as said above, " * 20 + "this is regenerated.\n" + plain) == "generated"


def test_packages_in_loose_directories_need_another_owner(spark):
    rows = [("r1/deps/pkg/a.py", HAND, "one/r1"), ("r2/vendor/pkg/b.py", HAND + "# b\n", "two/r2"), ("r1/deps/own/a.py", HAND + "# c\n", "one/r1"), ("r3/external/own/a.py", HAND + "# d\n", "one/r3")]
    got = {r.path for r in handwritten.not_handwritten(records(spark, [r[0] for r in rows]), docs(spark, rows)).collect()}
    assert got == {"r1/deps/pkg/a.py", "r2/vendor/pkg/b.py"}


def test_merkle_hashes_over_trees_of_many_repositories(spark):
    """Libraries in several versions copied at any depth into 40 repositories of 20 owners, some copies with one file changed or added."""
    rnd = random.Random(8)
    code = lambda n: "".join(HAND.replace("work", f"work_{n}_{k}") for k in range(3)) + "\n" * (n % 3)
    libs = {(k, v): [(f"{d}m{i}.py", code(1000 * k + 10 * i + (v if i == 0 else 0))) for i in range(4) for d in ("" if i < 2 else "sub/",)] for k in range(5) for v in range(2)}
    rows, copied = [], set()
    for r in range(40):
        repo, owner = f"r{r}", f"o{r % 20}"
        rows += [(f"{repo}/src/own{i}.py", code(100_000 + 100 * r + i), f"{owner}/{repo}") for i in range(3)]
        for key in rnd.sample(sorted(libs), 2):
            at = f"{repo}/" + rnd.choice(["", "src/", "a/b/c/"]) + f"lib{key[0]}"
            files = dict(libs[key])
            if rnd.random() < 0.4:
                files["m0.py"] = code(500_000 + r)  # a near copy: the rest is shared file by file and as the directory below
            if rnd.random() < 0.4:
                files["extra.py"] = code(600_000 + r)
            for name, text in files.items():
                rows.append((f"{at}/{name}", text, f"{owner}/{repo}"))
                copied.add((f"{at}/{name}", text.strip(), owner))
    owners, first = {}, {}
    for path, text, owner in sorted(copied):
        owners.setdefault(text, set()).add(owner)
    for path, text, source in sorted(rows, key=lambda x: x[2]):
        first.setdefault(text.strip(), source)
    seen = {p: s for p, _, s in rows}
    expected = {p for p, text, owner in copied if len(owners[text]) > 1 and seen[p] != first[text]}
    got = {r.path for r in handwritten.not_handwritten(records(spark, [r[0] for r in rows]), docs(spark, rows)).collect()}
    assert expected <= got and not any("/src/own" in p or "/extra.py" in p for p in got)
