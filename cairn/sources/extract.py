"""Symbols, imports, inheritance and calls of source files.

Python is read with its own parser (of broken files, all but the smallest blocks that hold the errors). The other languages are read by a
tokenizer that blanks comments and strings and follows braces; that is enough for declarations and calls, and never fails.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import LANGUAGES
from cairn.session import spread

SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,docstring:string,complexity:int,qualified_name:string>"
IMPORT = "struct<module:string,names:array<string>,start_line:int,is_relative:boolean>"
BASE = "struct<class_name:string,base:string,line:int>"
CALL = "struct<caller:string,callee:string,line:int>"
PARSED = f"path string, language string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, inheritance array<{BASE}>, calls array<{CALL}>, errors array<string>"
#: Fixed value: the error of a file that is no valid source.
SYNTAX_ERROR = "Syntax errors detected in AST"

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.match_case)


def _call_name(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        inner = _call_name(node.value)
        return f"{inner}.{node.attr}" if inner else node.attr
    return _call_name(node.func) if isinstance(node, ast.Call) else ""


_PY_TOKEN = re.compile(r"(?P<long>\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3})|#[^\n]*|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")
_PY_INSIDE = re.compile(r"[\s)\]}#]|(?:else|elif|except|finally)\b|$")


def _attempt(lines: list[str]) -> tuple[ast.Module | None, int | None]:
    """The tree, or the line (from 0) of the error where the parser tells it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse("\n".join(lines)), None
    except SyntaxError as e:
        return None, None if e.lineno is None else max(0, min(e.lineno, len(lines)) - 1)
    except (ValueError, RecursionError, MemoryError):
        return None, None


def _starts(lines: list[str], strings: bool = True) -> list[int]:
    """Lines at which top-level statements begin, decorators included; with ``strings`` none inside long strings."""
    text, inside = "\n".join(lines), set()
    if strings:
        for m in _PY_TOKEN.finditer(text):
            if m["long"] and "\n" in m["long"]:
                first = text.count("\n", 0, m.start())
                inside.update(range(first + 1, first + 1 + m["long"].count("\n")))
    out, decorated = [], False
    for i, line in enumerate(lines):
        if i not in inside and not _PY_INSIDE.match(line):
            if not decorated:
                out.append(i)
            decorated = line[0] == "@"
    return out


def _without(lines: list[str], at: int) -> list[str] | None:
    """The lines of a block with ``pass`` in place of the smallest nested statement around ``at`` that removes the error there."""
    while at > 0 and not lines[at].strip():
        at -= 1
    indent = lambda x: len(x) - len(x.lstrip())
    first, depth = at, indent(lines[at])
    while depth:
        last = first + 1
        while last < len(lines) and (not lines[last].strip() or last <= at or indent(lines[last]) > depth):
            last += 1
        trial = [*lines[:first], lines[first][:depth] + "pass", *[""] * (last - first - 1), *lines[last:]]
        tree, error = _attempt(trial)
        if tree or (error is not None and error >= last):
            return trial
        while first > 0 and (not lines[first].strip() or indent(lines[first]) >= depth):
            first -= 1
        if indent(lines[first]) >= depth:
            break
        depth = indent(lines[first])
    return None


def _python_tree(text: str) -> tuple[ast.Module, bool]:
    """The tree of all that can be parsed, and whether that is the whole file."""
    lines = text.replace("\r", "\n").replace("\0", " ").split("\n")
    module, whole = ast.Module(body=[], type_ignores=[]), "\0" not in text
    todo = [(0, lines)]
    while todo:
        offset, part = todo.pop()
        tree, at = _attempt(part)
        if tree:
            module.body += (ast.increment_lineno(tree, offset) if offset else tree).body
            continue
        whole = False
        for strings in (True, False):
            cuts = [0, *(i for i in _starts(part, strings) if i), len(part)]
            if at is not None:  # what lies before and after the block with the error stays together
                cuts = sorted({0, max(i for i in cuts if i <= at), min(i for i in cuts if i > at), len(part)})
            if len(cuts) > 2:
                todo += [(offset + a, part[a:b]) for a, b in reversed(list(zip(cuts, cuts[1:])))]
                break
            if strings and at is not None and (rest := _without(part, at)):
                todo.append((offset, rest))
                break
    return module, whole


def _python(text: str) -> dict:
    out = {"symbols": [], "imports": [], "inheritance": [], "calls": [], "errors": []}
    tree, whole = _python_tree(text)
    if not whole:
        out["errors"] = [SYNTAX_ERROR]

    def visit(node: ast.AST, scope: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = ".".join([*scope, child.name])
                is_class = isinstance(child, ast.ClassDef)
                complexity = None if is_class else 1 + sum(isinstance(x, _BRANCHES) or (isinstance(x, (ast.If, ast.For, ast.While)) and bool(x.orelse)) for x in ast.walk(child))
                out["symbols"].append((child.name, "class" if is_class else "function", child.lineno, child.end_lineno, ast.get_docstring(child), complexity, name))
                if is_class:
                    out["inheritance"] += [(child.name, base, child.lineno) for b in child.bases if (base := _call_name(b.value if isinstance(b, ast.Subscript) else b))]
                else:
                    out["calls"] += [(name, callee, x.lineno) for x in ast.walk(child) if isinstance(x, ast.Call) and (callee := _call_name(x.func))]
                visit(child, [*scope, child.name])
            elif isinstance(child, ast.Import):
                out["imports"] += [(a.name, [], child.lineno, False) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append(("." * child.level + (child.module or ""), [a.name for a in child.names], child.lineno, child.level > 0))
            else:
                visit(child, scope)

    visit(tree, [])
    return out


_BLANK = {
    "js": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n])[^'\n]*'"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|r(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\(?:[^\n]|u\{\w+\}|x\w\w))'"),
}
_CALL = re.compile(r"(?<![\w$])((?:[A-Za-z_$][\w$]*(?:\s*(?:\.|::)\s*)?)+)\s*(?:::<[^<>()]*>)?\(")
_NO_CALL = frozenset("if for while switch catch return function func fn match await typeof new else in of loop select go defer super impl where".split())
_BRANCH = re.compile(r"\b(?:if|else|for|while|case|catch)\b|&&|\|\||=>(?=[^\n]*,\s*$)", re.M)
_JS = re.compile(
    r"(?P<cls>\bclass\s+(?P<cname>[\w$]+)[^{]*\{)|(?P<fn>\bfunction\s*\*?\s*(?P<fname>[\w$]+)\s*(?:<[^>(]*>)?\()"
    r"|(?P<arrow>\b(?:const|let|var)\s+(?P<aname>[\w$]+)[^=;\n]*=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^=;{\n]*|[\w$]+\s*)=>)"
    r"|(?P<method>(?:^[ \t]+|(?<=[{};])[ \t]*)(?:(?:public|private|protected|static|async|get|set|readonly|abstract|override)\s+|\*\s*)*(?P<mname>#?[\w$]+)\s*(?:<[^>(]*>)?\([^;{}]*\)[^;{}()]*\{)",
    re.M,
)
_GO = re.compile(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(?P<recv>\w+)[^)]*\)\s*)?(?P<fname>\w+)\s*[\[(]|^\s*type\s+(?P<tname>\w+)", re.M)
_RUST = re.compile(r"\bfn\s+(?P<fname>\w+)|\b(?:struct|enum)\s+(?P<sname>\w+)|\btrait\s+(?P<tname>\w+)|\bimpl\b(?P<impl>[^{;]*)\{", re.M)


def _blanked(kind: str, text: str) -> str:
    return _BLANK[kind].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(code: str, at: int) -> int:
    """The end of the block whose brace is the first at or after ``at``."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth:
            return m.end()
    return len(code)


def _comment_above(lines: list[str], line: int) -> str | None:
    got = []
    for i in range(line - 2, max(-1, line - 7), -1):
        if not re.match(r"\s*(?://|#)", lines[i]):
            break
        got.append(re.sub(r"^\s*(?://+|#+)\s?", "", lines[i]))
    return "\n".join(reversed(got)) or None


def _braced(kind: str, text: str) -> dict:
    out = {"symbols": [], "imports": [], "inheritance": [], "calls": [], "errors": []}
    code, lines = _blanked(kind, text), text.split("\n")
    if code.count("{") != code.count("}") or code.count("(") != code.count(")"):
        out["errors"] = [SYNTAX_ERROR]
    ends = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect_left(ends, at) + 1
    spans: list[tuple[int, int, str]] = []

    def scope_at(at: int) -> list[str]:
        return [n for a, b, n in spans if a < at < b]

    def add(name: str, symbol_kind: str, at: int, scope: list[str]) -> None:
        end = _close(code, at)
        body = code[at:end]
        first = line_of(at)
        qualified = ".".join([*scope, name])
        is_function = symbol_kind in ("function", "method")
        out["symbols"].append((name, symbol_kind, first, line_of(end), _comment_above(lines, first), 1 + len(_BRANCH.findall(body)) if is_function else None, qualified))
        if is_function:
            for m in _CALL.finditer(body, body.find("{") + 1 if "{" in body else len(body)):
                callee = re.sub(r"\s+", "", m.group(1))
                if kind == "go":
                    callee = callee.rsplit(".", 1)[-1]
                if callee and callee not in _NO_CALL:
                    out["calls"].append((qualified, callee, line_of(at + m.start())))

    if kind == "js":
        for m in _JS.finditer(code):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            if m["cls"]:
                spans.append((m.start(), _close(code, m.start()), m["cname"]))
                add(m["cname"], "class", at, [])
                for clause in re.findall(r"\b(?:extends|implements)\s+([\w$.,\s<>\[\]]+?)(?=\bimplements\b|\{|$)", m["cls"]):
                    out["inheritance"] += [(m["cname"], b.strip(), line_of(at)) for b in re.sub(r"<.*?>", "", clause).split(",") if b.strip()]
            elif m["method"]:
                if scope_at(at) and m["mname"] not in _NO_CALL:
                    add(m["mname"], "method", at, scope_at(at)[-1:])
            else:
                add(m["fname"] or m["aname"], "function", at, scope_at(at)[-1:])
        for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?(?:([^;'\"]*?)\s+from\s*)?(['\"])([^'\"\n]+)\2", text, re.M):
            names = [re.sub(r"^type\s+|\s+as\s+.*$", "", n.strip()) for n in re.sub(r"[{}*]", " ", m[1] or "").split(",")]
            out["imports"].append((m[3], [n for n in names if n and n != "as"], line_of(m.start()), m[3].startswith(".")))
    elif kind == "go":
        package = re.search(r"^package\s+(\w+)", code, re.M)
        scope = [package[1]] if package else []
        for m in _GO.finditer(code):
            if m["tname"]:
                add(m["tname"], "class", m.start("tname"), scope)
            else:
                add(m["fname"], "method" if m["recv"] else "function", m.start(), [*scope, m["recv"]] if m["recv"] else scope)
        for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"\n]+\"))", text, re.M):
            for m in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", block[0]):
                out["imports"].append((m[2], [], line_of(block.start() + m.start(2)), False))
    else:
        for m in _RUST.finditer(code):
            if m["impl"] is not None:
                target = re.sub(r"^\s*<[^>]*>", "", m["impl"]).split(" where ")[0]
                trait, _, owner = target.rpartition(" for ")
                owner = re.sub(r"<.*", "", owner).strip().rsplit("::", 1)[-1]
                spans.append((m.start(), _close(code, m.start()), owner))
                if trait.strip():
                    out["inheritance"].append((owner, re.sub(r"<.*", "", trait).strip(), line_of(m.start())))
            elif m["fname"]:
                scope = scope_at(m.start())[-1:]
                add(m["fname"], "method" if scope else "function", m.start(), scope)
            elif m["tname"]:
                spans.append((m.start(), _close(code, m.start()), m["tname"]))
                add(m["tname"], "trait", m.start(), [])
            else:
                add(m["sname"], "class", m.start(), [])
        for m in re.finditer(r"\buse\s+([^;]+);", code):
            module = re.sub(r"\s+", "", m[1])
            out["imports"].append((module, [], line_of(m.start()), module.startswith(("self::", "super::", "crate::"))))
    return out


#: Extractors by language; others can be added.
EXTRACTORS = {
    "python": _python, "javascript": lambda t: _braced("js", t), "typescript": lambda t: _braced("js", t), "tsx": lambda t: _braced("js", t),
    "go": lambda t: _braced("go", t), "rust": lambda t: _braced("rust", t),
}


def detect_language(path: str) -> str | None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return LANGUAGES.get(name[dot:].lower()) if dot > 0 else None


def parse_text(path: str, text: str | bytes) -> dict | None:
    """The parse result of one file, nothing for unknown languages."""
    language = detect_language(path)
    if language is None:
        return None
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    return {"path": path, "language": language} | EXTRACTORS[language](text.replace("\r\n", "\n").removeprefix("﻿"))


def parse_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per file of a known language, with arrays of what was found (schema ``PARSED``). Null texts and paths have no row."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "language", "symbols", "imports", "inheritance", "calls", "errors"]
        for part in parts:
            yield pd.DataFrame([[r[c] for c in columns] for p, t in zip(part["path"], part["text"]) if (r := parse_text(p, t)) is not None], columns=columns)

    rows = files.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    return spread(rows).mapInPandas(parse, PARSED)


def flatten(parsed: DataFrame, what: str) -> DataFrame:
    """``symbols``, ``imports``, ``inheritance`` or ``calls`` as rows."""
    return parsed.select("path", F.inline(what))
