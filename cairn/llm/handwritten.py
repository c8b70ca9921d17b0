"""Code files nobody wrote by hand: generated, minified or bundled, copied from third parties, or data saved as code.

Three kinds of evidence: where the file lies and how it is named, what its header says and how it is laid out,
and Merkle hashes of directory trees, by which subtrees that unrelated repositories share are recognised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize, spread

#: Suffixes of code files, directory names of third-party code, those of them that projects use for code of their own too, and of build output.
CODE_SUFFIXES = ("py", "js", "mjs", "cjs", "jsx", "ts", "tsx", "go", "rs")
VENDOR_DIRS = (
    "vendor", "_vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules",
    "bower_components", "jspm_packages", "site-packages", "dist-packages", "external", "externals", "extern", "deps", "godeps",
)
LOOSE_VENDOR_DIRS = ("external", "externals", "extern", "deps", "godeps")
GENERATED_DIRS = ("__generated__", "generated", "autogen", "_generated", "gen-src")

#: Signs (white space aside) that a text must have before its layout tells anything, the share of names below which it is data,
#: the length from which a line is a minified one, and the signs a file must have to count as shared by content.
LAYOUT_CHARS, DATA_NAMES, LONG_LINE, SHARED_CHARS = 240, 0.1, 250, 200

_NAME_GENERATED = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.\w+|[._]generated\.\w+|\.gen\.\w+|\.designer\.\w+|_pb\.d\.ts)$", re.I)
_NAME_BUNDLE = re.compile(r"(?:[.-]min|[.-]bundle|\.chunk|\.umd|\.packed)\.[cm]?jsx?$", re.I)
_NAME_RELEASE = re.compile(r"^[a-z][\w.]*?-v?\d+\.\d+\.\d+(?:[.-]\w+)*\.[cm]?js$", re.I)

_SAYS_HAND = re.compile(
    r"\bnot (?:auto[- ]?)?generated\b|\b(?:re)?written by hand\b|\bmaintained by (?:people|hand)\b|\bplease edit by hand\b"
    r"|\bused to be\b|\b(?:writes|emits|creates|reads|handles|produces|checks) (?:the )?(?:auto-?)?generated\b|\bno longer generated\b",
    re.I,
)
_SAYS_GENERATED = re.compile(
    r"@generated\b|<auto-?generated>|\bauto-?generated\b|\bcode generated by\b|\bmachine[- ]generated\b|\bgenerated (?:by|from|with|using|on|automatically)\b"
    r"|\bautomatically (?:generated|produced|created)\b|\bdo not modify\b.*(?:regenerate|generated|by hand|overwritten)|\bdo not modify$"
    r"|\bproduced by \S+ v?\d|\bwill be (?:lost|overwritten)\b|\bare overwritten by\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand (?:bearbeiten|ändern)\b"
    r"|\bfichier (?:produit|généré) par\b|\bne pas (?:modifier|éditer)\b|\bgenerado (?:por|automáticamente)\b|\bno (?:editar|modificar)\b|\bgenerato (?:da|automaticamente)\b|\bnon modificare\b"
    r"|\bgerado (?:por|automaticamente)\b|\bnão editar\b|自动生成|自動生成|請勿編輯|请勿编辑|編集しないで|сгенерирован|не редактировать|자동 생성",
    re.I,
)
#: Said of hand-written files as well ("do not edit without asking"), so it counts only where nothing speaks for hands.
_SAYS_KEEP_OFF = re.compile(r"\bdo not edit\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n")
_LICENCE = re.compile(r"\blicen[cs]ed?\b|\bcopyright\b|\(c\)|©|\bspdx\b", re.I)
_SAYS_VENDORED = re.compile(
    r"\bvendored (?:from|copy)\b|\bbundled copy of\b|\bthird[- ]party (?:code|source)\b\s*[:,;]|\bimported third[- ]party\b|\bunmodified (?:upstream )?copy of\b|\bupstream copy of\b"
    r"|\bcopied (?:verbatim )?from \S+ v?\d|\bsee upstream\b|\bdo not patch here\b",
    re.I,
)
_BANNER = re.compile(r"/\*[!*]?\s*(?:\*\s*)?(?:@license\s+)?[\w@/.-]+ v?\d+\.\d+(?:\.\d+)?\b[^\n]*(?:licen[cs]e|\(c\)|©)|^\s*(?://|/?\*+!?)\s*@(?:license|licence|preserve)\b", re.I | re.M)
_MAP = re.compile(r"^//[#@] sourceMappingURL=\S+\s*$", re.M)

_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\[)|/\*|\*|<!--|--\s|;;)|\s*$")
_PY_DOC = re.compile(r"\s*[rRuU]?(\"\"\"|''')(.*?)\1", re.S)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_NAME = re.compile(r"(?<!\w)[^\W\d]\w*")
_ACCESSOR = re.compile(r"\b(?:get|set|read|write|decode|encode|case|field|visit|parse)_?\w*?_?(\d+)\b[ \t]*\(", re.I)


def leading_comment(text: str) -> str:
    """The comments above the first code, a Python module's docstring included, without marks at line ends."""
    lines = []
    text = text.lstrip("﻿")
    rest = text.replace("\r\n", "\n").replace("\r", "\n")
    block = False
    for line in rest.split("\n"):
        if block or _COMMENT_LINE.match(line):
            lines.append(line)
            opened, closed = line.rfind("/*"), line.rfind("*/")
            block = opened > closed or (block and closed < 0)
            if closed >= 0 and line[closed + 2 :].strip():  # code follows on the line
                lines[-1] = line[: closed + 2]
                break
        elif (doc := _PY_DOC.match(line + "\n" + rest[rest.find(line) + len(line) + 1 :])) and not any(not x.lstrip().startswith("#") for x in lines if x.strip()):
            lines.append(doc.group(2))
            break
        else:
            break
    return "\n".join(lines)


def layout(text: str) -> str | None:
    """What the layout of a file shows: ``generated``, ``minified``, ``data`` or nothing."""
    bare = text.lstrip("﻿")
    prose = 0
    pieces, at = [], 0
    for m in _STRING.finditer(bare):
        if bare.count(" ", m.start(), m.end()) * 12 > m.end() - m.start():
            prose += m.end() - m.start()
        pieces.append(bare[at : m.start()])
        at = m.end()
    pieces.append(bare[at:])
    code = '""'.join(pieces)
    names = sum(map(len, _NAME.findall(code))) + prose
    signs = len("".join(bare.split()))
    if signs >= LAYOUT_CHARS and names < DATA_NAMES * signs:
        return "data"
    numbers = [int(n) for n in _ACCESSOR.findall(code)]
    runs, best = 0, 0
    for a, b in zip(numbers, numbers[1:]):
        runs = runs + 1 if b == a + 1 else 0
        best = max(best, runs)
    if best >= 2 and len(numbers) >= 0.5 * max(1, len(re.findall(r"\b(?:def|fn|func)\b|^\s+\w+\([^)]*\)\s*\{", code, re.M))):
        return "generated"
    lines = [x for x in code.split("\n") if x.strip() and not x.lstrip().startswith(("//", "/*", "*", "#"))]
    long = sum(len(x) for x in lines if len(x) > LONG_LINE and sum(map(str.isspace, x)) < 0.12 * len(x))
    if lines and long > 0.5 * sum(map(len, lines)):
        return "minified"
    return None


def third_party_place(path: str) -> tuple[str | None, str | None]:
    """``strict`` below a directory for third-party code only, ``loose`` below one that may be, and the package inside it that the file lies in."""
    dirs = [x.lower() for x in path.split("/")[:-1]]
    for i, d in enumerate(dirs[1:], 1):
        if d in VENDOR_DIRS:
            return "loose" if d in LOOSE_VENDOR_DIRS else "strict", dirs[i + 1] if i + 1 < len(dirs) else None
    return None, None


def says(head: str) -> str | None:
    """What a header says of its file, sentence by sentence: ``vendored``, ``generated``, ``hand`` or nothing.

    A sentence that speaks for hands takes back what it says itself, not what the others say.
    """
    hand = keep_off = False
    found = None
    for sentence in _SENTENCE.split(head):
        if _SAYS_HAND.search(sentence):
            hand = True
        elif _SAYS_VENDORED.search(sentence):
            return "vendored"
        elif _SAYS_GENERATED.search(sentence):
            found = "generated"
        elif _SAYS_KEEP_OFF.search(sentence):
            keep_off = True
    return found or ("hand" if hand else "generated" if keep_off else None)


def verdict(path: str, text: str | None) -> tuple[str | None, str | None]:
    """``generated``, ``minified``, ``vendored`` or ``data`` for a code file nobody wrote by hand, else nothing; and beside it the
    package that an undecided file lies in, if it lies in a loose third-party directory.

    Places are one piece of evidence: a package inside a third-party directory is vendored; elsewhere below such a
    directory it takes a licence, a banner or a release's name as well.
    """
    if text is None or not text.strip().strip("\ufeff\u200b").strip():
        return None, None
    parts = path.split("/")
    dirs, name = [x.lower() for x in parts[:-1]], parts[-1]
    place, package = third_party_place(path)
    if place == "strict" and package:
        return "vendored", None
    head = leading_comment(text)
    said = says(head)
    if said in ("vendored", "generated"):
        return said, None
    released = bool(_NAME_RELEASE.match(name))
    banner = bool(_BANNER.search(head))
    if place and (banner or released or _LICENCE.search(head)):
        return "vendored", None
    found = layout(text)
    if found:
        return found, None
    if said == "hand":
        return None, None
    if released or (banner and re.search(r"\bv?\d+\.\d+\.\d+\b", head)):
        return "vendored", None
    if _NAME_BUNDLE.search(name) or _MAP.search(text):
        return "minified", None
    if _NAME_GENERATED.search(name) or any(d in GENERATED_DIRS for d in dirs[1:]):
        return "generated", None
    return None, package


def _judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [verdict(p, t) for p, t in zip(part["path"], part["text"])]
        yield part.drop(columns="text").assign(kind=[k for k, _ in found], package=[p for _, p in found], placed=[third_party_place(p)[1] for p in part["path"]])


def is_code(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE_SUFFIXES)


def shared_subtrees(files: DataFrame) -> DataFrame:
    """``repo, dir``: files and directories whose whole subtree has the same Merkle hash in repositories of another owner.

    ``files`` has ``repo`` (``owner/name``), ``path``, ``digest`` of the content, ``seen`` (a time) and ``chars`` (the content's signs); files of fewer
    than ``SHARED_CHARS`` signs are only compared as parts of directories. A directory's hash is made of the names and hashes of its
    children, level by level from the deepest, as a sum that can be formed before the shuffle. Of equal subtrees the one
    seen first is taken for the original and not returned.
    """
    split = F.split("path", "/")
    nodes = files.select("repo", "seen", F.col("digest"), split.alias("parts"), F.size(split).alias("depth"), F.lit(1).cast("bigint").alias("files"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level = None
    leaves = files.where(F.col("chars") >= SHARED_CHARS)
    found = leaves.select("repo", F.col("path").alias("dir"), F.xxhash64("digest", F.lit("file")).alias("digest"), "seen")
    for depth in range(deepest, 1, -1):
        here = nodes.where(F.col("depth") == depth).select("repo", "seen", "digest", "parts", "files")
        level = here if level is None else here.unionByName(level)
        child = F.xxhash64(F.element_at("parts", -1), "digest")
        level = level.select("repo", "seen", child.alias("child"), F.slice("parts", F.lit(1), F.size("parts") - 1).alias("parts"), "files")
        level = level.groupBy("repo", "parts").agg(F.xxhash64(F.bit_xor("child"), F.count(F.lit(1)), F.sum("files")).alias("digest"), F.sum("files").alias("files"), F.min("seen").alias("seen"))
        level = level.select("repo", "seen", "digest", "parts", "files")
        if depth > 2:  # the outermost directory is the repository itself
            found = found.unionByName(level.select("repo", F.array_join("parts", "/").alias("dir"), "digest", "seen"))
    owner = F.substring_index("repo", "/", 1)
    shared = found.groupBy("digest").agg(F.min(owner).alias("a"), F.max(owner).alias("b"), F.min(F.struct("seen", "repo")).alias("origin")).where("a <> b")
    return found.join(shared.select("digest", F.col("origin.repo").alias("origin")), "digest").where("repo <> origin").select("repo", "dir").distinct()


def not_handwritten(records: DataFrame, docs: DataFrame) -> DataFrame:
    """``path, kind`` of every code file of ``records`` that nobody wrote by hand.

    ``kind`` is ``generated``, ``minified``, ``vendored`` or ``data``; a file that is or lies in a subtree shared with another owner's
    repository is ``vendored``, and so is one of a package in a loose third-party directory (``deps``) that another owner has in a
    third-party directory too. ``records`` may repeat a path; ``docs`` has the ``text`` of each ``path``, its ``source`` and ``collected_at``.
    Null, empty and blank texts, files without text and paths that are null or no code give no row.
    """
    code = docs.where(F.col("path").isNotNull() & is_code(F.col("path")) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    squeezed = F.regexp_replace("text", r"\s+", " ")
    signs = F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    rows = code.select("path", "text", F.col("source").alias("repo"), F.col("collected_at").alias("seen"), F.xxhash64(squeezed).alias("digest"), signs.alias("chars"))
    columns = f"path string, repo string, seen {docs.schema['collected_at'].dataType.simpleString()}, digest bigint, chars int, kind string, package string, placed string"
    judged = materialize(spread(rows).mapInPandas(_judge, columns), "judged")
    shared = shared_subtrees(judged.select("repo", "path", "digest", "seen", "chars")).withColumn("shared", F.lit(True))
    prefixes = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    under = judged.select("path", "repo", F.explode(prefixes).alias("dir")).join(shared, ["repo", "dir"]).select("path").distinct()
    owner = F.substring_index("repo", "/", 1)
    packages = judged.where("placed is not null").groupBy(F.col("placed").alias("package")).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a <> b").select("package")
    known = judged.where("package is not null").join(packages, "package", "left_semi").select("path")
    marked = judged.where("kind is not null").select("path", "kind").unionByName(under.unionByName(known).select("path", F.lit("vendored").alias("kind")))
    once = marked.groupBy("path").agg(F.min("kind").alias("kind"))
    return once.join(records.where("path is not null").select("path").distinct(), "path", "left_semi")
