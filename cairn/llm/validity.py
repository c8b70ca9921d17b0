"""Source files that are no valid source of the language their name promises.

A file is parsed with the grammar of its suffix. If that fails, its tokens rank all other suffixes, those of the same family
included, and the file is parsed with their grammars in that order: a success tells that the suffix is wrong, failures
everywhere that the file is damaged.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.syntax.ecmascript import EcmaScript
from cairn.llm.syntax.go import Go
from cairn.llm.syntax.rust import Rust
from cairn.session import materialize, spread

#: The language of each suffix.
LANGUAGE_OF = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust",
}
_MARKS = re.compile(
    r"\b(?:def|elif|self|None|import|from|package|func|fn|impl|let|mut|const|function|interface|type|export|return|require|pub|use|struct|var|class)\b|:=|=>|->|::|</|/>|;$|:$|[{}]", re.M
)
#: Words and signs that speak for a language, used only to order the attempts.
_SCRIPT = {"const", "let", "function", "=>", ";", "{", "}", "return", "class", "var"}
_TYPED = {"interface", "type"}
_TAGS = {"</", "/>"}
_SPEAKS = {
    "py": {"def", "elif", "self", "None", "import", "from", ":", "class", "->"},
    "js": _SCRIPT | {"export", "import"}, "jsx": _SCRIPT | {"export", "import"} | _TAGS, "cjs": _SCRIPT | {"require"},
    "ts": _SCRIPT | {"export", "import"} | _TYPED, "tsx": _SCRIPT | {"export", "import"} | _TYPED | _TAGS,
    "go": {"package", "func", ":=", "import", "{", "}", "type", "struct", "var"},
    "rs": {"fn", "let", "mut", "pub", "use", "impl", "::", "->", ";", "{", "}", "struct"},
}
#: The grammar of each suffix; of grammars that take a file the one with the fewest extensions names its language.
_GRAMMAR = {"mjs": "js"}


class Parsers:
    """One parser per suffix, made when it is first needed."""

    def __init__(self) -> None:
        self.made: dict[str, object] = {}

    def of(self, suffix: str):
        if suffix not in self.made:
            self.made[suffix] = {
                "js": lambda: EcmaScript(), "mjs": lambda: self.of("js"), "cjs": lambda: EcmaScript(script=True), "jsx": lambda: EcmaScript(jsx=True),
                "ts": lambda: EcmaScript(ts=True), "tsx": lambda: EcmaScript(ts=True, jsx=True), "go": Go, "rs": Rust,
            }[suffix]()
        return self.made[suffix]

    def valid(self, suffix: str, text: str) -> bool:
        if suffix == "py":
            return python_valid(text)
        return self.of(suffix).check(text)


def python_valid(text: str) -> bool:
    """Whether the interpreter's own grammar takes the text (a byte-order mark aside)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text.removeprefix("﻿"), "text", "exec", dont_inherit=True, optimize=0)
    except (SyntaxError, ValueError, MemoryError, RecursionError, OverflowError):
        return False
    return True


def ranked(text: str) -> list[str]:
    """Suffixes, one for each grammar, in the order in which the tokens of a text speak for them; of equals the one with fewer words."""
    counts: dict[str, int] = {}
    for mark in _MARKS.findall(text):
        counts[mark] = counts.get(mark, 0) + 1
    return sorted(_SPEAKS, key=lambda s: (-sum(counts.get(w, 0) for w in _SPEAKS[s]), len(_SPEAKS[s])))


def diagnose(suffix: str, text: str, parsers: Parsers) -> tuple[bool, str | None]:
    """Whether a text is valid, and if not, the suffix of the first grammar that takes it."""
    if parsers.valid(suffix, text):
        return True, None
    for other in ranked(text):
        if other != _GRAMMAR.get(suffix, suffix) and parsers.valid(other, text):
            return False, other
    return False, None


_PARSERS: list[Parsers] = []


def _check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not _PARSERS:
        _PARSERS.append(Parsers())
    for part in parts:
        part = part[part["text"].map(lambda t: bool(t.strip().strip("\ufeff\u200b").strip())).astype(bool)]
        if part.empty:
            continue
        found = [diagnose(s, t, _PARSERS[0]) for s, t in zip(part["suffix"], part["text"])]
        yield pd.DataFrame({"path": part["path"], "repo": part["repo"], "suffix": part["suffix"], "valid": [v for v, _ in found], "parses_as": [o for _, o in found]})


def syntax_status(records: DataFrame, docs: DataFrame) -> DataFrame:
    """``path, repo, language, valid, parses_as, suffix_as, fault`` of every code file of ``records`` that has a text.

    ``fault`` is ``wrong_suffix`` if the grammar of another suffix takes the file (``parses_as`` is its language, ``suffix_as`` the suffix: JSX in a
    ``.js`` file is ``jsx``, a script in an ``.mjs`` file ``cjs``), ``corrupt`` if none does, null for valid files. Null, empty and blank texts and paths that are null or no code have no row; ``records`` may
    repeat a path. Syntax is that of the running Python, of ECMAScript modules (``.cjs``: scripts), TypeScript, Go and Rust.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = docs.where(F.col("path").isNotNull() & F.col("text").rlike(r"[^\s\x{FEFF}\x{200B}\x{00A0}\x{3000}\x{0085}\x{2028}\x{2029}]"))
    rows = rows.select("path", F.col("source").alias("repo"), suffix.alias("suffix"), "text").where(F.col("suffix").isin(*LANGUAGE_OF))
    checked = spread(rows).mapInPandas(_check, "path string, repo string, suffix string, valid boolean, parses_as string")
    language = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    fault = F.when(~F.col("valid"), F.when(F.col("parses_as").isNull(), "corrupt").otherwise("wrong_suffix"))
    out = checked.select("path", "repo", language[F.col("suffix")].alias("language"), "valid", language[F.col("parses_as")].alias("parses_as"), F.col("parses_as").alias("suffix_as"), fault.alias("fault"))
    return materialize(out, "syntax").join(records.where("path is not null").select("path").distinct(), "path", "left_semi")


def fault_rates(status: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, wrong_suffix, share`` per repository and language."""
    count = lambda c: F.count(F.when(c, True))
    out = status.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), count(~F.col("valid")).alias("invalid"), count(F.col("fault") == "wrong_suffix").alias("wrong_suffix")
    )
    return out.withColumn("share", F.col("invalid") / F.col("files"))
