"""Column functions on paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts and file endings of generated or third-party files, languages by ending.
GENERATED_PARTS = (
    ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "build", "coverage", "dist", "node_modules", "site-packages", "vendor", "vendors", "venv",
)
GENERATED_ENDINGS = (".bundle.css", ".bundle.js", ".generated.css", ".generated.js", ".map", ".min.css", ".min.js")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slashes(path: Column | str) -> Column:
    return F.translate(_col(path), "\\", "/")


def file_name(path: Column | str) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def stem(path: Column | str) -> Column:
    """The file name without its last ending; a name that begins with its only dot has an empty stem."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def without_ending(path: Column | str) -> Column:
    """The path up to its last dot, wherever that is."""
    return F.regexp_replace(slashes(path), r"\.[^.]*$", "")


def parent(path: Column | str) -> Column:
    """The directory, ``.`` for a bare name."""
    p = slashes(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def ending(path: Column | str) -> Column:
    """The lower-case ending with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return known[ending(path)]


def ancestors(path: Column | str) -> Column:
    """All directories above a path, outermost first, beginning with the root as an empty text."""
    parts = F.split(slashes(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def is_generated_or_vendor(path: Column | str) -> Column:
    p = F.lower(slashes(path))
    by_part = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, GENERATED_PARTS)))
    by_ending = F.lit(False)
    for e in GENERATED_ENDINGS:
        by_ending = by_ending | p.endswith(e)
    return F.coalesce(by_part | by_ending, F.lit(False))


def is_dunder(name: Column | str) -> Column:
    return (F.length(_col(name)) > 4) & _col(name).startswith("__") & _col(name).endswith("__")


def is_public_method(name: Column | str, qualified_name: Column | str) -> Column:
    """A name without underscore whose owner, the part before the last dot, begins with a capital."""
    owner = F.regexp_extract(_col(qualified_name), r"([^.]*)\.[^.]*$", 1)
    return F.coalesce(~_col(name).startswith("_") & owner.rlike(r"^\p{Lu}"), F.lit(False))


def short_label(text: Column | str, limit: int = 28) -> Column:
    """The last part of a path, cut with an ellipsis."""
    last = file_name(text)
    return F.when(F.length(last) > limit, F.concat(F.substring(last, 1, limit - 1), F.lit("…"))).otherwise(last)


def truncated(text: Column | str, limit: int, keep: int, mark: str) -> Column:
    """Texts above ``limit`` characters cut to ``keep`` and marked."""
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, keep), F.lit(mark))).otherwise(t)
