"""Ignore files: patterns of the defaults, of the caller and of every directory above a path; the last match decides."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

#: What is ignored by default, and the ignore file that is read. Callers add patterns and file names of their own.
DEFAULT_PATTERNS = (".git/", ".venv/", "node_modules/", "__pycache__/", "*.pyc")
IGNORE_FILES = (".gitignore",)


def parse_lines(text: str) -> list[str]:
    """Patterns of an ignore file: trimmed lines that are neither blank nor comments."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


def rebase(directory: str, pattern: str) -> str:
    """A pattern of a nested ignore file as one of the root's: one with a slash before its end means a path below the directory, others any depth there."""
    if not directory:
        return pattern
    bare = pattern.removeprefix("!")
    steps = [directory] if "/" in bare[:-1] else [directory, "**"]
    return "!" * (bare != pattern) + "/" + "/".join([*steps, bare.lstrip("/")])


@lru_cache(maxsize=10_000)
def compile_pattern(pattern: str) -> tuple[re.Pattern, bool, bool]:
    """The pattern as a regular expression over root-relative paths, whether it only means directories, and whether it re-includes."""
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        else:
            out.append(re.escape(body[i]))
            i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out)), only_dirs, negated


class IgnoreMatcher:
    """Whether root-relative paths are ignored, given the patterns of each directory (``""`` is the root)."""

    def __init__(self, by_directory: dict[str, list[str]] | None = None, extra: tuple[str, ...] = ()) -> None:
        self.extra = list(extra)
        self.by_directory = by_directory or {}

    @classmethod
    def from_file(cls, path: str, extra: tuple[str, ...] = ()) -> IgnoreMatcher:
        """The patterns of one ignore file, as the root's; none if there is no such file."""
        file = Path(path)
        return cls({"": parse_lines(file.read_text("utf-8", "replace"))} if file.is_file() else {}, extra)

    def ignore_file(self, root: str, path: str) -> None:
        """Ignore a file of our own, a cache say, if it lies below the root."""
        full, base = Path(path).resolve(), Path(root).resolve()
        if base in full.parents:
            self.add_pattern("/" + full.relative_to(base).as_posix())

    @classmethod
    def for_workspace(cls, root: str, extra: tuple[str, ...] = (), names: tuple[str, ...] = IGNORE_FILES) -> IgnoreMatcher:
        """Read the ignore files below a folder; ignored directories are not entered."""
        found = cls({}, extra)
        stack = [""]
        while stack:
            here = stack.pop()
            folder = Path(root, here)
            lines = [p for name in names if (folder / name).is_file() for p in parse_lines((folder / name).read_text("utf-8", "replace"))]
            if lines:
                found.by_directory[here] = lines
            for child in folder.iterdir() if folder.is_dir() else ():
                rel = f"{here}/{child.name}".lstrip("/")
                if child.is_dir() and not child.is_symlink() and not found.is_ignored(rel, True):
                    stack.append(rel)
        return found

    def add_pattern(self, pattern: str) -> None:
        self.extra.append(pattern)

    @lru_cache(maxsize=10_000)  # noqa: B019 (a matcher lives as long as its scan)
    def _rules(self, chain: tuple[str, ...], extra: tuple[str, ...]) -> list[tuple[re.Pattern, bool, bool]]:
        """The compiled patterns that hold below a chain of directories with ignore files."""
        return [compile_pattern(p) for p in (*DEFAULT_PATTERNS, *extra, *(rebase(d, p) for d in chain for p in self.by_directory[d]))]

    def is_ignored(self, path: str, is_dir: bool = False) -> bool:
        path = path.replace("\\", "/").strip("/")
        if not path:
            return False
        parts = path.split("/")
        above = ("/".join(parts[:i]) for i in range(len(parts)))
        rules = self._rules(tuple(d for d in above if d in self.by_directory), tuple(self.extra))
        for depth in range(1, len(parts) + 1):  # what lies below an ignored directory is ignored
            prefix, dirs_too = "/".join(parts[:depth]), depth < len(parts) or is_dir
            last = next((negated for rx, only_dirs, negated in reversed(rules) if (dirs_too or not only_dirs) and rx.fullmatch(prefix)), True)
            if not last:
                return True
        return False
