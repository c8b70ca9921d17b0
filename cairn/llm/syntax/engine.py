"""A generalised LL recogniser over folded token strings.

A language maps each token to one character. Innermost brackets are folded first: a bracketed fragment becomes
one character that stands for the set of nonterminals the fragment derives, so equal sets look alike further out, and
strings of few shapes remain, whose results are remembered. A flat string is recognised top-down: every
nonterminal at a position is one node of the graph-structured stack, computed once, and has all positions where it may end,
so alternatives need no backtracking over choices made earlier.

Grammar notation: ``'x'`` a token, ``NAME`` a rule or token class, ``P[A] B[A] C[A]`` a round, square or curly fragment
deriving ``A`` (``*``: any), ``? * +`` as usual with all ends, ``?? **`` with the longest end only,
``SEMI`` an end of statement that a line end may give, ``NONL`` no line end here, ``NOFN`` no start of a function, class or block, ``END`` the end of the string.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

ERROR = "\x01"
NEWLINE = "\n"
STOP = "\0"
_FIRST_TOKEN = 0xE000
_FIRST_GROUP = 0xF0000
_KINDS = {"(": "P", "[": "B", "{": "C"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_BRACKETS = re.compile(r"([()\[\]{}])")
_DSL = re.compile(r"\s*('[^']+'|\w+\[[\w*]*\]|\w+|\*\*|\?\?|[()|?*+])")

Run = Callable[[str, int], tuple]

#: Calls that one token may nest. Long chains without brackets (else if, conditional expressions) nest Python calls; their frames lie
#: on the heap, so the limit follows the length of the text and is never reached.
CALLS_PER_TOKEN = 64


class Language:
    """One grammar with its token classes. ``fragments`` lists per bracket kind the rules tried on its content."""

    def __init__(self, grammar: str, reserved: frozenset[str], fragments: dict[str, tuple[str, ...]], operators: str, classes: dict[str, str], chunked: dict[str, str], newlines: bool = False) -> None:
        self.rules: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", grammar).strip().split("\n"):
            name, _, body = line.partition(" = ")
            self.rules[name.strip()] = body
        words = sorted(set(re.findall(r"'([^']+)'", grammar)) | set(operators.split()) | reserved)
        self.char = {w: chr(_FIRST_TOKEN + i) for i, w in enumerate(words)}
        self.char.update({b: b for b in "()[]{}"})
        self.word_chars = frozenset(self.char[w] for w in words if w[0].isalpha() or w[0] == "_")
        open_words = frozenset(c for w, c in self.char.items() if (w[0].isalpha() or w[0] == "_") and w not in reserved)
        self.classes = {k: frozenset(v) for k, v in classes.items()}
        self.classes["ID"] = frozenset("i") | open_words
        self.classes["IDN"] = frozenset("i") | self.word_chars
        self.fragments, self.chunked, self.newlines = fragments, chunked, newlines
        self.compiled: dict[str, Run] = {}
        self.firsts: dict[str, tuple[frozenset, bool]] = {}
        self.memo: dict[tuple[str, int], tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.groups: dict[tuple[str, str], str] = {}
        self.of_mask: dict[tuple[str, frozenset], str] = {}
        self.kind: dict[str, str] = {}
        self.derives: dict[str, frozenset] = {}
        self.results: dict[tuple[str, str], bool] = {}

    # -- grammar to functions ------------------------------------------------------------------------------

    def rule(self, name: str) -> Run:
        if name in self.compiled:
            return self.compiled[name]
        body: list[Run] = []
        memo_of = self

        def run(s: str, i: int) -> tuple:
            key = (name, i)
            got = memo_of.memo.get(key)
            if got is None:
                memo_of.memo[key] = ()  # a left-recursive use would find nothing
                got = memo_of.memo[key] = body[0](s, i)
            return got

        self.compiled[name] = run
        tree = self._parse(_DSL.findall(self.rules[name]))
        body.append(self._build(tree))
        return run

    def _parse(self, tokens: list[str]):
        at = 0

        def alternatives():
            nonlocal at
            found = [sequence()]
            while at < len(tokens) and tokens[at] == "|":
                at += 1
                found.append(sequence())
            return ("alt", found) if len(found) > 1 else found[0]

        def sequence():
            nonlocal at
            items = []
            while at < len(tokens) and tokens[at] not in "|)":
                t = tokens[at]
                at += 1
                if t == "(":
                    item = alternatives()
                    at += 1
                else:
                    item = ("t", t)
                while at < len(tokens) and tokens[at] in ("?", "*", "+", "??", "**"):
                    item = (tokens[at], item)
                    at += 1
                items.append(item)
            return ("seq", items)

        return alternatives()

    def _first(self, tree) -> tuple[frozenset, bool]:
        """Token characters (or fragment kinds) that may come first, and whether nothing may."""
        op, x = tree
        if op == "alt":
            each = [self._first(t) for t in x]
            return frozenset().union(*(f for f, _ in each)), any(e for _, e in each)
        if op == "seq":
            out = frozenset()
            for t in x:
                f, empty = self._first(t)
                out |= f
                if not empty:
                    return out, False
            return out, True
        if op in ("?", "*", "??", "**"):
            return self._first(x)[0], True
        if op == "+":
            return self._first(x)
        if x[0] == "'":
            return frozenset(self.char[x[1:-1]]), False
        if x[1:2] == "[":
            return frozenset(x[0]), False
        if x in self.classes:
            return self.classes[x], False
        if x in ("SEMI", "NONL", "END", "NOFN"):
            return frozenset(), True
        if x not in self.firsts:
            self.firsts[x] = (frozenset(), True)
            self.firsts[x] = self._first(self._parse(_DSL.findall(self.rules[x])))
        return self.firsts[x]

    def _token(self, chars: frozenset) -> Run:
        if self.newlines:

            def run(s: str, i: int) -> tuple:
                c = s[i]
                while c == NEWLINE:
                    i += 1
                    c = s[i]
                return (i + 1,) if c in chars else ()
        else:

            def run(s: str, i: int) -> tuple:
                return (i + 1,) if s[i] in chars else ()

        return run

    def _fragment(self, kind: str, wanted: str) -> Run:
        language = self

        def run(s: str, i: int) -> tuple:
            c = s[i]
            while c == NEWLINE:
                i += 1
                c = s[i]
            if language.kind.get(c) != kind or not (wanted == "*" or wanted in language.derives[c]):
                return ()
            return (i + 1,)

        return run

    def _build(self, tree) -> Run:
        op, x = tree
        if op == "t":
            if x[0] == "'":
                return self._token(frozenset(self.char[x[1:-1]]))
            if x[1:2] == "[":
                return self._fragment(x[0], x[2:-1])
            if x in self.classes:
                return self._token(self.classes[x])
            if x == "NONL":
                return lambda s, i: () if s[i] == NEWLINE else (i,)
            if x == "NOFN":
                barred, kind = {self.char.get("function"), self.char.get("class")}, self.kind

                def open_(s: str, i: int) -> tuple:
                    j = i
                    while s[j] == NEWLINE:
                        j += 1
                    return () if s[j] in barred or kind.get(s[j]) == "C" else (i,)

                return open_
            if x == "END":
                return lambda s, i: (i,) if s[i:].strip(NEWLINE) == STOP else ()
            if x == "SEMI":
                semi = self.char[";"]

                def end(s: str, i: int) -> tuple:
                    j = i
                    while s[j] == NEWLINE:
                        j += 1
                    if s[j] == semi:
                        return (j + 1,)
                    return (i,) if j > i or s[j] == STOP else ()

                return end
            return self.rule(x)
        if op == "seq":
            items = [self._build(t) for t in x]
            if len(items) == 1:
                return items[0]

            def sequence(s: str, i: int) -> tuple:
                here = (i,)
                for f in items:
                    if len(here) == 1:
                        here = f(s, here[0])
                    else:
                        here = tuple({e for j in here for e in f(s, j)})
                    if not here:
                        return ()
                return here

            return sequence
        if op == "alt":
            ways = [(*self._first(t), self._build(t)) for t in x]
            table: dict[str, list[Run]] = {}
            language = self

            def choose(s: str, i: int) -> tuple:
                c, j = s[i], i
                while c == NEWLINE:
                    j += 1
                    c = s[j]
                c = language.kind.get(c, c)
                fs = table.get(c)
                if fs is None:
                    fs = table[c] = [f for first, empty, f in ways if empty or c in first]
                if len(fs) == 1:
                    return fs[0](s, i)
                found: tuple = ()
                for f in fs:
                    got = f(s, i)
                    if got:
                        found = tuple({*found, *got}) if found else got
                return found

            return choose
        inner = self._build(x)
        if op == "?":
            return lambda s, i: tuple({i, *inner(s, i)})
        if op == "??":
            return lambda s, i: inner(s, i) or (i,)
        if op == "**":

            def longest(s: str, i: int) -> tuple:
                while got := inner(s, i):
                    j = max(got)
                    if j == i:
                        break
                    i = j
                return (i,)

            return longest

        def repeat(s: str, i: int) -> tuple:
            seen = set() if op == "+" else {i}
            todo = [i]
            while todo:
                for e in inner(s, todo.pop()):
                    if e not in seen:
                        seen.add(e)
                        todo.append(e)
            return tuple(seen)

        return repeat

    # -- recognition ---------------------------------------------------------------------------------------

    def matches(self, name: str, content: str) -> bool:
        """Whether the folded ``content`` as a whole derives the rule."""
        key = (name, content)
        got = self.results.get(key)
        if got is None:
            got = self.results[key] = self._matches(name, content)
        return got

    def _matches(self, name: str, content: str) -> bool:
        part = self.chunked.get(name)
        if part:  # long lists of statements: piece by piece, so that pieces seen before cost nothing
            pieces = self._pieces(content)
            if len(pieces) > 1 and all(self.matches(part, p) for p in pieces[:-1]) and self.matches(name, pieces[-1]):
                return True
        s = content + STOP
        first, empty = self._first(("t", name))
        start = content.lstrip(NEWLINE)
        if start:
            c = start[0]
            if self.kind.get(c, c) not in first and not empty:
                return False
        elif not empty:
            return False
        kept, self.memo = self.memo, {}
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10_000 + CALLS_PER_TOKEN * len(s)))
        try:
            ends = self.rule(name)(s, 0)
        finally:
            self.memo = kept
            sys.setrecursionlimit(limit)
        return any(s[e:].strip(NEWLINE) == STOP for e in ends)

    def _pieces(self, content: str) -> list[str]:
        """The content cut after semicolons, and after a line that ends with a curly fragment."""
        out, start = [], 0
        semi, kind = self.char[";"], self.kind
        for i, c in enumerate(content):
            if c == semi or (c == NEWLINE and i and kind.get(content[i - 1]) == "C"):
                out.append(content[start : i + 1])
                start = i + 1
        if start < len(content) or not out:
            out.append(content[start:])
        return out

    def fold(self, tokens: str) -> str | None:
        """Replace all bracketed fragments; nothing if brackets don't match."""
        stack: list[tuple[str, list[str]]] = [("", [])]
        for piece in _BRACKETS.split(tokens):
            if piece in _KINDS:
                stack.append((piece, []))
            elif piece in _CLOSES:
                opened, inside = stack.pop()
                if opened != _CLOSES[piece] or not stack:
                    return None
                stack[-1][1].append(self.group(opened, "".join(inside)))
            elif piece:
                stack[-1][1].append(piece)
        return "".join(stack[0][1]) if len(stack) == 1 else None

    def group(self, bracket: str, content: str) -> str:
        key = (bracket, content)
        c = self.groups.get(key)
        if c is None:
            kind = _KINDS[bracket]
            mask = frozenset(r for r in self.fragments[kind] if self.matches(r, content))
            c = self.of_mask.get((kind, mask))
            if c is None:
                c = self.of_mask[kind, mask] = chr(_FIRST_GROUP + len(self.of_mask))
                self.kind[c], self.derives[c] = kind, mask
            self.groups[key] = c
        return c

    def trim(self, limit: int = 400_000) -> None:
        """Forget remembered results when there are very many; only speed depends on them."""
        if len(self.groups) + len(self.results) > limit:
            self.groups.clear()
            self.results.clear()
