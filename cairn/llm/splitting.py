"""Cut long texts into pieces of at most so many tokens, at natural boundaries, with overlap.

A stretch that exceeds the limit minus the overlap is cut at the strongest boundary near its middle, and its
halves in turn. Boundaries lie between the words of the tokenizer's pattern, where the parts have the same tokens
as the whole; only inside words of very many tokens the cut falls between characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokenizer import TOKENIZER, WordCounts, ship, shipped, words_of
from cairn.session import spread

LIMIT = 2000
OVERLAP = 100
#: A word of more tokens than this is cut between characters, so that overlaps and cuts stay near their aim.
WORD_TOKENS = 32
PIECES = "key {}, piece int, start_char int, end_char int, overlap_chars int, n_tokens int, text string"

#: Boundary strengths: a new section or top-level definition, a paragraph, a statement that ends a block, a line,
#: a sentence, a clause, white space.
_SECTION = re.compile(r"\n[ \t\r]*\n(?=#|def |class |async def |@|func |fn |pub |impl |trait |struct |enum |function |export |const |type |interface |//|/\*|---)|\n(?=#{1,6} )")
_PARAGRAPH = re.compile(r"\n[ \t\r\f\v]*\n")
_DEDENT = re.compile(r"\n(?=[^\s])|(?<=[};])\n")
_LINE = re.compile(r"\n|\r|[  \x85]")
_SENTENCE = re.compile(r"[.!?…]['\")\]»”]*(?=\s)|[。！？؟।]")
_CLAUSE = re.compile(r"[,;:،、，](?=\s)|[、，]")


def _strengths(text: str, mark_of: dict[int, int]) -> list[int]:
    """Of each mark (a possible cut before a character) its strength."""
    out = [1 if at < len(text) and text[at].isspace() else 0 for at in mark_of]
    for level, pattern in ((2, _CLAUSE), (3, _SENTENCE), (4, _LINE), (5, _DEDENT), (6, _PARAGRAPH), (7, _SECTION)):
        for m in pattern.finditer(text):
            k = mark_of.get(m.end())
            if k is None:  # inside a word of white space: its end or start are as good
                k = mark_of.get(m.start())
            if k is not None and out[k] < level:
                out[k] = level
    return out


def _units(text: str, counts: WordCounts) -> tuple[list[int], list[int], bool]:
    """Where units start (characters, with the end of the text), the tokens before each, and whether all are words."""
    words = words_of(text)
    counts.learn(words)
    sizes = list(map(counts.known.__getitem__, words))
    if max(sizes) <= WORD_TOKENS:
        return list(accumulate(map(len, words), initial=0)), list(accumulate(sizes, initial=0)), True
    at, total = [0], [0]
    for w, n in zip(words, sizes):
        if n <= WORD_TOKENS:
            at.append(at[-1] + len(w))
            total.append(total[-1] + n)
            continue
        # equal slices of a long word, each counted as it would be encoded alone
        step = max(1, len(w) * WORD_TOKENS // (2 * n))
        slices = [w[i : i + step] for i in range(0, len(w), step)]
        for piece, n_piece in zip(slices, map(len, counts.replay.encode(slices))):
            at.append(at[-1] + len(piece))
            total.append(total[-1] + n_piece)
    return at, total, False


def split_text(text: str, counts: WordCounts, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """``start, end, overlap, tokens`` of each piece: characters from ``start`` to ``end``, of which the first
    ``overlap`` repeat the piece before. A text within the limit is one piece."""
    if len(text.encode("utf-8", "surrogatepass")) <= limit:  # no token is shorter than a byte
        counts.learn(words := words_of(text))
        return [(0, len(text), 0, sum(counts.known[w] for w in words))]
    at, total, exact = _units(text, counts)
    if total[-1] <= limit and exact:
        return [(0, len(text), 0, total[-1])]
    if not exact and sum(counts.known[w] for w in words_of(text)) <= limit:
        return [(0, len(text), 0, sum(counts.known[w] for w in words_of(text)))]
    strength = _strengths(text, {c: k for k, c in enumerate(at)})
    room = limit - overlap
    pieces: list[tuple[int, int]] = []
    stack = [(0, len(at) - 1)]
    while stack:
        lo, hi = stack.pop()
        n = total[hi] - total[lo]
        if n <= room or hi - lo == 1:
            pieces.append((lo, hi))
            continue
        middle, reach = total[lo] + n / 2, n / 4
        near = range(max(lo + 1, bisect_left(total, middle - reach)), min(hi, bisect_right(total, middle + reach)))
        if not near:  # one unit spans the middle half
            near = range(lo + 1, hi)
        k = max(near, key=lambda k: (strength[k], -abs(total[k] - middle)))
        stack += [(k, hi), (lo, k)]
    out = []
    for i, (lo, hi) in enumerate(pieces):
        first = lo
        if i:
            floor = pieces[i - 1][0]
            while first > floor and total[lo] - total[first - 1] <= overlap and total[hi] - total[first - 1] <= limit:
                first -= 1
        # white space that now ends a text may be encoded in fewer words, and slices of a long word may meet again
        bare = hi if exact else first
        while bare > first and text[at[bare - 1] : at[bare]].isspace():
            bare -= 1
        counts.learn(tail := words_of(text[at[bare] : at[hi]]))
        n = total[bare] - total[first] + sum(counts.known[w] for w in tail)
        out.append((at[first], at[hi], at[lo] - at[first], n))
    return out


def split_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = TOKENIZER, with_text: bool = True,
) -> DataFrame:
    """Pieces of every text above ``limit`` tokens: ``key, piece`` (from 0), ``start_char, end_char`` of the text,
    ``overlap_chars`` that repeat the piece before, ``n_tokens`` and ``text`` (null unless ``with_text``).

    Null and empty texts and texts within the limit have no rows. Texts of no more bytes than the limit are
    passed over in the scan, as no token is shorter than a byte. Rows with equal keys are cut one by one.
    """
    kind, name = docs.schema[key].dataType.simpleString(), ship(docs.sparkSession, tokenizer)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WordCounts(shipped(name))
        for part in parts:
            rows = []
            for k, t in zip(part["key"], part["text"]):
                pieces = split_text(t, counts, limit, overlap)
                if len(pieces) > 1:
                    rows += [(k, i, a, b, o, n, t[a:b] if with_text else None) for i, (a, b, o, n) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["key", "piece", "start_char", "end_char", "overlap_chars", "n_tokens", "text"])

    long = docs.where(F.octet_length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return spread(long).mapInPandas(cut, PIECES.format(kind)).withColumnRenamed("key", key)
