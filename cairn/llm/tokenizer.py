"""Byte-pair encoding of a corpus with a public vocabulary, by replaying the merges over distinct words.

Texts are split into words by the tokenizer's pattern. ``MergeReplay`` encodes many distinct words at once: an
inverted index leads from each mergeable pair to the positions where it occurs, merges are applied in rank
order, and only the neighbours of a merge are looked at again.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
#: The same for texts of ASCII alone, where the standard library's engine is faster.
ASCII_PATTERN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s")
#: Words of a hash bucket that are replayed together; it bounds what a task holds, not the result.
REPLAY_WORDS = 50_000
#: Characters of text per block; it bounds what a task holds, not the result.
BLOCK_CHARS = 4_000_000


def words_of(text: str) -> list[str]:
    """The pieces that are encoded one by one; joined they give the text."""
    return (ASCII_PATTERN if text.isascii() else PATTERN).findall(text)


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to all executors; the name by which tasks ask ``shipped`` for it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Where a vocabulary file lies on this machine."""
    return SparkFiles.get(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes batches of words; the vocabulary is read once per worker process."""

    _by_path: dict[str, MergeReplay] = {}

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    @classmethod
    def of(cls, path: str) -> MergeReplay:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _merged(self, a: int, b: int) -> int:
        """The token that ``a`` and ``b`` make, or -1."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return got

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        whole = [w.encode("utf-8", "surrogatepass") for w in words]
        ranks = self.ranks
        # a word that is a token as a whole needs no replay: its merges end there
        out: list[list[int] | None] = [[ranks[w]] if w in ranks else None for w in whole]
        sym: list[int] = []
        ends: list[tuple[int, int]] = []
        for i, w in enumerate(whole):
            if out[i] is None:
                start = len(sym)
                sym += [self.bytes[b] for b in w]
                sym.append(-1)  # a wall between words
                ends.append((i, start))
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merged, known = self._merged, self.pairs
        where: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0:
                m = known.get((a, b))
                if m is None:
                    m = merged(a, b)
                if m >= 0:
                    where.setdefault(m, []).append(p)
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            m = heapq.heappop(queue)
            at = where.pop(m)
            at.sort()
            for p in at:
                a, q = sym[p], after[p]
                if a < 0 or q >= n or sym[q] < 0 or merged(a, sym[q]) != m:
                    continue  # a neighbour's merge took part of it
                sym[p] = m
                sym[q] = -2  # swallowed
                r = after[p] = after[q]
                if r < n:
                    before[r] = p
                    if (b := sym[r]) >= 0:
                        k = known.get((m, b))
                        if k is None:
                            k = merged(m, b)
                        if k >= 0:
                            if k not in where:
                                where[k] = []
                                heapq.heappush(queue, k)
                            where[k].append(p)
                o = before[p]
                if o >= 0 and (a := sym[o]) >= 0:
                    k = known.get((a, m))
                    if k is None:
                        k = merged(a, m)
                    if k >= 0:
                        if k not in where:
                            where[k] = []
                            heapq.heappush(queue, k)
                        where[k].append(o)
        for i, p in ends:
            ids = []
            while sym[p] != -1:
                ids.append(sym[p])
                p = after[p]
            out[i] = ids
        return out


class WordCounts:
    """Token counts of words, remembered between batches up to a bounded number."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        self.replay, self.limit, self.known = MergeReplay.of(path), limit, {}

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(set(words))
        self.known.update(zip(new, map(len, self.replay.encode(new))))


class _Numbers(dict):
    """Numbers for words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


def _split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as numbers of words in a dictionary per block; a block's dictionary follows its rows."""
    task = TaskContext.get()
    prefix = task.partitionId() if task else 0
    block, chars, index = 0, 0, _Numbers()

    def dictionary() -> pd.DataFrame:
        words = [w.encode("utf-8", "surrogatepass") for w in index]
        return pd.DataFrame({"block": f"{prefix}-{block}", "key": [None] * len(words), "at": range(len(words)), "word": words, "words": [None] * len(words)})

    for part in parts:
        rows: list[np.ndarray | list] = []
        names: list[str] = []
        start = 0
        for i, text in enumerate(part["text"]):
            words = words_of(text) if text else []
            chars += len(text or "")
            rows.append(np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)))
            names.append(f"{prefix}-{block}")
            if chars >= BLOCK_CHARS or i == len(part) - 1:
                keys = part["key"].iloc[start : i + 1]
                yield pd.DataFrame({"block": names, "key": keys.to_numpy(), "at": pd.array([None] * len(rows), dtype="Int32"), "word": None, "words": rows})
                rows, names, start = [], [], i + 1
            if chars >= BLOCK_CHARS:
                yield dictionary()
                block, chars, index = block + 1, 0, _Numbers()
    if index:
        yield dictionary()


def _replay_udf(name: str):
    """Replays the words of one hash bucket, ``REPLAY_WORDS`` at a time under one index."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replay = MergeReplay.of(shipped(name))
        held: list[bytes] = []

        def replayed() -> pd.DataFrame:
            ids = replay.encode([w.decode("utf-8", "surrogatepass") for w in held])
            return pd.DataFrame({"word": held, "ids": [np.array(x, dtype=np.int32) for x in ids]})

        for part in parts:
            held += part["word"].tolist()
            if len(held) >= REPLAY_WORDS:
                yield replayed()
                held = []
        if held:
            yield replayed()

    return encode


def _assemble(texts: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
    ids = np.empty(len(dictionary), dtype=object)
    for at, x in zip(dictionary["at"], dictionary["ids"]):
        ids[at] = x
    sizes = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(ids) else sizes
    flat = np.concatenate(list(ids)) if len(ids) else np.zeros(0, dtype=np.int32)
    rows = []
    for words in texts["words"]:
        w = np.asarray(words, dtype=np.int64)
        n = sizes[w]
        total = int(n.sum())
        gaps = np.repeat(starts[w] - np.concatenate(([0], np.cumsum(n)))[:-1], n) if len(w) else np.zeros(0, dtype=np.int64)
        rows.append(flat[np.arange(total) + gaps])
    return pd.DataFrame({"key": texts["key"], "ids": rows})


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, ids``: the token ids of every text, without special tokens; null and empty texts give the empty list.

    Every row of ``docs`` gives one row, rows with equal or null keys included. The distinct words of the whole
    corpus are encoded once, in hash buckets, by ``MergeReplay``; the texts travel as word numbers of blocks
    of bounded size, and each block gets the ids of its own words back.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    split = materialize(spread(rows).mapInPandas(_split, f"block string, key {kind}, at int, word binary, words array<int>"), "words")
    dictionary = split.where("word is not null").select(F.col("block").alias("home"), "at", "word")
    vocabulary = dictionary.select("word").distinct().mapInPandas(_replay_udf(ship(docs.sparkSession, tokenizer)), "word binary, ids array<int>")
    known = dictionary.join(vocabulary, "word").select("home", "at", "ids")
    texts = split.where("words is not null").select("block", "key", "words")
    out = f"key {kind}, ids array<int>"
    joined = texts.groupBy("block").cogroup(known.groupBy("home")).applyInPandas(_assemble, out)
    return joined.select(F.col("key").alias(key), "ids")
