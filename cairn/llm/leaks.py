"""Evaluation passages that appear, whole or in part, in corpus documents.

Words are runs of letters and digits, in lower case. Spaced seeds propose: fixed masks take three words out of five and pass
over the others, and one hash serves all masks, so that a seed is met again where words between its own were changed, dropped
or added. Hashes of the documents' seeds are joined with those of the passages. The stretches around the hits are decided by
the longest common subsequence of words and by how rare its words are in the documents: texts of one style share common words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize, spread

WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
#: The distances between the three words of a seed: all that fit into five words. Half of a passage's words lie two apart on
#: average, so some three of them lie in five, however they are spread.
MASKS = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1))
GAP = 1 + max(map(sum, MASKS))
#: The share of a passage's words that a stretch must have in order, and the share of their rarity: half of the words by
#: number may be the frame that all texts of one style have. Words left at random carry about their share of the rarity.
SHARE = 0.5
RARE_SHARE = 0.43
#: Words of a stretch for one of the passage: as many may be added as there are. Shorter passages need all words in a row.
STRETCH = 2
SHORT = 7
#: Bits of the filters of passages' words and seeds that every task has (8 MB each); more passages only let more false ones through.
FILTER_BITS = 1 << 26
_BITMAP = 1 << 15
#: Places of seeds are told in units of so many words, and stretches travel in rows of at most so many blocks.
UNIT = 64
BLOCKS = 8
#: Up to so many seeds of passages are broadcast, and the passages with them (six seeds to a word); more are joined by a shuffle in which
#: hot seeds are dealt to so many keys.
SENT_SEEDS = 1_000_000
SALTS = 16
#: Documents for a task that compares stretches.
TASK_ROWS = 200_000
_MIX = tuple(np.int64(x) for x in (-7046029254386353131, -4417276706812531889, 1609587929392839161))


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def _number(hashed: int) -> int:
    """A word's number, never 0."""
    return (hashed & 0x7FFFFFFE) + 1


def _bits(values: np.ndarray | int) -> np.ndarray | int:
    """The bit of the filter that a word's hash or a seed has: not the bits that make a word's number."""
    return (values >> 35) & (FILTER_BITS - 1)


def _held(filter_: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filter_[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def seeds_of(ids: np.ndarray, short: bool, filter_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds of numbered words and the places of their first words; words numbered 0 are in no seed.

    ``short`` asks for single words and neighbours too, the seeds of passages of one and two words.
    """
    ids = ids.astype(np.int64)
    found, places = [], []
    with np.errstate(over="ignore"):
        for gaps in (((), (1,)) if short else ()) + MASKS:
            length = len(ids) - sum(gaps)
            if length <= 0:
                continue
            real, seed, at = ids[:length] > 0, ids[:length] * _MIX[0] + len(gaps), 0
            for gap, mix in zip(gaps, _MIX[1:]):
                at += gap
                word = ids[at : at + length]
                real = real & (word > 0)
                seed = (seed ^ (seed >> 29)) * mix + word
            place = np.flatnonzero(real)
            seed = seed[place] * _MIX[0]
            if filter_ is not None:
                kept = _held(filter_, _bits(seed))
                place, seed = place[kept], seed[kept]
            found.append(seed)
            places.append(place)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def common_words(window: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a window and a passage of ``n`` words, bit-parallel.

    ``masks`` has of each word id the positions in the passage as bits.
    """
    full = (1 << n) - 1
    v = full
    for w in window:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common_weight(window: list[int], passage: list[int], weights: np.ndarray) -> float:
    """The greatest weight of words that a window and a passage have in order; ``weights`` are those of the passage's words."""
    window = np.asarray(window, dtype=np.int64)
    best = np.zeros(len(window) + 1)
    for w, weight in zip(passage, weights):
        taken = np.where(window == w, best[:-1] + weight, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1])


class Passage:
    """One passage as numbers of words with their weights."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray) -> None:
        self.ids, self.weights = ids.tolist(), weights.tolist()
        self.n = len(self.ids)
        self.bits: dict[int, int] = {}
        for i, w in enumerate(self.ids):
            self.bits[w] = self.bits.get(w, 0) | 1 << i
        self.words = frozenset(self.bits)
        self.many = {w: bits.bit_count() for w, bits in self.bits.items()}
        self.heavy = {w: n * self.weights[self.ids.index(w)] for w, n in self.many.items()}
        self.need = self.n if self.n < SHORT else -(-self.n * SHARE // 1)
        self.step = 1 if self.n < SHORT else self.n // 4
        self.window = self.n if self.n < SHORT else STRETCH * self.n + self.step
        self.least = RARE_SHARE * sum(self.weights) - 1e-9

    def may_be_in(self, there: set[int]) -> bool:
        """Whether enough of the passage's words are there at all."""
        met = self.words & there
        return sum(map(self.many.__getitem__, met)) >= self.need and sum(map(self.heavy.__getitem__, met)) >= self.least

    def best(self, ids: list[int], begins: int, offset: int) -> float:
        """The share in order of the best stretch that begins in the first ``begins`` words of ``ids``, 0 if none holds the passage.

        Stretches are tried together first, as many as begin in one window: all of them have no more than their words together.
        """
        bits, best = self.bits, 0
        for block in range(0, begins, self.window):
            near = ids[block : block + 2 * self.window]
            if not self.may_be_in(set(near)):
                continue
            at = [j for j, w in enumerate(near, block) if w in bits]
            words = [ids[j] for j in at]
            if common_words(words, bits, self.n) < self.need:
                continue
            last = 0, 0
            for begin in range(block + -(offset + block) % self.step, min(begins, block + self.window), self.step):
                lo, hi = bisect_left(at, begin), bisect_left(at, begin + self.window)
                if hi - lo < self.need or (lo, hi) == last:
                    continue
                last = lo, hi
                held = words[lo:hi]
                got = common_words(held, bits, self.n)
                if got >= self.need and got > best and common_weight(held, self.ids, self.weights) >= self.least:
                    best = got
        return best / self.n


def _block(n: Column) -> Column:
    """The length of a passage's window, see ``Passage``."""
    return F.when(n < SHORT, n).otherwise(STRETCH * n + F.floor(n / 4))


def _filter(values: DataFrame) -> np.ndarray:
    """A bitmap of the column ``v``, put together from pieces of 4 KB, of which there are no more than ``FILTER_BITS`` allows."""
    bit = values.select(F.shiftright("v", 35).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit"))
    pieces = bit.groupBy(F.floor(F.col("bit") / _BITMAP).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("map"))
    out = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for r in pieces.collect():
        at = r.piece * (_BITMAP >> 3)
        out[at : at + len(r.map)] = np.frombuffer(r.map, dtype=np.uint8)
    return out


def _prepare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task = TaskContext.get()
    row = (task.partitionId() if task else 0) << 36
    for part in parts:
        hashed = [np.array([_hash(w) for w in words_of(t)], dtype=np.int64) for t in part["passage"]]
        ids = [_number(h).astype(np.int32) for h in hashed]
        seeds = [np.unique(seeds_of(x, len(x) < 3)[0]) for x in ids]
        yield pd.DataFrame({"digest": part["digest"], "p": range(row, row + len(part)), "hashed": hashed, "ids": ids, "seeds": seeds})
        row += len(part)


def _scan(words: object, seeds: object, short: bool):
    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36
        known, sought = words.value, seeds.value
        numbers: dict[str, int] = {}
        had: dict[int, int] = {}
        total = 0
        columns = ["row", "key", "ids", "seeds", "units", "words", "counts"]

        def counted() -> pd.DataFrame:
            return pd.DataFrame([(None, None, None, None, None, np.array([0, *had]), np.array([total, *had.values()]))], columns=columns)

        for part in parts:
            flat, starts, at = [], [], 0
            for text in part["text"]:
                found = words_of(text)
                for w in set(found).difference(numbers):
                    h = _hash(w)
                    bit = _bits(h)
                    numbers[w] = _number(h) if known[bit >> 3] >> (bit & 7) & 1 else 0
                starts.append(at)
                flat.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                at += len(found) + GAP
                if len(numbers) > 1_000_000:
                    numbers.clear()
            # all texts of a batch in one array, with walls between them that no seed passes over
            ids = np.zeros(at, dtype=np.int32)
            for start, own in zip(starts, flat):
                ids[start : start + len(own)] = own
            starts = np.array(starts, dtype=np.int64)
            real = np.flatnonzero(ids)
            doc = np.searchsorted(starts, real, "right") - 1
            each, many = np.unique(np.unique(doc << 32 | ids[real]) & 0xFFFFFFFF, return_counts=True)
            for w, n in zip(each.tolist(), many.tolist()):
                had[w] = had.get(w, 0) + n
            total += len(part)
            hits, place = seeds_of(ids, short, sought)
            doc = np.searchsorted(starts, place, "right") - 1
            unit = (place - starts[doc]) // UNIT
            order = np.lexsort((unit, hits, doc))
            hits, unit, doc = hits[order], unit[order].astype(np.int32), doc[order]
            new = np.ones(len(hits), dtype=bool)
            new[1:] = (hits[1:] != hits[:-1]) | (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])
            hits, unit, doc = hits[new], unit[new], doc[new]
            first = np.searchsorted(doc, np.arange(len(part) + 1))
            rows = [(row + i, part["key"].iloc[i], flat[i], hits[a:b], unit[a:b], None, None) for i, (a, b) in enumerate(zip(first[:-1], first[1:])) if b > a]
            row += len(part)
            yield pd.DataFrame(rows, columns=columns)
            if len(had) > 1_000_000:
                yield counted()
                had.clear()
                total = 0
        yield counted()

    return scan


class _Held:
    """Passages by number, made when they are first asked for, a bounded number at a time."""

    def __init__(self) -> None:
        self.made: dict[int, Passage] = {}

    def get(self, p: int, ids: np.ndarray, weights: np.ndarray) -> Passage:
        if p not in self.made:
            if len(self.made) >= 10_000:
                self.made.clear()
            self.made[p] = Passage(np.asarray(ids), np.asarray(weights))
        return self.made[p]


def _verify_documents(sent: object):
    """Documents with all the passages they may hold, whose words every task has."""

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words = _Held(), sent.value
        for part in parts:
            rows = []
            for row, key, ids, ps, begins, offsets, sizes in zip(*(part[c] for c in ("row", "key", "ids", "p", "begins", "offset", "size"))):
                ids = ids.tolist()
                there = set(ids)
                for p, n, offset, size in zip(ps.tolist(), begins.tolist(), offsets.tolist(), sizes.tolist()):
                    passage = held.get(p, *words[p])
                    if passage.may_be_in(there) and (share := passage.best(ids[offset : offset + n + size], n, offset)):
                        rows.append((row, key, p, share))
            yield pd.DataFrame(rows, columns=["row", "key", "p", "share"])

    return verify


def _verify_stretches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One stretch of a document with one passage it may hold."""
    held = _Held()
    for part in parts:
        rows = []
        for row, key, p, ids, n, offset, own, weights in zip(*(part[c] for c in ("row", "key", "p", "ids", "begins", "offset", "own", "weights"))):
            if share := held.get(p, own, weights).best(ids.tolist(), n, offset):
                rows.append((row, key, p, share))
        yield pd.DataFrame(rows, columns=["row", "key", "p", "share"])


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", sent_seeds: int = SENT_SEEDS,
) -> DataFrame:
    """``key, item, share``: the documents that hold passages, with the share of the passage's words found in order.

    Items with the same passage each count; repeated items count once. Texts and passages that are null or have no word
    are in no row. Every row of ``docs`` is read once and whole, however many passages there are; ``sent_seeds`` decides how the
    seeds are joined, not on the result. Documents with equal or null keys are searched one by one.
    """
    kind = docs.schema[key].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    wanted = items.where(F.col(passage).isNotNull()).select(F.col(item).alias("item"), F.col(passage).alias("passage"), F.sha2(passage, 256).alias("digest"))
    distinct = wanted.groupBy("digest").agg(F.first("passage").alias("passage"))
    prepared = distinct.mapInPandas(_prepare, "digest string, p bigint, hashed array<bigint>, ids array<int>, seeds array<bigint>")
    held = materialize(prepared.where(F.size("ids") > 0), "passages")
    own_seeds = held.select("p", F.size("ids").alias("n"), F.explode("seeds").alias("seed"))
    n_seeds, shortest = own_seeds.agg(F.count(F.lit(1)), F.min("n")).first()
    known = context.broadcast(_filter(held.select(F.explode("hashed").alias("v"))))
    sought = context.broadcast(_filter(own_seeds.select(F.col("seed").alias("v"))))

    texts = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    columns = f"row bigint, key {kind}, ids array<int>, seeds array<bigint>, units array<int>, words array<bigint>, counts array<bigint>"
    scanned = materialize(texts.mapInPandas(_scan(known, sought, shortest is not None and shortest < 3), columns), "scanned")
    numbered = scanned.where("row is not null").select("row", "key", "ids")

    counts = scanned.where("words is not null").select(F.explode(F.arrays_zip("words", "counts")).alias("c")).groupBy("c.words").agg(F.sum("c.counts").alias("n"))
    total = counts.where("words = 0").select("n").first()
    total = max(1, total.n if total else 1)
    each = held.select("p", F.posexplode("ids").alias("at", "word")).join(counts.withColumnRenamed("words", "word"), "word", "left")
    each = each.select("p", F.struct("at", "word", F.log1p(F.lit(float(total)) / F.coalesce("n", F.lit(1))).alias("weight")).alias("w"))
    weighed = each.groupBy("p").agg(F.array_sort(F.collect_list("w")).alias("w")).select("p", F.col("w.word").alias("own"), F.col("w.weight").alias("weights"))

    hits = scanned.where("row is not null").select("row", F.explode(F.arrays_zip("seeds", "units")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.units").alias("unit"))
    if n_seeds <= sent_seeds:
        met = hits.join(F.broadcast(own_seeds), "seed")
    else:
        dealt = own_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["seed", "salt"])
    met = met.select("row", "p", F.col("unit") * UNIT, _block(F.col("n")).cast("int")).toDF("row", "p", "at", "size")
    first, last = F.greatest(F.floor(F.col("at") / F.col("size")) - 1, F.lit(0)), F.floor((F.col("at") + UNIT - 1) / F.col("size"))
    met = met.select("row", "p", "size", first.alias("first"), last.alias("last")).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / BLOCKS), F.floor(F.col("last") / BLOCKS))))
    lo, hi = F.greatest("first", F.col("chunk") * BLOCKS), F.least("last", F.col("chunk") * BLOCKS + BLOCKS - 1)
    near = met.groupBy("row", "p", "chunk").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.first("size").alias("size"))
    begins, offset = (F.col("hi") - F.col("lo") + 1) * F.col("size"), F.col("lo") * F.col("size")
    near = near.select("row", "p", begins.cast("int").alias("begins"), offset.cast("int").alias("offset"), "size")
    tasks = max(2 * context.defaultParallelism, scanned.count() // TASK_ROWS)  # few bytes, much work: not to be put together
    near = near.repartition(tasks, "row")
    out = f"row bigint, key {kind}, p bigint, share double"
    if n_seeds <= sent_seeds:
        sent = context.broadcast({r.p: (np.array(r.own, dtype=np.int32), np.array(r.weights)) for r in weighed.collect()})
        grouped = near.groupBy("row").agg(F.collect_list(F.struct("p", "begins", "offset", "size")).alias("c"))  # no more than the sent passages on one document
        judged = grouped.select("row", *[F.col(f"c.{c}").alias(c) for c in ("p", "begins", "offset", "size")]).join(numbered, "row").mapInPandas(_verify_documents(sent), out)
    else:
        rows = near.join(numbered, "row").join(weighed, "p")
        rows = rows.select("row", "key", "p", F.slice("ids", F.col("offset") + 1, F.col("begins") + F.col("size")).alias("ids"), "begins", "offset", "own", "weights")
        judged = rows.mapInPandas(_verify_stretches, out)
    found = judged.groupBy("row", "p").agg(F.first("key").alias("key"), F.max("share").alias("share"))
    owners = held.select("p", "digest").join(wanted.select("item", "digest").distinct(), "digest")
    return found.join(owners, "p").select(F.col("key").alias(key), F.col("item").alias(item), "share")
