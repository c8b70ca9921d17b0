import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cairn.llm import leaks, splitting, tokenizer

DOC = "doc_id long, text string, key string, block string, ids string, piece int, item string, digest string, share double"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", "b", "x", 1, "y", "z", 0.0) for i, t in texts], DOC)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ODD = [
    "", " ", "\n\n\t  x", "a" * 5000, "the the the", "don't we'll I'M 'tis", "naïve café 漢字かな交じり \u0301\u200d 🙂🙃", "<|endoftext|> x", "0123456789" * 50, "\r\n\r\n  def f(x):\r\n\treturn 1  \r\n",
    " \u3000\u00a0 x\u2028y\x00\x1f\ufeffz", "ⅷ½٣", "x" + " " * 3000 + "y", "if(a){b();}" * 300,
]


def test_ids_equal_the_public_library(spark, reference):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("abc 'é漢\n\t0_=({") for _ in range(rnd.randrange(200))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (901, ""), (0, texts[0]), (None, "null key")]
    got = tokenizer.encode_corpus(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(k, tuple(reference(t or ""))) for k, t in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == want


def test_no_rows(spark):
    empty = docs(spark, [])
    assert tokenizer.encode_corpus(empty).count() == 0 and splitting.split_documents(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, passage string")
    assert leaks.find_leaks(empty, items).count() == 0 and leaks.find_leaks(docs(spark, [(1, "x")]), items).count() == 0


@pytest.mark.parametrize("text", ["word " * 5000, "漢字" * 3000, "z" * 20_000, "\n\n".join(["A paragraph of some words. Another sentence, with a clause."] * 400), "= " * 4000 + "a" * 9000 + " end. " * 900])
def test_pieces(reference, text):
    counts = tokenizer.WordCounts(tokenizer.TOKENIZER)
    pieces = splitting.split_text(text, counts)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and len(pieces) > 1
    at = 0
    for i, (a, b, overlap, n) in enumerate(pieces):
        assert a + overlap == at and n <= splitting.LIMIT and n == len(reference(text[a:b]))
        if i:
            assert 60 <= len(reference(text[a : a + overlap])) <= splitting.OVERLAP + 5 or len(text) < 3000
        at = b


def test_boundaries_and_rows(spark, reference):
    text = "\n\n".join(f"def f{i}(x):\n    return [{', '.join(map(str, range(60)))}]" for i in range(60))
    rows = splitting.split_documents(docs(spark, [(1, text), (2, "short"), (3, None), (4, "")])).orderBy("piece").collect()
    assert {r.doc_id for r in rows} == {1} and all(r.text == text[r.start_char : r.end_char] for r in rows)
    assert all(text[r.start_char + r.overlap_chars :].startswith("def f") for r in rows)  # cut between functions
    assert "".join(r.text[r.overlap_chars :] for r in rows) == text


def test_limit_is_exact(reference):
    counts = tokenizer.WordCounts(tokenizer.TOKENIZER)
    for n in (1999, 2000, 2001):
        text = " a" * n
        assert len(reference(text)) == n and (len(splitting.split_text(text, counts)) > 1) == (n > 2000)


WORDS = [f"w{i}" for i in range(400)]


def passage_and_noise(seed, n=60):
    rnd = random.Random(seed)
    return rnd, [rnd.choice(WORDS) for _ in range(n)]


def hide(rnd, words):
    return " ".join(rnd.choice(WORDS) for _ in range(150)) + " " + " ".join(words) + " " + " ".join(rnd.choice(WORDS) for _ in range(150))


def test_leaks(spark):
    rnd, p = passage_and_noise(1)
    changed = [w if i % 4 else f"other{i}" for i, w in enumerate(p)]
    dropped = [w for i, w in enumerate(p) if i % 9]
    added = [x for w in p for x in ([w, "new"] if rnd.random() < 0.15 else [w])]
    texts = [
        (1, hide(rnd, p)), (2, hide(rnd, [w.upper() + "," for w in p])), (3, hide(rnd, changed)), (4, hide(rnd, dropped)), (5, hide(rnd, added)), (6, hide(rnd, p[:40])),
        (7, "\n".join("// " + " ".join(p[i : i + 6]) for i in range(0, 60, 6))), (20, hide(rnd, p[:12])), (21, hide(rnd, rnd.sample(p, 60))), (22, None), (23, ""), (24, "w1 " * 20_000), (25, hide(rnd, [])),
    ]
    text = " ".join(p)
    items = [(1, text), (2, text), (2, text), (3, None), (4, " -- "), (5, "alpha beta gamma"), (None, "w5 w9")]
    given = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(spark, texts), given).collect()}
    assert got >= {(d, i) for d in range(1, 8) for i in (1, 2)}
    assert not {d for d, i in got if i in (1, 2)} & {20, 21, 22, 23, 25}
    several = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(spark, texts), given, sent_seeds=0).collect()}
    assert several == got


def test_leaks_with_single_words_changed_dropped_and_added(spark):
    rnd, p = passage_and_noise(5)
    half = set(rnd.sample(range(60), 24))
    texts = [
        (1, hide(rnd, p[::2])), (2, hide(rnd, [w for i, w in enumerate(p) if i % 4])), (3, hide(rnd, [x for i, w in enumerate(p) for x in ([w, "new"] if i % 3 == 2 else [w])])),
        (4, hide(rnd, [f"other{i}" if i in half else w for i, w in enumerate(p)])), (20, hide(rnd, p[:20])), (21, hide(rnd, p[::-1])),
    ]
    items = spark.createDataFrame([(1, " ".join(p))], "item_id long, passage string")
    assert {r.doc_id for r in leaks.find_leaks(docs(spark, texts), items).collect()} == {1, 2, 3, 4}


def keep_half(rnd, words, damage):
    """The words with ``damage`` applied again until at least half of them are left in order."""
    while True:
        left = [w for w in words if rnd.random() >= damage]
        if 2 * len(left) >= len(words):
            return left


def changed(rnd, words, share):
    while True:
        out = [f"x{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]
        if 2 * sum(a == b for a, b in zip(out, words)) >= len(words):
            return out


def added(rnd, words, share):
    return [x for w in words for x in ([w, f"x{rnd.randrange(10**6)}"] if rnd.random() < share else [w])]


DAMAGES = {
    "30 % changed": lambda r, p: changed(r, p, 0.3), "35 % changed": lambda r, p: changed(r, p, 0.35), "40 % changed": lambda r, p: changed(r, p, 0.4), "45 % changed": lambda r, p: changed(r, p, 0.45),
    "20 % dropped": lambda r, p: keep_half(r, p, 0.2), "30 % dropped": lambda r, p: keep_half(r, p, 0.3), "40 % dropped": lambda r, p: keep_half(r, p, 0.4),
    "20 % added": lambda r, p: added(r, p, 0.2), "50 % added": lambda r, p: added(r, p, 0.5), "80 % added": lambda r, p: added(r, p, 0.8),
    "20 % mixed": lambda r, p: added(r, changed(r, keep_half(r, p, 0.07), 0.07), 0.07), "30 % mixed": lambda r, p: added(r, changed(r, keep_half(r, p, 0.1), 0.1), 0.1),
    "every second changed": lambda r, p: [f"x{i}" if i % 2 else w for i, w in enumerate(p)], "every second dropped": lambda r, p: p[::2],
}


@pytest.mark.parametrize("length", [60, 20])
def test_recall_of_damaged_passages(spark, length):
    rnd = random.Random(length)
    texts, items, cases = [], [], {}
    for name, damage in DAMAGES.items():
        for _ in range(60):
            n = len(items)
            p = [rnd.choice(WORDS) for _ in range(length)]
            items.append((n, " ".join(p)))
            texts.append((n, hide(rnd, damage(rnd, p))))
            cases[n] = name
    found = leaks.find_leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, passage string")).collect()
    hit = {r.doc_id for r in found if r.doc_id == r.item_id}
    recall = {name: sum(n in hit for n, c in cases.items() if c == name) / 60 for name in DAMAGES}
    print(length, recall, sum(r.doc_id != r.item_id for r in found))
    assert min(recall.values()) >= 0.9, recall


def test_a_frame_of_common_words_is_no_leak(spark):
    rnd = random.Random(6)
    frame = lambda names: " ".join(f"if {names()} is not none then return self check" for _ in range(8))
    items = spark.createDataFrame([(1, frame(lambda: f"a{rnd.randrange(10**6)} b{rnd.randrange(10**6)} c{rnd.randrange(10**6)} d{rnd.randrange(10**6)}"))], "item_id long, passage string")
    texts = [(i, frame(lambda: f"x{rnd.randrange(10**6)}")) for i in range(100)] + [(500, "so " + items.first().passage)]
    assert {r.doc_id for r in leaks.find_leaks(docs(spark, texts), items).collect()} == {500}


def test_short_passages_and_unicode(spark):
    items = spark.createDataFrame([(1, "Grüße aus Köln"), (2, "один два три четыре пять шесть семь восемь")], "item_id long, passage string")
    found = leaks.find_leaks(docs(spark, [(1, "x GRÜSSE? grüße, aus KÖLN y"), (2, "так: один, два три ЧЕТЫРЕ пять шесть семь восемь!"), (3, "aus Köln")]), items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2)}


def test_common_words_is_the_longest_common_subsequence():
    rnd = random.Random(3)
    for _ in range(50):
        a, b = [rnd.randrange(6) for _ in range(rnd.randrange(1, 30))], [rnd.randrange(6) for _ in range(rnd.randrange(1, 30))]
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        bits = {}
        for j, y in enumerate(b):
            bits[y] = bits.get(y, 0) | 1 << j
        assert leaks.common_words(a, bits, len(b)) == table[-1, -1]
