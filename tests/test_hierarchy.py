import random
import tracemalloc

import pandas as pd
import pytest

from cairn.operators import hierarchy as h

LINKS = "node string, parent string"


def brute(up):
    out = set()
    for n in up:
        seen, m = [], up[n]
        while m is not None and m not in seen:
            seen.append(m)
            m = up.get(m)
        out |= {(min(n, a), max(n, a)) for a in seen}
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "ring", "star"])
def test_pairs_equal_brute_force_at_every_recursion_depth(spark, shape):
    rnd, n = random.Random(1), 150
    up = {
        "random": {f"n{i}": None if rnd.random() < 0.05 else f"n{rnd.choice([i + 1, rnd.randrange(n)]) % n}" for i in range(n)},
        "chain": {f"n{i}": f"n{i + 1}" if i + 1 < n else None for i in range(n)},
        "ring": {f"n{i}": f"n{(i + 1) % n}" for i in range(n)},
        "star": {f"n{i}": "n0" if i else None for i in range(n)},
    }[shape]
    links = spark.createDataFrame(list(up.items()), LINKS)
    for rows in (1000, 40):
        got = [tuple(r) for r in h.related_pairs(links, rows).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(up)


def test_paths_depths_roots_and_cycles(spark):
    rows = [("A", "B"), ("B", "C"), ("C", None), ("X", "Y"), ("Y", "X"), ("Z", "X"), ("S", "S")]
    got = {r.node: r for r in h.hierarchy(spark.createDataFrame(rows, LINKS)).collect()}
    assert (got["A"].path, got["A"].depth, got["A"].root) == (["C", "B", "A"], 2, "C")
    assert (got["C"].path, got["C"].depth, got["C"].root) == (["C"], 0, "C")
    assert got["X"].in_cycle and got["S"].in_cycle and got["Z"].below_cycle and got["Z"].root is None
    assert set(got["Z"].path) == {"X", "Y", "Z"}


def test_dirty_links(spark):
    rows = [("A", " m.n.B<T[int], U> ", 1), ("A", "B", None), ("B", None, 2), ("B", "  ", 2), (None, "C", 3), ("  ", "D", 4), ("E", "undeclared[x]", 5), ("E", "undeclared", 5)]
    df = spark.createDataFrame(rows, "class_name string, base string, node int")
    got = {tuple(r) for r in h.parent_links(df).select("node", "parent").collect()}
    assert got == {("A", "B"), ("B", None), ("E", "undeclared"), ("undeclared", None)}
    assert {tuple(r) for r in h.related_pairs(h.parent_links(df)).collect()} == {("A", "B"), ("E", "undeclared")}


def test_empty_and_long(spark):
    assert h.hierarchy(spark.createDataFrame([], LINKS)).count() == 0
    long = "x" * 50_000
    assert {tuple(r) for r in h.related_pairs(spark.createDataFrame([("a", long), (long, None)], LINKS)).collect()} == {("a", long)}


def test_a_task_holds_links_not_lists():
    """A chain of 6,000 nodes has 18 million names in its lists; they are passed on as they are made."""
    n = 6000
    rows = pd.DataFrame({"node": [f"n{i}" for i in range(n)], "parent": [f"n{i + 1}" if i + 1 < n else None for i in range(n)], "via": [[] for _ in range(n)], "in_cycle": False})
    tracemalloc.start()
    names = sum(len(v) for part in h._contract(iter([rows])) for v in part["via"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == n * (n - 1) // 2 and peak < 40_000_000


def test_recursion_of_several_levels(spark):
    """A forest of long chains, rings and a hot base over levels of fragments gives what one task gives."""
    rnd = random.Random(4)
    up = {f"n{i}": (None if rnd.random() < 0.02 else "n0" if rnd.random() < 0.3 else f"n{max(0, i - rnd.randrange(1, 4))}") if i else None for i in range(3000)}
    up |= {f"r{i}": f"r{(i + 1) % 40}" for i in range(40)} | {f"t{i}": f"r{i % 40}" for i in range(200)}
    links = spark.createDataFrame(list(up.items()), LINKS)
    one = {tuple(r) for r in h.hierarchy(links).select("node", "depth", "root", "in_cycle", "below_cycle").collect()}
    assert one == {tuple(r) for r in h.hierarchy(links, 300).select("node", "depth", "root", "in_cycle", "below_cycle").collect()} and len(one) == len(up)
