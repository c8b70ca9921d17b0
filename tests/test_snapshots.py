import datetime as dt
import random

from cairn.operators import snapshots as s

ROWS = "snapshot_id long, node_id string, attrs string, recorded_at timestamp, pos int"
HEADS = "snapshot_id long, created_at double, digest string"


def tables(spark, rows, heads):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(a, b, c, None if d is None else t0 + dt.timedelta(seconds=d), 7) for a, b, c, d in rows], ROWS), spark.createDataFrame([(i, float(i), "x") for i in heads], HEADS)


def test_canonical_json():
    c = s.canonical_json
    assert c('{"a": 3, "b": null}') == c('{ "a":3.0 }') and c('{"a": [1, {"x": null}]}') == c('{"a":[1.0,{}]}')
    assert c('{"a": "3"}') != c('{"a": 3}') and c(None) is None and c("") != c(None) and c("{cut") != c("{cu")
    assert c('{"a": 1, "last_seen": 5}', ("last_seen",)) == c('{"last_seen": 6, "a": 1}', ("last_seen",))
    assert c('{"caf\\u00e9": 1}') == c('{"café": 1}') and c('{"a": 1, "b": 2}') == c('{"b": 2, "a": 1}')


def test_changes_and_runs_against_brute_force(spark):
    rnd = random.Random(2)
    heads = [1, 2, 5, 9]
    rows, truth = [], {}
    for n in range(300):
        for p, i in enumerate(heads):
            if rnd.random() < 0.8:
                v = rnd.choice([1, 1, 1, 2])
                rows.append((i, f"n{n}", '{"v": %d, "last_seen": %d}' % (v, i), 10))
                truth[f"n{n}", p] = v
                if rnd.random() < 0.2:
                    rows.append((i, f"n{n}", rnd.choice([None, '{"v": 9', '{"v": 9}']), 5))
    rows += [(4, "n1", "{}", 1), (1, None, "{}", 1)]
    changes, runs = set(), set()
    for n in {k[0] for k in truth}:
        for p in range(len(heads)):
            a, b = truth.get((n, p - 1)), truth.get((n, p))
            if p and a != b:
                changes.add((heads[p - 1], heads[p], n, "added" if a is None else "removed" if b is None else "modified"))
            if b is not None and (p == 0 or a != b):
                q = p
                while truth.get((n, q + 1)) == b:
                    q += 1
                runs.add((n, heads[p], heads[q]))
    data, listed = tables(spark, rows, heads)
    got = [tuple(r) for r in s.snapshot_changes(data, listed).collect()]
    assert len(got) == len(set(got)) and set(got) == changes
    got = [tuple(r) for r in s.version_runs(data, listed).collect()]
    assert len(got) == len(set(got)) and set(got) == runs
    for leaf_rows in (1, 1000):
        settled = s.settled_rows(data, listed)
        assert s.changes(settled, len(heads) - 1, leaf_rows).count() == len(changes)


def test_history_columns(spark):
    rows = [(1, "a", '{"x": 1, "first_seen": 3, "last_seen": 4}', 1), (2, "a", '{"x": 1.0, "first_seen": 3, "last_seen": 5}', 1), (3, "a", '{"x": 2, "first_seen": 3}', 1), (1, "b", None, None)]
    got = {(r.node_id, r.version): r for r in s.attribute_history(*tables(spark, rows, [1, 2, 3])).collect()}
    a = got["a", 1]
    assert (a.snapshot_from, a.snapshot_to, a.valid_from, a.valid_to, a.first_seen, a.last_seen, a.is_current) == (1, 2, 1.0, 3.0, 3.0, 5.0, False)
    assert got["a", 2].is_current and got["b", 1].attrs is None and got["b", 1].valid_to == 2.0


def test_empty_ties_and_gaps(spark):
    data, listed = tables(spark, [], [])
    assert s.snapshot_changes(data, listed).count() == 0 and s.version_runs(data, listed).count() == 0 and s.attribute_history(data, listed).count() == 0
    data, listed = tables(spark, [(1, "a", '{"x": 1}', 1), (1, "a", '{"x": 1}', 1), (3, "a", '{"x": 1}', 1)], [1, 2, 3])
    assert {tuple(r) for r in s.snapshot_changes(data, listed).collect()} == {(1, 2, "a", "removed"), (2, 3, "a", "added")}
    assert {tuple(r) for r in s.version_runs(data, listed).collect()} == {("a", 1, 1), ("a", 3, 3)}
    data, listed = tables(spark, [(1, "a", '{"x": 1}', 1)], [1, 2, 3])  # the last snapshots are empty
    assert {tuple(r) for r in s.snapshot_changes(data, listed).collect()} == {(1, 2, "a", "removed")}
    assert {tuple(r) for r in s.version_runs(data, listed).collect()} == {("a", 1, 1)}
    tie = [(1, "a", '{"x": 1}', 1), (1, "a", '{"x": 2}', 1)]
    a, b = (s.settled_rows(*tables(spark, t, [1])).first().digest for t in (tie, tie[::-1]))
    assert a == b  # equal times: the greater digest, whatever the order


def test_appending_equals_the_whole_history(spark, tmp_path):
    rnd = random.Random(9)
    heads = [1, 2, 5, 9, 10]
    rows = []
    for i in heads:
        for n in range(200):
            if rnd.random() < 0.85 and i != 9:  # one snapshot is empty
                rows.append((i, f"n{n}", '{"v": %d, "first_seen": %d, "last_seen": %d}' % (rnd.choice([1, 1, 1, 2]), n, 10 * i), 10))
                if rnd.random() < 0.1:
                    rows.append((i, f"n{n}", None, 5))
    data, listed = tables(spark, rows, heads)
    history = s.History(spark, str(tmp_path / "h"), leaf_rows=2)
    for i in heads:
        history.append(data.where(f"snapshot_id = {i}"), i, float(i))
        if i == 2:  # a try that broke off before its head was written leaves folders that don't count
            spark.createDataFrame([("x", "added", None, None)], "node_id string, kind string, attrs string, last_seen double").write.parquet(str(tmp_path / "h" / "events" / "snapshot_id=5"))
    got, want = ([tuple(r) for r in df.collect()] for df in (history.versions(), s.attribute_history(data, listed)))
    assert len(got) == len(set(got)) and set(got) == set(want)
    try:
        history.append(data, 10, 1.0)
    except ValueError:
        return
    raise AssertionError
