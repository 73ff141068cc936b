"""Orders and step sequences against plain Python."""

import itertools
import random

import pytest

from formledger.operators import sequences


def longest(values):
    """Length of the longest increasing subsequence, by definition."""
    best = [1] * len(values)
    for i, j in itertools.combinations(range(len(values)), 2):
        if values[i] < values[j]:
            best[j] = max(best[j], best[i] + 1)
    return max(best, default=0)


def test_heaviest_increasing():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(0, 9)
        values, weights = rng.sample(range(20), n), [rng.randrange(1, 5) for _ in range(n)]
        got = sequences.heaviest_increasing(values, weights)
        assert all(values[a] < values[b] for a, b in itertools.pairwise(got)) and got == sorted(got)
        options = (c for k in range(n + 1) for c in itertools.combinations(range(n), k) if all(values[a] < values[b] for a, b in itertools.pairwise(c)))
        assert sum(weights[i] for i in got) == max(sum(weights[i] for i in c) for c in options)


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_order_changes(spark, rows):
    rng = random.Random(rows)
    expected, actual, groups = [], [], {}
    for g in range(12):
        names = [f"e{i}" for i in range(rng.choice((0, 1, 8, 30, 120)))]
        now = list(names)
        for _ in range(rng.randrange(0, 8)):
            if now:
                now.insert(rng.randrange(len(now)), now.pop(rng.randrange(len(now))))
        if g % 3 == 0:
            rng.shuffle(now)
        gone = set(rng.sample(now, len(now) // 10))
        now = [x for x in now if x not in gone]
        for i in range(rng.randrange(3)):
            now.insert(rng.randrange(len(now) + 1), f"new{i}")
        groups[g] = (names, now, gone)
        expected += [(g, x, i) for i, x in enumerate(names)]
        actual += [(g, x, 10 * i) for i, x in enumerate(now)]
    actual += [(1, "twice", 10**6), (1, "twice", 10**6 + 1), (None, "x", 1), (1, None, 2)]
    make = lambda data: spark.createDataFrame(data, "g long, x string, at long")
    got = {}
    for r in sequences.order_changes(make(expected), make(actual), "g", "x", "at", rows=rows).collect():
        got.setdefault((r.g, r.change), set()).add(r.x)
    for g, (names, now, gone) in groups.items():
        assert got.get((g, "deleted"), set()) == gone
        assert got.get((g, "inserted"), set()) - {"twice"} == set(now) - set(names)
        place = {x: i for i, x in enumerate(names)}
        moved = got.get((g, "moved"), set())
        order = [place[x] for x in now if x in place]
        assert len(moved) == len(order) - longest(order)
        assert [p for p in order if names[p] not in moved] == sorted(p for p in order if names[p] not in moved)
    assert got[1, "repeated"] == {"twice"} and None not in {g for g, _ in got}


def test_one_of_many_moved(spark):
    n = 3000
    expected = spark.range(n).selectExpr("1 AS g", "id AS x", "id AS at")
    actual = spark.range(n).selectExpr("1 AS g", "id AS x", "CASE WHEN id = 2900 THEN -1 WHEN id = 5 THEN 1700.5 ELSE id END AS at")
    got = sequences.order_changes(expected, actual, "g", "x", "at", rows=500).collect()
    assert sorted((r.x, r.change) for r in got) == [(5, "moved"), (2900, "moved")]


def test_pieces_share_batches(spark):
    """Many small pieces, and one longer than a batch: no call for each piece."""
    rows = [(g, x, x) for g in range(60) for x in range(4)] + [(99, x, x) for x in range(40)]
    at = {0: 1, 1: 0, 2: 2, 3: 3}
    turned = [(g, x, at[x] if g < 60 else (x + 1) % 40) for g, x, _ in rows]
    make = lambda data: spark.createDataFrame(data, "g long, x long, at long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = sequences.order_changes(make(rows), make(turned), "g", "x", "at", rows=50)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {c for _, _, c in got} == {"moved"} and sorted(g for g, _, _ in got) == [*range(60), 99]
    assert (99, 39, "moved") in got
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_field_changes(spark):
    a = spark.createDataFrame([("get", "allow", None), ("set", "allow", "x"), ("old", "deny", "y")], "name string, policy string, reason string")
    b = spark.createDataFrame([("get", "allow", None), ("set", "deny", None)], "name string, policy string, reason string")
    got = sequences.field_changes(a, b, ["name"], "policy", "reason").collect()
    assert sorted(map(tuple, got)) == [("set", "policy", "allow", "deny"), ("set", "reason", "x", None)]


STEPS = [("a", False), ("b", True), ("c", True), ("a", False), ("d", True), ("e", False)]


def by_hand(items):
    at, found = 0, []
    for name, ok in items:
        j = at
        while j < len(STEPS) and STEPS[j][0] != name and STEPS[j][1]:
            j += 1
        if j < len(STEPS) and STEPS[j][0] == name:
            found.append((j, bool(ok)))
            at = j + 1
    return found


@pytest.mark.parametrize("rows", [1_000_000, 25])
def test_steps(spark, rows):
    rng = random.Random(2)
    data, runs = [], {}
    for run in ["hot", *range(15)]:
        runs[str(run)] = [(rng.choice("abcdex"), rng.choice((True, True, False, None))) for _ in range(400 if run == "hot" else rng.randrange(1, 12))]
        data += [(str(run), i, *item) for i, item in enumerate(runs[str(run)])]
    runs["exact"] = [(n, True) for n, _ in STEPS]
    data += [("exact", i, *item) for i, item in enumerate(runs["exact"])]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "run string, i long, name string, good boolean")
    matches = sequences.matched_steps(df, "run", "i", "name", "good", STEPS, rows=rows)
    got = {r.run: (r.n_observed, [(m.step, m.ok) for m in r.matched]) for r in matches.collect()}
    assert got == {run: (len(items), by_hand(items)) for run, items in runs.items()}
    report = {r.run: r for r in sequences.sequence_report(matches, "run", STEPS).collect()}
    assert report["exact"].status == "passed" and report["exact"].n_extra == 0
    for run, items in runs.items():
        found = dict(by_hand(items))
        need = [(i, n) for i, (n, optional) in enumerate(STEPS) if not optional]
        assert report[run].missing == ",".join(f"{i}:{n}" for i, n in need if i not in found)
        assert report[run].failed == ",".join(f"{i}:{n}" for i, n in need if found.get(i) is False)
