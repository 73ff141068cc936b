"""Numbers and batches of runs that span chunks, one of which has nearly all rows."""

import random

from pyspark.sql import functions as F

from formledger.operators import numbering


def data(seed, n=600):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.95 else rng.choice(["a", "b", None]), i, rng.choice([True] + [False] * rng.choice((3, 40)) + [None])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def by_hand(rows, size):
    out, state = {}, {}
    for run, i, alone in sorted(rows, key=lambda r: r[1]):
        batch, position, closed = state.get(run, (0, 0, True))
        if alone or closed or position == size:
            batch, position = batch + 1, 0
        state[run] = (batch, position + 1, bool(alone))
        out[i] = (batch, position + 1)
    return out


def test_batches_over_chunks(spark):
    for seed, chunk, size in ((1, 1_000_000, 12), (2, 37, 12), (3, 5, 12), (4, 20, 3), (5, 1, 2)):
        rows = data(seed, 120 if chunk == 1 else 600)
        got = numbering.batched(spark.createDataFrame(rows, "run string, i long, alone boolean"), "run", "i", "alone", size, rows=chunk)
        assert got.columns == ["run", "i", "alone", "batch", "position"]
        assert {r.i: (r.batch, r.position) for r in got.collect()} == by_hand(rows, size)


def test_numbers_over_chunks(spark):
    rows = data(6)
    df = spark.createDataFrame(rows, "run string, i long, alone boolean")
    got = {r.i: r.nth for r in numbering.numbered(df, "run", F.col("i").desc(), rows=50).collect()}
    want, seen = {}, {}
    for run, i, _ in sorted(rows, key=lambda r: -r[1]):
        want[i] = seen[run] = seen.get(run, 0) + 1
    assert got == want
    laid = numbering.laid_out(df, "run", "i", rows=50)
    assert max(r["count"] for r in laid.groupBy(numbering.CHUNK).count().collect()) < 150
    assert numbering.numbered(df.limit(0), "run", "i").collect() == []
