"""Periodic runs against every period of every stretch, in one piece and in slices."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from formledger.llm import queries, runs


def brute(words):
    """Runs by definition: every period, every maximal stretch, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def random_words(rng):
    """Words in which periods nest, touch and nearly match."""
    out = []
    while len(out) < rng.choice((30, 100, 400)):
        kind = rng.random()
        if kind < 0.4:
            out += [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 12))]
        elif kind < 0.8:
            root = [rng.randrange(rng.choice((2, 4, 30))) for _ in range(rng.randrange(1, 17))]
            root = root * rng.randrange(1, 3) + root[: rng.randrange(3)]
            out += (root * rng.randrange(2, 14))[: rng.randrange(1, 120)]
        else:
            k = rng.randrange(1, 60)
            out += out[-k:] * rng.randrange(1, 4)
        if out and rng.random() < 0.2:
            out[rng.randrange(len(out))] = rng.randrange(3)
    return out


@pytest.mark.parametrize("size", [1 << 18, 64, 7, 1])
def test_against_all_periods(monkeypatch, size):
    monkeypatch.setattr(runs, "SLICE", size)
    rng = random.Random(size)
    texts = [random_words(rng) for _ in range(150 if size > 1 else 40)]
    texts += [[], [1], [5] * 23, [5] * 24, [5] * 500, [1, 2] * 12, [1, 2, 3] * 7 + [1, 2], [1, 2, 3] * 8, ([7] * 30 + [8]) * 5, (([1, 2] * 15 + [3]) * 4 + [9]) * 4, list(range(9)) * 3, list(range(8)) * 3]
    got = runs.runs_of([np.array(t, np.int64) for t in texts])
    assert got == [brute(t) for t in texts]
    assert sum(map(len, got)) > 20


def test_words_decide_where_hashes_are_wrong(monkeypatch):
    monkeypatch.setattr(runs, "_mix", lambda x: x & np.uint64(3))
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(60)]
    assert runs.runs_of([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]


def test_long_texts():
    rng = random.Random(1)
    root = [rng.randrange(10**6) for _ in range(90_000)]
    text = [rng.randrange(10**6) for _ in range(1000)] + root * 4 + [3] * 300_000 + root[:50_000]
    assert runs.runs_of([np.array(text, np.int64)]) == [[(1000, 360_000, 90_000), (361_000, 300_000, 1)]]


def row(doc_id, text):
    """What the query says of a text, by definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *first, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_definition(spark, small):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet' where length(text) < 6000").fetchall()
    got = {r.doc_id: tuple(r[n] for n in names) for r in queries.op11_runs(spark, small).collect()}
    assert len(got) == duckdb.sql(f"select count(*) from '{small}/documents.parquet'").fetchall()[0][0]
    want = {d: row(d, t) for d, t in docs}
    assert {d: got[d] for d in want} == want
    assert sum(r[0] > 0 for r in want.values()) > 5


def test_odd_rows(spark):
    schema = "doc_id long, text string, id string, n_runs int"
    empty = spark.createDataFrame([], schema)
    assert runs.detect(empty).collect() == []
    tied = "a b c " * 10 + "x " + "d e f " * 10
    rows = [(1, None), (2, ""), (3, " \n "), (None, "w " * 40), (4, tied), (4, tied), (5, "a b " * 30)]
    got = runs.detect(spark.createDataFrame([(*r, "i", 1) for r in rows], schema), tails=True).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert [(r.n_words, r.n_runs, r.start, r.collapsed_sha256) for r in got[:3]] == [(0, 0, None, none)] * 3
    assert (got[3].n_runs, got[3].period, got[3].collapsed_sha256) == (1, 1, hashlib.sha256(b"w").hexdigest())
    assert got[4] == got[5] and (got[4].start, got[4].period, got[4].exponent_milli) == (0, 3, 10_000)
    assert got[6].n_words == 30
