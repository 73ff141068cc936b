"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from formledger.llm import lexical

DOCS = "doc_id long, text string, item string, score int, n int"


def lowered(text):
    return re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    """item -> [(rank, doc_id, score)] by definition."""
    found = [(d, Counter(lowered(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, total, df = len(found), sum(k for _, _, k in found), Counter(t for _, c, _ in found for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(lowered(text))
    out = {}
    for item, own in terms.items():
        scored = []
        for d, c, k in found:
            m = 50 + 50 * k * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        best = sorted(scored)[:top]
        if best:
            out[item] = [(i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(best)]
    return out


def searched(spark, docs, items, top=50):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], DOCS)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    out = {}
    for r in lexical.search(d.repartition(3), q, top=top).orderBy("item", "rank").collect():
        out.setdefault(r.item, []).append((r.rank, r.id, r.score))
    return out


def zipf(rng, n, words):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(n))


@pytest.mark.parametrize("postings, pairs, docs_a_task", [(2_000_000, 200_000, 10_000), (300, 25, 100)])
def test_against_all_scores(spark, monkeypatch, postings, pairs, docs_a_task):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "DOCS_A_TASK", docs_a_task)
    rng = random.Random(postings)
    docs = [(i, zipf(rng, rng.randrange(1, 200), 3000)) for i in range(400)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(120)]  # ties beyond the fifty
    docs += [(7, docs[7][1]), (None, docs[8][1]), (2000, None), (2001, " -- "), (2002, "Ärger ÄRGER w1\x00W2_w3")]
    items = [(i, zipf(rng, rng.randrange(1, 40), 3000)) for i in range(20)]
    items += [(50, None), (51, "..."), (52, docs[2][1]), (52, "w1"), (53, "nowhere"), (54, "ärger W2"), (None, "w3 w9")]
    assert searched(spark, docs, items) == plain(docs, items)
    assert searched(spark, docs, items, top=3) == plain(docs, items, top=3)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == {}
    assert searched(spark, [(1, "a b")], []) == {}
    assert searched(spark, [(1, None), (2, "")], [(1, "a")]) == {}
    assert searched(spark, [(1, "a " * 200_000), (2, "b")], [(1, "a b c")]) == plain([(1, "a " * 200_000), (2, "b")], [(1, "a b c")])


def shard(rng, n_docs, n_terms):
    lists = [sorted(rng.sample(range(n_terms), rng.randrange(0, min(12, n_terms)))) for _ in range(n_docs)]
    ends = np.cumsum([0, *map(len, lists)])
    numbers = np.array([t for own in lists for t in own], np.int32)
    counts = np.array([rng.randrange(1, 5) for _ in numbers], np.int32)
    weights = np.array([rng.randrange(0, 9000) for _ in range(n_terms)], np.int64)
    n = np.array([max(1, len(own)) for own in lists], np.int64)
    return lexical.Shard(n, ends, numbers, counts, weights, n_docs, int(n.sum()))


def test_bounds_hold_and_pairs_tighten_them():
    rng, tighter, sizes = random.Random(4), 0, []
    for _ in range(60):
        s = shard(rng, 80, 30)
        query = np.array(sorted(rng.sample(range(30), rng.randrange(1, 15))))
        own = [int(t) for t in query[np.lexsort((query, -s.largest[query]))] if s.largest[t] > 0]
        bound = s.bounds(own)
        for i in range(len(own) + 1):
            sums = np.zeros(80, np.int64)
            for t in own[i:]:
                docs, impacts = s.of(t)
                sums[docs] += impacts
            assert sums.max() <= bound[i] <= sum(int(s.largest[t]) for t in own[i:])
            tighter += bound[i] < sum(int(s.largest[t]) for t in own[i:])
        # the documents found under any floor are the best of all
        sums = np.zeros(80, np.int64)
        for t in own:
            docs, impacts = s.of(t)
            sums[docs] += impacts
        for floor in (1, int(sums.max()) // 2 + 1, int(sums.max()) or 1):
            want = sorted(((-int(x), d) for d, x in enumerate(sums) if x >= floor))[:5]
            docs, scores = s.best(query, 5, floor)
            assert sorted((-x, d) for d, x in zip(docs.tolist(), scores.tolist())) == want
            sizes.append(len(want))
    assert tighter > 100 and max(sizes) == 5
