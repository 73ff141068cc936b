import random
import re

import pytest

from formledger.llm import components, jaccard, queries, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def plain_components(rows, k, num, den):
    sets = [(i, plain_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            both = len(s & o)
            if s and o and den * both >= num * (len(s) + len(o) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, copies):
    """Random texts, groups of near copies in which nearly all shingles are common, a passage in many texts, short texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, passage, base = [], text(40), text(120)
    for _ in range(80):
        rows.append(text(draw.randint(1, 60)))
        rows.append(text(draw.randint(5, 60)) + passage)
    for _ in range(copies):
        t = list(base)
        for _ in range(draw.randint(0, 5)):
            t[draw.randrange(len(t))] = draw.choice(vocabulary)
        rows.append(t)
    rows += [["A", "b"], ["a", "B"], ["a"], [], passage, passage[:20], passage + ["x"]]
    return [(i, " ".join(t)) for i, t in enumerate(rows)] + [(len(rows), None)]


@pytest.mark.parametrize("k, num, den, hot", [(3, 90, 100, 48), (5, 8, 10, 6), (3, 90, 100, 4)])
def test_against_all_pairs(spark, monkeypatch, k, num, den, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = corpus(k + hot, 60)
    want = plain_components(rows, k, num, den)
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=den).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == want


def test_repeats_nulls_ties_and_clashing_columns(spark):
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (3, "A B C D E F", "y"), (None, "a b c d e f", "z"), (9, None, "n"), (8, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = jaccard.join(docs, k=3)
    assert sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id) for r in got.collect()) == [(False, 3, 4, 3), (False, 7, 4, 3), (False, 7, 4, 3), (False, 8, 0, 8), (False, 9, 0, 9), (True, 0, 4, 3)]
    kept = jaccard.kept(docs.unionAll(docs.where("doc_id = 3")), k=3)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 8), (False, 9), (True, 0)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_long_texts_are_cut_at_white_space_only(monkeypatch):
    text = " ".join(f"word{i % 97}x{i}" for i in range(4000)) + " " + "z" * 3000
    whole = shingles.sets([text], 3)[0]
    monkeypatch.setattr(shingles, "PIECE", 1000)
    assert (shingles.sets([text], 3)[0] == whole).all()
    assert len(whole) == len(plain_set(text, 3))


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, **{i: 200 for i in range(200, 207)}}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_postings(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain_components(rows, 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard(spark, small).collect()} == want
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("k, num, den, copies, edits", [(3, 90, 100, 120, 3), (5, 8, 10, 90, 6)])
def test_links_of_crowded_sets_are_counted(spark, k, num, den, copies, edits):
    """A group of more than HOT near copies, and another that hangs together through chains: n_links as the SQL has it."""
    import duckdb
    import pandas as pd

    draw = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    base, other, rows = [[draw.choice(vocabulary) for _ in range(n)] for n in (120, 90)] + [corpus(k, 0)]
    texts = [t for _, t in rows]
    for i in range(copies):
        t = list(base)
        for _ in range(draw.randint(0, edits)):
            t[draw.randrange(len(t))] = draw.choice(vocabulary)
        texts.append(" ".join(t))
        chain = [f"c{j}" if j < i // 4 else w for j, w in enumerate(other)]
        texts.append(" ".join(chain + ["e"] * (i % 3)))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    known = duckdb.connect()
    known.register("documents", documents)
    want = {r[0]: r[1:] for r in known.sql(jaccard.oracle(k, num, den)).fetchall()}
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=den).collect()}
    assert got == want
    assert max(n for _, _, n in got.values()) > 40


@pytest.mark.parametrize("block", [2048, 7])
def test_several_originals_in_a_family(spark, monkeypatch, block):
    """Five originals that share half of their shingles: their copies are one family, most of it far from its pivot."""
    import duckdb
    import pandas as pd

    monkeypatch.setattr(jaccard, "BLOCK", block)
    draw = random.Random(11)
    half = [f"h{i}" for i in range(60)]
    originals = [half + [f"o{o}x{i}" for i in range(60)] for o in range(5)]
    texts = []
    for i in range(150):
        t = list(originals[i % 5])
        for _ in range(draw.randint(0, 3)):
            t[draw.randrange(len(t))] = f"e{draw.randrange(40)}"
        texts.append(" ".join(t))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    known = duckdb.connect()
    known.register("documents", documents)
    want = {r[0]: r[1:] for r in known.sql(jaccard.oracle(3, 90, 100)).fetchall()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(docs, k=3, num=90, den=100).collect()} == want
    kept = {r.doc_id for r in jaccard.kept(docs, k=3, num=90, den=100).collect()}
    assert kept == {component for _, component, _ in want.values()}
