import numpy as np
from pyspark.sql import functions as F

from formledger.llm import graph_ann


def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    length = np.sqrt((x * x).sum(1))
    out = {}
    for i, v in rows:
        if queries(i):
            v = np.array(v, float)
            score = x @ v / (length * np.sqrt((v * v).sum()))
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    x = centres[draw.integers(12, size=1500)] + 0.5 * draw.normal(size=(1500, 16))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {}
    for r in graph_ann.search(df, lambda c: c % 50 == 0, shard=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = exact(rows, lambda i: i % 50 == 0, 5)
    hits = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, found in got.items():
        assert [r for _, _, r in found] == [1, 2, 3, 4, 5]
        assert [s for _, s, _ in found] == sorted((s for _, s, _ in found), reverse=True)
        for v, s, _ in found:
            assert abs(s - x[q] @ x[v] / np.sqrt((x[q] @ x[q]) * (x[v] @ x[v]))) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(0, 20)] + [(100, [0.0, 1.0]), (101, None), (102, []), (103, [0.0, 0.0]), (104, [float("nan"), 1.0]), (105, [1.0, float("inf")]), (106, [1.0, None]), (107, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = graph_ann.search(df, lambda c: c.isin(0, 7, 100, 101, 103), k=5).orderBy("query_id", "rank").collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}
    few = graph_ann.search(df.where("vec_id in (0, 100)"), lambda c: c == 0, k=5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 100, 0.0)]
    assert graph_ann.search(df.limit(0), lambda c: c == 0).count() == 0


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(4)]
    out = graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c.isin(0, 10), k=5).collect()
    assert {r.vec_id for r in out if r.query_id == 0} == {1, 2, 3, 4, 5} and {r.vec_id for r in out if r.query_id == 10} == {11, 12, 13}


def test_recall_of_the_query(spark):
    from formledger.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = exact(rows, lambda i: i % 50 == 0, 5), {}
    for r in queries.op7_ann(spark, folder).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(got[q]) & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_groups_without_links_and_tight_groups(spark):
    draw = np.random.default_rng(5)
    apart = draw.normal(size=(8, 32))[draw.integers(8, size=1600)] + 0.05 * draw.normal(size=(1600, 32))
    tight = 1 + 1e-4 * draw.normal(size=(800, 32))
    for x in (apart, tight):
        rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
        got, want = {}, exact(rows, lambda i: i % 20 == 0, 5)
        for r in graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len(got.get(q, set()) & {v for v, _ in want[q]}) for q in want)
        assert hits / (5 * len(want)) >= 0.9
