import random

from pyspark.sql import functions as F

from formledger.llm import queries, toxicity

BAD = ["idiot", "scum", "trash", "moron"]


def corpus(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(2, 7))) for _ in range(200)]
    rows = []
    for i in range(n):
        t = [draw.choice(words) for _ in range(draw.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            t.insert(draw.randrange(len(t)), draw.choice(BAD))
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, "x"), (9002, "x")], "doc_id long, text string").withColumn("SCORE", F.lit("mine"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "SCORE", "_score"]
    got = {}
    for r in out.collect():
        assert 0 <= r["_score"] <= 1
        assert got.setdefault(r.doc_id, r["_score"]) == r["_score"]
    assert got[9000] == got[9001]
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert sum(right) / len(right) > 0.95
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert {r.doc_id: r["_score"] for r in toxicity.score(docs, again).collect()} == got


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(abs(r.score - want) < 1e-6 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded_and_fixed(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    one, two = (sorted(r.id for r in toxicity.sample(labels.repartition(n), rows=50).collect()) for n in (2, 5))
    assert one == two and len(one) == 50


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op5_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def plain_buckets(text):
    """Distinct buckets of the 3- to 5-grams, one substring after another."""
    clean, out = " " + " ".join((text or "").lower().split()) + " ", set()
    for size in (3, 4, 5):
        for at in range(len(clean) - size + 1 if len(clean) >= 3 else 0):
            total = sum((ord(c) + 1) * int(p) for c, p in zip(clean[at : at + size], toxicity.PLACES)) % 2**32
            out.add((total ^ (total >> 15)) * (0x2C1B3C6D + 2 * (size - 1)) % 2**32 >> (32 - toxicity.BITS))
    return out


def test_query_against_dense_python(spark, small):
    """The query's scores again: counts in dictionaries, the regression on a dense matrix."""
    import zlib

    import numpy as np

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r.doc_id: int(r.toxic) for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.toxic is not None}
    known = sorted((y, i) for i, y in labels.items() if i in docs and zlib.crc32(str(i).encode()) % 5)
    sets = {i: plain_buckets(t) for i, t in docs.items()}
    y = np.array([y for y, _ in known], float)
    n = [int((y == c).sum()) for c in (0, 1)]
    counts = {}
    for c, i in known:
        for b in sets[i]:
            counts.setdefault(b, [0, 0])[c] += 1
    rows = []
    for b, c in counts.items():
        p, q = ((c[k] + 1) / (n[k] + 2) for k in (1, 0))
        both = (sum(c) + 1) / (sum(n) + 2)
        rows.append((-abs(p - q) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1])) * (sum(c) >= 3), b, np.log(p / q)))
    kept = {b: r for s, b, r in sorted(rows)[: toxicity.KEPT] if -s > 2.5}
    order = sorted(kept)
    x = np.array([[kept[b] * (b in sets[i]) for b in order] for _, i in known])
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rate = 4 / ((x * x).sum() / len(y) + 1)
    w, v, bias, bias_v = np.zeros(len(order)), np.zeros(len(order)), 0.0, 0.0
    for _ in range(toxicity.ROUNDS):
        ahead, ahead_bias = w + 0.9 * v, bias + 0.9 * bias_v
        error = even * (1 / (1 + np.exp(-(x @ ahead + ahead_bias))) - y)
        v, bias_v = 0.9 * v - rate * (x.T @ error / len(y) + toxicity.PENALTY / len(y) * ahead), 0.9 * bias_v - rate * error.mean()
        w, bias = w + v, bias + bias_v
    weight = {b: a * kept[b] for b, a in zip(order, w)}
    for r in queries.op5_toxicity(spark, small).collect():
        z = bias + sum(weight[b] for b in sets[r.doc_id] if b in weight)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6
        assert (r.held_out, r.predicted) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0, int(r.score >= 0.5))
