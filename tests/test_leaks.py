"""Embedded JSON against Python's own parser, markers, sessions of a stream."""

import json
import random

from pyspark.sql import functions as F

from formledger.operators import report


def outermost(text):
    """Outermost objects by trying every bracket with Python's parser."""
    out, i = [], 0
    decoder = json.JSONDecoder()
    while (i := text.find("{", i)) >= 0:
        try:
            _, end = decoder.raw_decode(text, i)
            out.append((i, end))
            i = end
        except ValueError:
            i += 1
    return out


def test_embedded_json(spark):
    rng = random.Random(4)
    values = lambda d: rng.choice(['"a}b"', '"\\"{"', "1", "null", "[1,{}]"] if d > 2 else ["2", "{" + ", ".join(f'"{c}": {values(d + 1)}' for c in rng.sample("abc", rng.randrange(3))) + "}"])
    texts = [None, "", "no", "{", "}", "}{", "{}", "a {x} b", '{"a": 1}}{"b": 2}', "{ {}"]
    texts += ["é " * rng.randrange(3) + "".join(rng.choice(["word ", "} ", "{ ", values(0), values(0), "{x} "]) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: [(x.start, x.end) for x in r.p or []] for r in df.select("i", report.embedded_json(F.col("t")).alias("p")).collect()}
    assert got == {i: outermost(t or "") for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 50


def test_leaks_and_markers(spark):
    lines = spark.createDataFrame([(1, 'done {"n": 1, "schema_id": 2}'), (2, "by docx-writer"), (3, "docx"), (4, '{"a": {"schema_id": 1}}')], "i long, line string")
    assert sorted((r.i, r.code, r.start) for r in report.leaks(lines, ["i"], "line").collect()) == [(1, "internal_json", 5), (2, "internal_name", None), (4, "embedded_json", 0)]
    marks = spark.createDataFrame([(1, "🔴 x"), (1, "必须先处理"), (2, "🔴 x ✅"), (3, "⚠️ 警告"), (4, None)], "r long, line string")
    assert sorted((r.r, r.marker) for r in report.marker_problems(marks, "r", "line").collect()) == [(2, "✅"), (2, "🔴")]
