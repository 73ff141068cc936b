"""Profiles of slots with many values."""

from collections import Counter

from pyspark.sql import functions as F

from formledger.operators import profile


def test_slot_of_many_values(spark):
    n = 60_000
    facts = spark.range(n).select(
        F.format_string("f%06d", "id").alias("fact_id"), F.lit("body").alias("role_kind"), F.when(F.col("id") % 3 == 0, "wide").otherwise("narrow").alias("slot"),
        F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 30 == 0, "often").otherwise(F.col("id").cast("string"))).when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("value_str"),
        F.lit("direct").alias("source"), F.lit(1.0).alias("confidence"),
    )
    got = {r.slot: r for r in profile.slot_summary(facts, samples=2, histogram=4).collect()}
    wide = Counter("often" if i % 30 == 0 else str(i) for i in range(0, n, 3))
    row = got["wide"]
    assert (row.mode_value, row.total_samples, row.n_values, row.mode_coverage) == ("often", n // 3, len(wide), round(wide["often"] / (n // 3), 6))
    assert [(h.value, h["count"]) for h in row.value_histogram] == sorted(wide.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert row.value_histogram[0].sample_fact_ids == ["f000000", "f000030"]
    assert (row.rest_count, row.rest_values) == (n // 3 - wide["often"] - 3, len(wide) - 4)
    narrow = Counter(str(i % 5) for i in range(n) if i % 3 and i % 7)
    row = got["narrow"]
    assert row.total_facts == n - n // 3 and row.total_samples == sum(narrow.values()) and row.n_values == 5 and row.rest_values == 1
    assert row.rest_count == min(narrow.values()) and row.status == "conflict"


def test_slots_without_values(spark):
    facts = spark.createDataFrame([("f", "r", "s", None, "unresolved", 0.0), ("g", None, "s", "x", "direct", 1.0)], "fact_id string, role_kind string, slot string, value_str string, source string, confidence double")
    got = {r.role_kind: (r.status, r.mode_value, r.total_samples, r.n_values, len(r.value_histogram), r.rest_count) for r in profile.slot_summary(facts).collect()}
    assert got == {"r": ("unresolved", None, 0, 0, 0, 0), None: ("resolved", "x", 1, 1, 1, 0)}
