"""Profiles of slot facts: histogram, mode, coverage, conflicts; by role, and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

SURE = 0.85  #: below it a person has to confirm
HISTOGRAM = 1000  #: values that a histogram lists


def status_of(values, coverage, conflict_at: float):
    return F.when(values == 0, "unresolved").when(values == 1, "resolved").when(coverage <= conflict_at, "conflict").otherwise("resolved_with_conflicts")


def slot_summary(facts: DataFrame, conflict_at: float = 0.5, samples: int = 0, histogram: int = HISTOGRAM) -> DataFrame:
    """One row for each role and slot; counts, mode, ratios and number of values are exact for any number of values.

    Counts by value come first (partial sums before the shuffle, and spread by value, so neither a hot role nor a slot of millions
    of values is one task).  Totals and the mode are partial aggregates of these.  Of the histogram the ``histogram`` most
    frequent values are listed: each task passes on its own so many of a slot, so no list grows with the data; what isn't listed is in
    rest_count and rest_values.  ``samples`` fact ids of each listed value are the smallest, limited in the same way.
    """
    keys = ["role_kind", "slot"]
    known = F.col("value_str").isNotNull()
    by_source = facts.groupBy(*keys, "value_str", "source").agg(F.count("*").alias("c"), F.sum("confidence").alias("sure"))
    values = settled(by_source.groupBy(*keys, "value_str").agg(F.sum("c").alias("c"), F.sum("sure").alias("sure"), F.min(F.struct((-F.col("c")).alias("n"), F.col("source"))).alias("s")), "slot-values")
    totals = values.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, F.col("c"))), F.lit(0)).alias("total_samples"),
        F.sum("c").alias("total_facts"),
        F.count("value_str").alias("n_values"),
        F.min(F.when(known, F.struct((-F.col("c")).alias("n"), F.col("value_str").alias("value"), "sure", F.col("s.source").alias("source")))).alias("mode"),
    )
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "value_str"))
    listed = values.where(known).withColumn("nth", nth).where(F.col("nth") <= histogram).select(*keys, "value_str", "c")
    if samples:
        first = F.row_number().over(Window.partitionBy(*keys, "value_str").orderBy("fact_id"))
        own = facts.join(listed.select(*keys, "value_str"), [*keys, "value_str"], "left_semi").withColumn("nth", first).where(F.col("nth") <= samples)
        listed = listed.join(own.groupBy(*keys, "value_str").agg(F.array_sort(F.collect_list("fact_id")).alias("ids")), [*keys, "value_str"], "left")
    else:
        listed = listed.withColumn("ids", F.lit(None).cast("array<string>"))
    bars = listed.groupBy(F.col("role_kind").alias("_role"), F.col("slot").alias("_slot")).agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), F.col("value_str").alias("value"), "ids"))).alias("h"))
    rows = totals.join(bars, F.col("role_kind").eqNullSafe(F.col("_role")) & F.col("slot").eqNullSafe(F.col("_slot")), "left").withColumn("h", F.coalesce("h", F.array()))
    mode, total = F.col("mode"), F.col("total_samples")
    coverage = F.round(-mode["n"] / total, 6)
    out = rows.select(
        *keys,
        status_of(F.col("n_values"), coverage, conflict_at).alias("status"),
        mode["value"].alias("mode_value"),
        coverage.alias("mode_coverage"),
        F.coalesce(F.round(mode["sure"] / -mode["n"], 6), F.lit(0.0)).alias("confidence"),
        "total_samples",
        "total_facts",
        "n_values",
        F.transform("h", lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("count"), F.round(-x["n"] / total, 6).alias("ratio"), x["ids"].alias("sample_fact_ids"))).alias("value_histogram"),
        (total + F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])).alias("rest_count"),
        (F.col("n_values") - F.size("h")).alias("rest_values"),
        mode["source"].alias("primary_source"),
    )
    return out.withColumn("requires_confirmation", F.col("status").isin("unresolved", "conflict") | (F.col("confidence") < SURE))


def role_summary(summary: DataFrame) -> DataFrame:
    """One row for each role: how many samples, the least sure slot, and whether a person has to confirm."""
    return summary.groupBy("role_kind").agg(
        F.max("total_samples").alias("sample_count"),
        F.round(F.avg("confidence"), 6).alias("role_confidence"),
        F.bool_or("requires_confirmation").alias("requires_confirmation"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("requires_confirmation"), F.concat_ws(":", "slot", "status")))), ",").alias("reasons"),
    )


def rollup(facts: DataFrame, *levels: str) -> DataFrame:
    """Counts, distinct values and mean confidence by each prefix of the levels."""
    return facts.rollup(*levels).agg(F.count("value_str").alias("n_samples"), F.countDistinct("value_str").alias("n_values"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.grouping_id().cast("long").alias("level"))
