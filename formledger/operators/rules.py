"""One engine for all row rules: an entity table and its rules give violation rows.

A rule pack is a list of rules (code, field, SQL condition that must hold, severity, message).  All conditions of a pack become one
array column that is exploded, so the entity table is read once and nothing is shuffled.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Rule:
    """``holds`` must be true; null counts as broken, for a missing value never passes."""

    code: str
    field: str
    holds: str
    severity: str = "error"
    message: str = ""


def violations(entities: DataFrame, kind: str, id_col: str, pack: list[Rule]) -> DataFrame:
    """entity_kind, entity_id, code, field, severity, message."""
    broken = [
        F.when(~F.coalesce(F.expr(r.holds).cast("boolean"), F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"), F.lit(r.message or r.code).alias("message")))
        for r in pack
    ]
    found = entities.select(F.col(id_col).cast("string").alias("entity_id"), F.explode(F.array_compact(F.array(*broken))).alias("v"))
    return found.select(F.lit(kind).alias("entity_kind"), "entity_id", "v.code", "v.field", "v.severity", "v.message")


def gate(found: DataFrame, key: str = "entity_id") -> DataFrame:
    """Any error blocks: status, sorted codes and counts for each key."""
    errors = F.collect_set(F.when(F.col("severity") == "error", F.col("code")))
    return found.groupBy(key).agg(
        F.when(F.count_if(F.col("severity") == "error") > 0, "blocked").otherwise("passed").alias("status"),
        F.array_sort(errors).alias("failed_codes"),
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that are there more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def index_conflicts(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """Keys whose rows differ in one of the fields."""
    smallest = [F.min(F.struct(F.col(f))).alias(f"_low_{f}") for f in fields] + [F.max(F.struct(F.col(f))).alias(f"_high_{f}") for f in fields]
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"_low_{f}") != F.col(f"_high_{f}"))
    return df.groupBy(key).agg(F.count("*").alias("n"), *smallest).where(differs).select(key, "n")


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References without a target; null references are none."""
    ids = targets.select(F.col(target).alias("_target")).distinct()
    return refs.where(F.col(ref).isNotNull()).join(ids, F.col(ref) == F.col("_target"), "left_anti")


def missing_and_extra(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, side: what only one of two sets has."""
    a, e = actual.select(key).distinct(), expected.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def listed(found: DataFrame, key: str = "entity_id") -> DataFrame:
    """key, problems: the violations of each entity as ``field: code``, by field and code; a pack's size bounds the list."""
    item = F.concat(F.col("field"), F.lit(": "), F.col("code"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("field", "code", item.alias("text")))), lambda x: x["text"]).alias("problems"))


def first_rows(df: DataFrame, key: str, order: list, limit: int = 50) -> DataFrame:
    """The first rows of each key, with their place; the limit is the feature (what a reader sees of a long list)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("place", nth).where(F.col("place") <= limit)
