"""Audits: facts against rules, snapshots against each other, tables against what they should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deviations(facts: DataFrame, rules: DataFrame, sure: float = 0.85) -> DataFrame:
    """Facts that differ from the rule of their role and slot (null counts as a value).

    Rules are one row for each role and slot; Spark broadcasts them if its statistics say they are small.  The recommended
    action follows from the rule's confidence: a sure rule may be applied, others need a person.
    """
    r = rules.select("role_kind", "slot", F.col("mode_value").alias("expected"), F.col("confidence").alias("rule_confidence"))
    off = facts.join(r, ["role_kind", "slot"]).where(~F.col("value_str").eqNullSafe(F.col("expected")))
    action = F.when(F.col("rule_confidence") >= sure, "auto-fix").otherwise("manual-review")
    return off.withColumn("policy", action).withColumn("issue", F.concat_ws(":", "role_kind", "slot"))


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed), fields: sorted names of the changed fields, joined by commas.

    One full outer join; comparison is null-safe, so a table against itself gives no row.
    """
    b = before.select(F.col(key).alias("_b"), F.struct(*fields).alias("old"))
    a = after.select(F.col(key).alias("_a"), F.struct(*fields).alias("new"))
    both = b.join(a, F.col("_b") == F.col("_a"), "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), f) for f in sorted(fields)]))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(names) > 0, "changed")
    changed = F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), F.array_join(names, ","))
    return both.select(F.coalesce("_b", "_a").alias(key), change.alias("change"), changed.alias("fields")).where(F.col("change").isNotNull())


def diff_nodes(before: DataFrame, after: DataFrame, doc: str, identity: str, path: str, fields: list[str]) -> DataFrame:
    """Nodes of two snapshots, matched by identity where both have it, the rest by path.

    doc, matched_by (identity, path or none), path_before, path_after, change (added, removed, changed, moved), fields.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(doc).alias("_doc"), F.col(identity).alias("_id"), F.col(path).alias(f"path_{name}"), F.struct(*fields).alias(name))

    b, a = side(before, "before"), side(after, "after")
    same = b.where("_id IS NOT NULL").join(a.where("_id IS NOT NULL"), ["_doc", "_id"]).withColumn("matched_by", F.lit("identity"))
    met = same.select("_doc", "path_before", "path_after")
    rest_b = b.join(met.select("_doc", "path_before"), ["_doc", "path_before"], "left_anti").drop("_id")
    rest_a = a.join(met.select("_doc", "path_after"), ["_doc", "path_after"], "left_anti").drop("_id")
    x, y = rest_b.alias("x"), rest_a.withColumnRenamed("_doc", "_doc_after").alias("y")
    both = x.join(y, (F.col("x._doc") == F.col("y._doc_after")) & (F.col("path_before") == F.col("path_after")), "full_outer")
    by = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), "path").otherwise("none")
    rest = both.select(F.coalesce("_doc", "_doc_after").alias("_doc"), "path_before", "before", "path_after", "after", by.alias("matched_by"))
    rows = same.select(*rest.columns).unionByName(rest)
    names = F.array_compact(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), f) for f in sorted(fields)]))
    pair = F.col("path_before").isNotNull() & F.col("path_after").isNotNull()
    change = F.when(F.col("path_before").isNull(), "added").when(F.col("path_after").isNull(), "removed").when(F.size(names) > 0, "changed").when(F.col("path_before") != F.col("path_after"), "moved")
    out = rows.select(F.col("_doc").alias(doc), "matched_by", "path_before", "path_after", change.alias("change"), F.when(pair, F.array_join(names, ",")).alias("fields"))
    return out.where("change IS NOT NULL")


def drift(actual: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, code (missing, unknown, field_differs), field, expected, actual: a table against its reference."""
    e = expected.select(F.col(key).alias("_e"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("want"))
    a = actual.select(F.col(key).alias("_a"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("have"))
    rows = e.join(a, F.col("_e") == F.col("_a"), "full_outer")
    cells = F.array(*[F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"have.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"want.{f}").alias("expected"), F.col(f"have.{f}").alias("actual"))) for f in fields])
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    one_sided = F.col("_e").isNull() | F.col("_a").isNull()
    out = rows.withColumn("cell", F.explode(F.when(one_sided, whole).otherwise(F.array_compact(cells))))
    code = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unknown").otherwise("field_differs")
    return out.select(F.coalesce("_e", "_a").alias(key), code.alias("code"), "cell.field", "cell.expected", "cell.actual")


def missing_slots(contract: DataFrame, summary: DataFrame) -> DataFrame:
    """role_kind, slot, code, blocks: required slots that are missing, unresolved, in conflict or unsure; forbidden ones present."""
    s = summary.select("role_kind", "slot", "status", "confidence")
    rows = contract.join(s, ["role_kind", "slot"], "left")
    required, forbidden = F.col("requirement") == "required", F.col("requirement") == "forbidden"
    code = (
        F.when(required & F.col("status").isNull(), "required_slot_missing")
        .when(required & (F.col("status") == "unresolved"), "required_slot_unresolved")
        .when(required & (F.col("status") == "conflict"), "required_slot_conflict")
        .when(required & (F.col("confidence") == 0), "required_slot_confidence_eq_0")
        .when(required & (F.col("confidence") < 0.85), "required_slot_confidence_lt_0_85")
        .when(forbidden & F.col("status").isNotNull() & (F.col("status") != "unresolved"), "forbidden_slot_present")
    )
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select("role_kind", "slot", "code", (F.col("code") != "required_slot_confidence_lt_0_85").alias("blocks"))
