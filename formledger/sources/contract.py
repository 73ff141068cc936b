"""Contract tables: roles with required, optional and forbidden slots; the registry of slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "role_kind string, category string, required_slots array<string>, optional_slots array<string>, forbidden_slots array<string>"
REGISTRY = "slot string, data_type string, unit string, nullable boolean, enum_values array<string>, min double, max double"


def slots(spark: SparkSession, path: str) -> DataFrame:
    """role_kind, category, slot, requirement from JSON lines of roles."""
    roles = spark.read.schema(CONTRACT).json(path)

    def marked(kind: str):
        of = F.coalesce(f"{kind}_slots", F.array().cast("array<string>"))
        return F.transform(of, lambda s: F.struct(s.alias("slot"), F.lit(kind).alias("requirement")))

    kinds = [marked(k) for k in ("required", "optional", "forbidden")]
    return roles.select("role_kind", "category", F.explode(F.concat(*kinds)).alias("s")).select("role_kind", "category", "s.slot", "s.requirement")


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).json(path)


def value_problems(facts: DataFrame, known: DataFrame) -> DataFrame:
    """fact_id, slot, code: values that their slot's type, list or range doesn't allow; slots that no registry has."""
    rows = facts.join(known, "slot", "left")
    number = F.col("value_str").try_cast("double")
    code = (
        F.when(F.col("data_type").isNull(), "slot_unknown")
        .when(F.col("value_str").isNull(), F.when(~F.col("nullable"), "slot_null"))
        .when((F.col("data_type") == "number") & number.isNull(), "slot_type")
        .when((F.col("data_type") == "boolean") & ~F.col("value_str").isin("true", "false"), "slot_type")
        .when((F.col("data_type") == "enum") & ~F.array_contains("enum_values", F.col("value_str")), "slot_enum")
        .when((number < F.col("min")) | (number > F.col("max")), "slot_range")
    )
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select("fact_id", "slot", "value_str", "code")
