"""Profiles: slots of texts and of wide tables, roles, registries, rollups, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import facts, profile, rules
from ..sources.tables import table


def paragraph_facts(docs: DataFrame) -> DataFrame:
    """Slots of each line: whether it ends with a period, its length's bucket, the language; the first line is the heading."""
    lines = facts.paragraphs(docs)
    role = F.when(F.col("pos") == 1, "heading-level-1").otherwise("body-paragraph")
    slots = {
        "ends_with_period": F.endswith(F.trim("line"), F.lit(".")).cast("string"),
        "length_bucket": F.least(F.floor(F.length("line") / 100), F.lit(9)).cast("string"),
        "lang": F.col("lang"),
    }
    return facts.from_table(lines, F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")), role, slots)


_FACTS = r"""lines AS (SELECT doc_id, lang, source AS src, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS pos FROM documents),
facts AS (SELECT doc_id, src, CASE WHEN pos = 1 THEN 'heading-level-1' ELSE 'body-paragraph' END AS role_kind, slot, value_str, doc_id || ':' || pos AS fact_id FROM (
SELECT *, 'ends_with_period' AS slot, CASE WHEN ends_with(trim(line), '.') THEN 'true' ELSE 'false' END AS value_str FROM lines
UNION ALL SELECT *, 'length_bucket', cast(least(length(line) // 100, 9) AS VARCHAR) FROM lines
UNION ALL SELECT *, 'lang', lang FROM lines))"""
_SUMMARY = """vals AS (SELECT role_kind, slot, value_str, count(*) AS c FROM {facts} WHERE value_str IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, sum(c) OVER (PARTITION BY role_kind, slot) AS total, count(*) OVER (PARTITION BY role_kind, slot) AS n, row_number() OVER (PARTITION BY role_kind, slot ORDER BY c DESC, value_str) AS r FROM vals),
summary AS (SELECT role_kind, slot, CASE WHEN n = 1 THEN 'resolved' WHEN round(c / total, 6) <= 0.5 THEN 'conflict' ELSE 'resolved_with_conflicts' END AS status, value_str AS mode_value, round(c / total, 6) AS mode_coverage, 0.98::DOUBLE AS confidence, cast(total AS BIGINT) AS total_samples, n AS n_values FROM ranked WHERE r = 1)"""
_OUT = "role_kind, slot, status, mode_value, mode_coverage, confidence, total_samples, n_values"


def q01_slot_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram, mode, coverage and status of each role and slot of all documents."""
    summary = profile.slot_summary(paragraph_facts(table(spark, folder, "documents")))
    return summary.select(*_OUT.split(", "))


def q01b_slot_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The histogram's rows with their ratio and the first three facts of each value."""
    summary = profile.slot_summary(paragraph_facts(table(spark, folder, "documents")), samples=3)
    rows = summary.select("role_kind", "slot", F.explode("value_histogram").alias("h"))
    return rows.select("role_kind", "slot", F.col("h.value").alias("value"), F.col("h.count").alias("n"), F.col("h.ratio").alias("ratio"), F.array_join("h.sample_fact_ids", ",").alias("samples"))


def q02_role_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Samples, mean confidence and reasons for confirmation of each role."""
    return profile.role_summary(profile.slot_summary(paragraph_facts(table(spark, folder, "documents"))))


#: The registry of the wide table's slots: type, smallest and largest value, allowed values.
REGISTRY = {
    "l_quantity": ("number", 1, 45, None),
    "l_discount": ("number", 0, 0.08, None),
    "l_tax": ("number", 0, 0.07, None),
    "l_returnflag": ("enum", None, None, ("A", "N")),
    "l_linestatus": ("enum", None, None, ("O", "F")),
}


def registry_rules() -> list[rules.Rule]:
    out = []
    for slot, (kind, low, high, allowed) in REGISTRY.items():
        if kind == "number":
            out.append(rules.Rule("slot_range", slot, f"{slot} BETWEEN {low} AND {high}"))
        else:
            out.append(rules.Rule("slot_enum", slot, f"{slot} IN ({', '.join(repr(a) for a in allowed)})"))
    return out


def q03_registry_check(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the wide table that its registry doesn't allow, by code and field; one read, no explode before the filter."""
    lines = table(spark, folder, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), *REGISTRY)
    found = rules.violations(lines, "lineitem", "id", registry_rules())
    return found.groupBy("entity_kind", "code", "field", "severity").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


def q06_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs with position, id, preview and a deterministic node id."""
    lines = facts.paragraphs(table(spark, folder, "documents").select("doc_id", "text"))
    path = F.concat(F.lit("/body/p["), F.col("pos").cast("string"), F.lit("]"))
    return lines.select("doc_id", "pos", scalars.paragraph_id(F.col("pos")).alias("element_id"), scalars.preview(F.col("line")).alias("text_preview"), scalars.identifier("N-", 24, F.col("doc_id").cast("string"), path, F.lit("p")).alias("node_id"), scalars.ordinal(path).alias("ordinal"), scalars.parent_path(path).alias("parent_path"))


def q27_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of the wide table's flags rolled up: by flag and status, by flag, over all."""
    lines = table(spark, folder, "lineitem")
    return lines.rollup("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_samples"), F.countDistinct("l_quantity").alias("n_values"), F.round(F.avg("l_discount"), 4).alias("mean_discount"), F.grouping_id().cast("long").alias("level")
    )


def q28_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Formats in three layers: of all orders of a status, of a customer's segment, of the order itself; the strongest that isn't empty counts."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    own = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("value_str"), F.lit("direct").alias("source"), F.lit(3).alias("precedence"))
    style = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("value_str"), F.lit("style_inherit").alias("source"), F.lit(2).alias("precedence"))
    base = orders.select("o_orderkey", F.col("o_orderstatus").alias("value_str"), F.lit("doc_defaults").alias("source"), F.lit(1).alias("precedence"))
    layers = own.unionByName(style).unionByName(base).withColumn("slot", F.lit("label"))
    return facts.layered(layers, "o_orderkey").groupBy("source", "value_str").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


QUERIES = {
    "q01_slot_profile": q01_slot_profile,
    "q01b_slot_histogram": q01b_slot_histogram,
    "q02_role_profile": q02_role_profile,
    "q03_registry_check": q03_registry_check,
    "q06_positions": q06_positions,
    "q27_rollup": q27_rollup,
    "q28_layers": q28_layers,
}
_CHECKS = " UNION ALL ".join(
    f"SELECT CASE WHEN {r.holds} THEN NULL ELSE '{r.code}' END AS code, '{r.field}' AS field, '{r.severity}' AS severity, l_orderkey || '-' || l_linenumber AS id FROM lineitem" for r in registry_rules()
)
ORACLE_SQL = {
    "q01_slot_profile": f"WITH {_FACTS}, {_SUMMARY.format(facts='facts')} SELECT {_OUT} FROM summary",
    "q01b_slot_histogram": f"WITH {_FACTS}, c AS (SELECT role_kind, slot, value_str AS value, count(*) AS n, array_to_string(list_sort(list(fact_id ORDER BY fact_id)[1:3]), ',') AS samples FROM facts WHERE value_str IS NOT NULL GROUP BY ALL) SELECT role_kind, slot, value, n, round(n / sum(n) OVER (PARTITION BY role_kind, slot), 6) AS ratio, samples FROM c",
    "q02_role_profile": f"WITH {_FACTS}, {_SUMMARY.format(facts='facts')} SELECT role_kind, max(total_samples) AS sample_count, round(avg(confidence), 6)::DOUBLE AS role_confidence, bool_or(status IN ('unresolved', 'conflict') OR confidence < 0.85) AS requires_confirmation, coalesce(string_agg(CASE WHEN status IN ('unresolved', 'conflict') OR confidence < 0.85 THEN slot || ':' || status END, ',' ORDER BY slot), '') AS reasons FROM summary GROUP BY ALL",
    "q03_registry_check": f"SELECT 'lineitem' AS entity_kind, code, field, severity, count(*) AS n, min(id) AS first_id FROM ({_CHECKS}) WHERE code IS NOT NULL GROUP BY ALL",
    "q06_positions": f"WITH {_FACTS} SELECT doc_id, cast(pos AS INT) AS pos, printf('p-%05d', pos) AS element_id, left(trim(line), 120) AS text_preview, 'N-' || left(sha256(doc_id || chr(10) || '/body/p[' || pos || ']' || chr(10) || 'p'), 24) AS node_id, cast(pos - 1 AS INT) AS ordinal, '/body' AS parent_path FROM lines",
    "q27_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n_samples, count(DISTINCT l_quantity) AS n_values, round(avg(l_discount), 4) AS mean_discount, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "q28_layers": "WITH l AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS own, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS style, o_orderstatus AS base FROM orders LEFT JOIN customer ON o_custkey = c_custkey) SELECT CASE WHEN own IS NOT NULL THEN 'direct' WHEN style IS NOT NULL THEN 'style_inherit' ELSE 'doc_defaults' END AS source, coalesce(own, style, base) AS value_str, count(*) AS n, CASE WHEN own IS NOT NULL THEN 0.98 WHEN style IS NOT NULL THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM l GROUP BY ALL",
}
