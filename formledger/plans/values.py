"""Scalar functions over the columns of the tables: units, identities, hashes, checks of names and paths, classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.tables import table

def none() -> Column:
    return F.lit(None).cast("string")


def q29_units(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of each part in centimetres, points and lines; marks and defaults."""
    k, size = F.col("p_partkey"), F.col("p_size")
    raw = F.when(k % 7 == 0, F.concat(F.lit("x"), size.cast("string"))).when(k % 11 == 0, none()).otherwise((size * 113).cast("string"))
    rule = F.when(k % 4 == 0, "auto").when(k % 4 == 1, "exact").when(k % 4 == 2, "atLeast")
    spacing = scalars.line_spacing(raw, rule)
    return table(spark, folder, "part").select(
        "p_partkey",
        scalars.twips_to_cm(raw).alias("cm"),
        scalars.half_points_to_pt(raw).alias("pt"),
        scalars.twentieths_to_pt(raw).alias("twentieths"),
        spacing["multiple"].alias("multiple"),
        spacing["points"].alias("points"),
        scalars.three_valued(k % 3 > 0, F.when(k % 5 == 0, "0").when(k % 5 == 1, "false").when(k % 5 == 2, "1")).alias("bold"),
        scalars.orientation(F.when(k % 6 == 0, "landscape")).alias("orientation"),
        scalars.alignment(F.when(k % 3 == 0, "justify").when(k % 3 == 1, "distributed").otherwise("center")).alias("alignment"),
        scalars.cell_role(k % 4 + 1, k % 3 + 1).alias("role"),
    )


def q29b_identities(spark: SparkSession, folder: str) -> DataFrame:
    """How each document is found again, its hashes, and the names made from it."""
    k = F.col("doc_id")
    attributes = F.map_filter(F.create_map(F.lit("paraId"), F.when(k % 3 == 0, k.cast("string")), F.lit("name"), F.when(k % 3 == 1, F.col("lang")), F.lit("id"), F.lit("")), lambda n, v: v.isNotNull())
    found = scalars.selector(attributes, F.concat(F.lit("/body/p["), k.cast("string"), F.lit("]")), F.col("text"))
    json = F.concat(F.lit('{"z":"'), F.col("lang"), F.lit('","a":'), k.cast("string"), F.lit(',"m":[1,{"y":true,"x":null}]}'))
    action = F.struct(F.lit("set").alias("command"), k.alias("target"), F.col("source").alias("value"), F.lit("h").alias("selected_action_sha256"), F.col("lang").alias("decided_by"), F.lit("now").alias("decided_at"))
    values = F.create_map(F.lit("name"), F.col("lang"), F.lit("gone"), none())
    return table(spark, folder, "documents").select(
        "doc_id",
        found["kind"].alias("kind"),
        found["value"].alias("value"),
        found["rebindable"].alias("rebindable"),
        found["content_fingerprint"].alias("content_fingerprint"),
        scalars.content_hash(json).alias("content_hash"),
        scalars.selected_action_hash(action).alias("action_hash"),
        scalars.filled(F.concat(F.lit("{name} of {other}{gone}: "), F.col("source")), values).alias("filled"),
        scalars.canonical_id(F.when(k % 4 == 0, "state").when(k % 4 == 1, "repair-plan-draft").when(k % 4 == 2, "run-state").otherwise(F.col("source"))).alias("canonical"),
        scalars.result_file(k % 1000, F.concat_ws(" / ", "source", "lang")).alias("result_file"),
    )


def q29c_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of names and paths and classes of warnings, outcomes and states, over orders."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    xpath = F.when(k % 3 == 0, "/w:document[1]/w:body[1]/w:p[2]").when(k % 3 == 1, "/w:document[1]/w:p").otherwise(F.concat(F.lit("/w:p["), (k % 5).cast("string"), F.lit("]")))
    place = F.when(k % 5 == 0, "../x").when(k % 5 == 1, "format_rules/a").when(k % 5 == 2, "rules/a b").when(k % 5 == 3, "a/format_runs/r1/rules").otherwise(F.concat(F.lit("rules/"), k.cast("string")))
    properties = F.create_map(F.lit("size"), k.cast("string"), F.lit("bold"), F.when(k % 2 == 0, "true"), F.lit("color"), none())
    target = F.when(k % 4 == 0, "word/w:tbl[1]").when(k % 4 == 1, "w:NUMPR").when(k % 4 == 2, "w:r").otherwise(none())
    severities = F.array(scalars.warning_severity(target), F.lit("advisory"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        xpath.rlike(scalars.SINGLE_NODE_XPATH).alias("single_node"),
        scalars.rule_path_problem(place).alias("rule_path"),
        F.concat(F.col("o_orderstatus"), F.lit("_"), (k % 100).cast("string")).rlike(scalars.NAME).alias("name_ok"),
        scalars.final_name_ok(F.when(k % 2 == 0, F.concat(F.lit("a_final_v"), k.cast("string"), F.lit(".docx"))).otherwise(F.concat(F.lit("a/b_final_v"), k.cast("string"), F.lit(".doc")))).alias("final_name"),
        F.to_json(scalars.native_projection(properties)).alias("native"),
        scalars.review_state(k % 5 > 0, F.when(k % 3 == 0, "blocked").when(k % 3 == 1, "pending").otherwise("done"), k % 4).alias("review_state"),
        scalars.warning_severity(target).alias("severity"),
        scalars.outcome_ok(F.when(k % 2 == 0, k % 3), k % 7 > 1, severities).alias("outcome_ok"),
        scalars.viewer(F.when(k % 3 == 0, " WPS Writer").when(k % 3 == 1, "Microsoft Word 2021").otherwise(priority)).alias("viewer"),
        scalars.status_label(F.when(k % 4 == 0, "blocked").when(k % 4 == 1, "accepted").when(k % 4 == 2, "odd")).alias("status_label"),
    )


QUERIES = {"q29_units": q29_units, "q29b_identities": q29b_identities, "q29c_checks": q29c_checks}
ORACLE_SQL = {
    "q29_units": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_size WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_size * 113)::VARCHAR END AS raw, (['auto', 'exact', 'atLeast', NULL])[p_partkey % 4 + 1] AS rule FROM part), n AS (SELECT *, TRY_CAST(raw AS BIGINT) AS n FROM p)
SELECT k AS p_partkey, round(n / 567.0::DOUBLE, 2) AS cm, n / 2.0::DOUBLE AS pt, n / 20.0::DOUBLE AS twentieths, CASE WHEN coalesce(rule, 'auto') = 'auto' THEN round(n / 240.0::DOUBLE, 3) END AS multiple, CASE WHEN rule IN ('exact', 'atLeast') THEN n / 20.0::DOUBLE END AS points,
CASE WHEN k % 3 > 0 THEN k % 5 NOT IN (0, 1) END AS bold, CASE WHEN k % 6 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, (['both', 'distribute', 'center'])[k % 3 + 1] AS alignment,
CASE WHEN k % 4 = 0 THEN 'header' WHEN k % 3 = 0 THEN 'field_name' ELSE 'field_value' END AS role FROM n""",
    "q29b_identities": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'native_id' WHEN 1 THEN 'semantic_key' ELSE 'positional' END AS kind, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN lang ELSE '/body/p[' || doc_id || ']' END AS value, doc_id % 3 < 2 AS rebindable,
sha256(coalesce(text, '')) AS content_fingerprint, sha256('{"a":' || doc_id || ',"m":[1,{"x":null,"y":true}],"z":"' || lang || '"}') AS content_hash, sha256('{"command":"set","target":' || doc_id || ',"value":"' || source || '"}') AS action_hash,
lang || ' of {other}: ' || source AS filled, CASE doc_id % 4 WHEN 0 THEN 'run-state' WHEN 1 THEN 'repair-plan' WHEN 2 THEN 'run-state' ELSE source END AS canonical, printf('%03d', doc_id % 1000) || '_' || regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9_.-]+', '_', 'g') || '.result.json' AS result_file FROM documents""",
    "q29c_checks": r"""SELECT o_orderkey, o_orderkey % 3 = 0 OR (o_orderkey % 3 = 2 AND o_orderkey % 5 > 0) AS single_node, CASE o_orderkey % 5 WHEN 0 THEN 'path_escapes' WHEN 1 THEN 'path_retired' WHEN 2 THEN 'path_characters' WHEN 3 THEN 'path_retired' END AS rule_path, true AS name_ok, o_orderkey % 2 = 0 AS final_name,
CASE WHEN o_orderkey % 2 = 0 THEN '{"size":"' || o_orderkey || '","bold":"true"}' ELSE '{"size":"' || o_orderkey || '"}' END AS native,
CASE WHEN o_orderkey % 5 = 0 THEN 'not_required' WHEN o_orderkey % 3 = 0 THEN 'blocked' WHEN o_orderkey % 3 = 1 OR o_orderkey % 4 > 0 THEN 'pending' ELSE 'cleared' END AS review_state, CASE WHEN o_orderkey % 4 < 2 THEN 'blocking' ELSE 'advisory' END AS severity,
(o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) OR (o_orderkey % 7 > 1 AND o_orderkey % 4 >= 2) AS outcome_ok, CASE o_orderkey % 3 WHEN 0 THEN 'wps' WHEN 1 THEN 'word' END AS viewer, (['[阻断]', '[已通过]', '[状态未知]', '[状态未知]'])[o_orderkey % 4 + 1] AS status_label FROM orders""",
}
