"""Audits: deviations from profiled rules, differences of snapshots, references, duplicates, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, facts, profile, repair, rules
from ..sources.tables import table
from . import profiles

STANDARD = "src0"  #: the source whose documents are the standard


def q04_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all other documents that differ from the rule that the standard's documents give, by role, slot and value."""
    docs = table(spark, folder, "documents")
    known = profile.slot_summary(profiles.paragraph_facts(docs.where(F.col("source") == STANDARD)))
    targets = profiles.paragraph_facts(docs.where(F.col("source") != STANDARD))
    found = audit.deviations(targets, known)
    return found.groupBy("role_kind", "slot", "value_str", "expected", "policy").agg(F.count("*").alias("n"))


def q05_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are there more than once, and users whose events differ in kind: kind, number of keys and rows."""
    docs = table(spark, folder, "documents").select(scalars.lf_hash(F.col("text")).alias("sha"), "source")
    twice = rules.duplicates(docs, "sha").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows")).withColumn("kind", F.lit("duplicate_text"))
    conflicts = rules.index_conflicts(docs, "sha", "source").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows")).withColumn("kind", F.lit("source_conflict"))
    return twice.unionByName(conflicts)


def altered(orders: DataFrame) -> DataFrame:
    """The orders as they are after some repairs: a few removed, added and changed."""
    key = F.col("o_orderkey")
    kept = orders.where(key % 17 != 3)
    changed = kept.withColumn("o_orderpriority", F.when(key % 5 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))).withColumn("o_orderstatus", F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    added = orders.where(key % 23 == 1).withColumn("o_orderkey", key + 100_000_000)
    return changed.unionByName(added)


_AFTER = """after AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 17 <> 3
UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 23 = 1)"""


def q07_snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Orders before and after: added, removed, changed, with the changed fields."""
    orders = table(spark, folder, "orders")
    return audit.diff(orders, altered(orders), "o_orderkey", ["o_custkey", "o_orderpriority", "o_orderstatus"])


def q07b_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Each cell that differs from the reference table, and rows on one side."""
    orders = table(spark, folder, "orders")
    return audit.drift(altered(orders), orders, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


def q08_references(spark: SparkSession, folder: str) -> DataFrame:
    """References of altered tables that don't resolve: table, target, number."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    kept = altered(orders).select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").where(F.col("c_custkey") % 11 != 5).select("c_custkey")
    parts = table(spark, folder, "part").where(F.col("p_partkey") % 13 != 2).select("p_partkey")
    found = [
        ("lineitem", "orders", rules.dangling(lines.select("l_orderkey"), "l_orderkey", kept, "o_orderkey")),
        ("lineitem", "part", rules.dangling(lines.select("l_partkey"), "l_partkey", parts, "p_partkey")),
        ("orders", "customer", rules.dangling(kept, "o_custkey", customers, "c_custkey")),
    ]
    out = None
    for name, target, rows in found:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), F.lit(target).alias("target"), "n")
        out = one if out is None else out.unionByName(one)
    return out


WHITELIST = [("W1", "set", "format", "priority"), ("W2", "set", "format", "status"), ("W3", "remove", "structure", None)]


def actions_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("action_id"),
        F.when(key % 4 == 0, "W1").when(key % 4 == 1, "W2").when(key % 4 == 2, "W3").otherwise("W9").alias("whitelist_id"),
        F.when(key % 3 == 0, "remove").otherwise("set").alias("operation"),
        F.when(key % 3 == 0, "structure").otherwise("format").alias("action_type"),
        F.when(key % 3 == 0, F.lit(None).cast("string")).when(key % 2 == 0, "priority").otherwise("status").alias("target_attribute"),
    )


def q09_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Actions whose whitelist row is unknown or differs, with the first field that does."""
    allowed = spark.createDataFrame(WHITELIST, "whitelist_id string, operation string, action_type string, target_attribute string")
    return repair.policy_mismatches(actions_of(table(spark, folder, "orders")), allowed)


def q09b_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk class of each order's action by what it would change."""
    key = F.col("o_orderkey")
    name = F.when(key % 5 == 0, "border.top").when(key % 5 == 1, "shd.fill").otherwise("font_size_pt")
    command = F.when(key % 9 == 0, "raw-set").when(key % 4 == 0, "move").otherwise("set")
    rows = table(spark, folder, "orders").select(scalars.risk_class(F.create_map(name, F.col("o_orderpriority")), command).alias("risk_class"), "o_orderstatus")
    return rows.groupBy("risk_class", "o_orderstatus").agg(F.count("*").alias("n"))


def q17_style_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Customers inherit from nations, nations from regions, regions from one base, by segment: each style with its ancestors and their level."""
    customers = table(spark, folder, "customer")
    segments = customers.select(F.col("c_mktsegment").alias("doc_id")).distinct()
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    leaves = customers.select(F.col("c_mktsegment").alias("doc_id"), name("C", "c_custkey").alias("style_id"), name("N", "c_nationkey").alias("based_on"))
    shared = table(spark, folder, "nation").select(name("N", "n_nationkey").alias("style_id"), name("R", "n_regionkey").alias("based_on"))
    shared = shared.unionByName(table(spark, folder, "region").select(name("R", "r_regionkey").alias("style_id"), F.lit("base").alias("based_on")))
    base = segments.select("doc_id", F.lit("base").alias("style_id"), F.lit("R0").alias("based_on"))  # a loop ends its chain
    return facts.style_chains(leaves.unionByName(segments.crossJoin(F.broadcast(shared))).unionByName(base))


def q24_review(spark: SparkSession, folder: str) -> DataFrame:
    """Items from labels, decisions for some, counts by source."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels")
    issues = labels.where("quality = 0 OR toxic = 1").join(docs, "doc_id").withColumn("blocking", F.col("toxic") == 1)
    items = repair.review_items(issues, "source", "doc_id")
    decisions = items.where(F.col("doc_id") % 3 == 0).select("source", "review_id", F.when(F.col("doc_id") % 2 == 0, "approved").otherwise("rejected").alias("decision_status"))
    return repair.review_counts(repair.decided(items, decisions, ["source", "review_id"]), "source")


QUERIES = {
    "q04_audit": q04_audit,
    "q05_duplicates": q05_duplicates,
    "q07_snapshot_diff": q07_snapshot_diff,
    "q07b_drift": q07b_drift,
    "q08_references": q08_references,
    "q09_policy": q09_policy,
    "q09b_risk": q09b_risk,
    "q17_style_chains": q17_style_chains,
    "q24_review": q24_review,
}
_STD = profiles._SUMMARY.format(facts="(SELECT * FROM facts WHERE src = 'src0')")
ORACLE_SQL = {
    "q04_audit": f"WITH {profiles._FACTS}, {_STD} SELECT f.role_kind, f.slot, f.value_str, s.mode_value AS expected, 'auto-fix' AS policy, count(*) AS n FROM facts f JOIN summary s USING (role_kind, slot) WHERE src <> 'src0' AND f.value_str IS DISTINCT FROM s.mode_value GROUP BY ALL",
    "q05_duplicates": "WITH t AS (SELECT text, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY 1) SELECT 'duplicate_text' AS kind, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM t WHERE n > 1 UNION ALL SELECT 'source_conflict', count(*), sum(n)::BIGINT FROM t WHERE s > 1",
    "q07_snapshot_diff": f"WITH {_AFTER}, j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_orderkey AS bk, a.o_orderkey AS ak, concat_ws(',', CASE WHEN b.o_custkey IS DISTINCT FROM a.o_custkey THEN 'o_custkey' END, CASE WHEN b.o_orderpriority IS DISTINCT FROM a.o_orderpriority THEN 'o_orderpriority' END, CASE WHEN b.o_orderstatus IS DISTINCT FROM a.o_orderstatus THEN 'o_orderstatus' END) AS f FROM orders b FULL JOIN after a ON a.o_orderkey = b.o_orderkey) SELECT o_orderkey, CASE WHEN bk IS NULL THEN 'added' WHEN ak IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN bk IS NOT NULL AND ak IS NOT NULL THEN f END AS fields FROM j WHERE bk IS NULL OR ak IS NULL OR f <> ''",
    "q07b_drift": f"""WITH {_AFTER}, j AS (SELECT e.o_orderkey AS ek, a.o_orderkey AS ak, e.o_orderpriority AS ep, a.o_orderpriority AS ap, e.o_orderstatus AS es, a.o_orderstatus AS "as_" FROM orders e FULL JOIN after a ON a.o_orderkey = e.o_orderkey)
SELECT ek AS o_orderkey, 'missing' AS code, NULL::VARCHAR AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM j WHERE ak IS NULL UNION ALL SELECT ak, 'unknown', NULL, NULL, NULL FROM j WHERE ek IS NULL
UNION ALL SELECT ek, 'field_differs', 'o_orderpriority', ep, ap FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND ep IS DISTINCT FROM ap UNION ALL SELECT ek, 'field_differs', 'o_orderstatus', es, as_ FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND es IS DISTINCT FROM as_""",
    "q08_references": f"WITH {_AFTER} SELECT 'lineitem' AS entity, 'orders' AS target, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM after) UNION ALL SELECT 'lineitem', 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 13 <> 2) UNION ALL SELECT 'orders', 'customer', count(*) FROM after WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 5)",
    "q09_policy": """WITH w(whitelist_id, wo, wt, wa) AS (VALUES ('W1', 'set', 'format', 'priority'), ('W2', 'set', 'format', 'status'), ('W3', 'remove', 'structure', NULL)),
a AS (SELECT o_orderkey AS action_id, CASE o_orderkey % 4 WHEN 0 THEN 'W1' WHEN 1 THEN 'W2' WHEN 2 THEN 'W3' ELSE 'W9' END AS whitelist_id, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'set' END AS o, CASE WHEN o_orderkey % 3 = 0 THEN 'structure' ELSE 'format' END AS t, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'priority' ELSE 'status' END AS att FROM orders)
SELECT action_id, whitelist_id, CASE WHEN wo IS NULL THEN 'policy_unknown' WHEN o <> wo THEN 'policy_operation' WHEN t <> wt THEN 'policy_type' ELSE 'policy_attribute' END AS code FROM a LEFT JOIN w USING (whitelist_id) WHERE wo IS NULL OR o <> wo OR t <> wt OR att IS DISTINCT FROM wa""",
    "q09b_risk": "SELECT CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 5 IN (0, 1) THEN 'L3_WRITE' WHEN o_orderkey % 4 = 0 THEN 'L2' ELSE 'L1' END AS risk_class, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "q17_style_chains": """WITH RECURSIVE g AS (SELECT DISTINCT c_mktsegment AS doc_id FROM customer), s AS (SELECT c_mktsegment AS doc_id, 'C' || c_custkey AS style_id, 'N' || c_nationkey AS based_on FROM customer UNION ALL SELECT doc_id, 'N' || n_nationkey, 'R' || n_regionkey FROM g, nation UNION ALL SELECT doc_id, 'R' || r_regionkey, 'base' FROM g, region UNION ALL SELECT doc_id, 'base', 'R0' FROM g),
c AS (SELECT doc_id, style_id, style_id AS ancestor, 0 AS level, [style_id] AS seen FROM s UNION ALL SELECT c.doc_id, c.style_id, s.based_on, level + 1, list_append(seen, s.based_on) FROM c JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.ancestor WHERE NOT list_contains(seen, s.based_on)) SELECT doc_id, style_id, level, ancestor FROM c""",
    "q24_review": "WITH i AS (SELECT d.source, l.doc_id, toxic = 1 AS blocking, CASE WHEN l.doc_id % 3 <> 0 THEN 'pending' WHEN l.doc_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS s FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0 OR toxic = 1) SELECT source, count(*) AS n_items, count(*) FILTER (s = 'pending') AS pending_count, count(*) FILTER (blocking) AS blocking_count, count(*) FILTER (blocking AND s = 'pending') AS unresolved_count FROM i GROUP BY ALL",
}
