"""Runs: batches, results, verdicts, gates, chains, attempts; events are the log, a user is a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, repair
from ..sources.tables import table

RANKS = {"signup": "init", "view": "fact_extraction", "click": "format_audit", "purchase": "review", "error": "repair_execution"}


def q10_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each user in batches of at most 12; errors stand alone."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    out = repair.batches(events.withColumn("alone", F.col("event_type") == "error"), "user_id", "event_id", "alone")
    return out.select("user_id", "event_id", F.col("batch").cast("long").alias("batch"), F.col("position").cast("long").alias("position"))


def _operations(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations of each batch, and results that lack some and name other commands."""
    rows = repair.batches(events.withColumn("alone", F.lit(False)), "user_id", "event_id", "alone")
    ops = rows.select(F.concat_ws(":", "user_id", "batch").alias("batch_id"), (F.col("position") - 1).alias("index"), "event_id", F.col("event_type").alias("command"), "value")
    results = ops.where((F.col("event_id") % 10 != 7) & (F.col("index") < 10)).select("batch_id", "index", (F.col("command") != "error").alias("success"), F.when(F.col("event_id") % 50 == 3, "other").otherwise(F.col("command")).alias("command"))
    return ops, results


def q11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Status of each operation by what came back for its index."""
    ops, results = _operations(table(spark, folder, "events"))
    return repair.aligned(ops, results, "batch_id").select("event_id", "status")


def q12_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on actions over orders, counted by priority: what ran, and what the order looks like after."""
    k = F.col("o_orderkey")
    actions = table(spark, folder, "orders").select(
        "o_orderpriority",
        F.when(k % 10 == 0, "manual-review").when(k % 10 == 1, "audit-only").otherwise("auto-fix").alias("policy"),
        F.when(k % 13 == 0, "blocked").otherwise("executable").alias("execution_status"),
        F.when(k % 4 == 0, "remove").when(k % 4 == 1, "raw-set").when(k % 4 == 2, "move").otherwise("set").alias("command"),
        (k % 3).alias("n_ops"),
        F.when((k % 3 > 0) & (k % 19 == 0), 1).otherwise(0).alias("n_failed"),
        F.when(k % 7 == 0, 0).otherwise(k % 3).alias("n_done"),
        (k % 5 != 0).alias("after_exists"),
        (F.col("o_orderstatus") != "P").alias("after_matches"),
        (F.col("o_orderstatus") == "O").alias("raw_verified"),
    )
    return repair.verdict_summary(repair.verdicts(actions), "o_orderpriority")


def _results(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return events.select(
        "user_id",
        "event_id",
        (i % 41 != 0).alias("contract_valid"),
        (i % 43 != 0).alias("state_valid"),
        F.when(i % 37 == 0, "synthetic_failure").when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "view", "waiting_user").otherwise("done").alias("status"),
        (i % 31 != 0).alias("schema_valid"),
        (i % 29 != 0).alias("checks_valid"),
        F.when((F.col("event_type") == "view") | (i % 23 == 0), "pending").when(i % 19 == 0, "blocked").otherwise("not_required").alias("review_state"),
        F.when(F.col("event_type") == "view", "wait_user").otherwise("run_skill").alias("next_kind"),
        F.when(i % 17 == 0, 1).otherwise(0).alias("n_blockers"),
        F.when(i % 13 == 0, "E").alias("error_code"),
        ((F.col("event_type") != "view") & (i % 11 != 0)).alias("gate_passed"),
        (i % 47 != 0).alias("run_matches"),
        (i % 53 != 0).alias("stage_matches"),
        F.when(i % 59 == 0, "broken").otherwise("complete").alias("manifest_status"),
        (i % 61 != 0).alias("refs_resolve"),
        (i % 67 != 0).alias("next_valid"),
        (i % 71 != 0).alias("slots_ok"),
    )


def q13_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of the stage gate by outcome and reason."""
    outcome, reason = ledger.gate_decision()
    return _results(table(spark, folder, "events")).select(outcome.alias("outcome"), reason.alias("reason")).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def q14_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Head of each run's hash chain."""
    return ledger.chain_heads(table(spark, folder, "events"), "user_id", "event_id", "event_id", "event_type")


def q15_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Stages of each run: regressions, last and furthest stage, attempts and what remains of the budget."""
    events = table(spark, folder, "events")
    stage = F.lit(None).cast("string")
    for kind, name in RANKS.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
    rows = events.select("user_id", "event_id", "event_type", ledger.stage_rank(stage).alias("rank"))
    back = ledger.regressions(rows, "user_id", "event_id", "rank").groupBy("user_id").agg(F.count("*").alias("n_regressions"))
    tries = ledger.attempts(rows.where("event_type = 'error'"), "user_id", "event_id", 3).groupBy("user_id").agg(F.max("attempt_no").cast("long").alias("n_attempts"), F.min("remaining").cast("long").alias("remaining"))
    done = ledger.resumable(rows, "user_id", "event_id", "rank")
    return done.join(back, "user_id", "left").join(tries, "user_id", "left").select("user_id", F.col("last_rank").cast("long").alias("last_rank"), F.col("furthest_rank").cast("long").alias("furthest_rank"), "agrees", F.coalesce("n_regressions", F.lit(0)).alias("n_regressions"), F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), F.coalesce("remaining", F.lit(3)).alias("remaining"))


def q15b_replays(spark: SparkSession, folder: str) -> DataFrame:
    """Appends by idempotency key: first, replay or conflict."""
    events = table(spark, folder, "events").withColumn("key", F.concat_ws(":", "user_id", F.floor(F.col("event_id") / 100).cast("string")))
    return ledger.replays(events, "key", "event_id", "event_type").groupBy("append").agg(F.count("*").alias("n"))


def q21_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of evidence that each run has and lacks."""
    events = table(spark, folder, "events").where("value < 60").select("user_id", F.col("event_type").alias("kind"))
    return ledger.completeness(events, "user_id", ["signup", "view", "click", "purchase", "approval"])


QUERIES = {
    "q10_batches": q10_batches,
    "q11_alignment": q11_alignment,
    "q12_verdicts": q12_verdicts,
    "q13_gates": q13_gates,
    "q14_chain": q14_chain,
    "q15_stages": q15_stages,
    "q15b_replays": q15b_replays,
    "q21_completeness": q21_completeness,
}
_RANK = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {ledger.STAGES.index(v)}" for k, v in RANKS.items()) + " END"
_OPS = """ops AS (SELECT user_id, event_id, event_type AS command, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 12 AS idx, user_id || ':' || ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 12) AS batch FROM events),
res AS (SELECT batch, idx, command <> 'error' AS success, CASE WHEN event_id % 50 = 3 THEN 'other' ELSE command END AS got FROM ops WHERE event_id % 10 <> 7 AND idx < 10)"""
ORACLE_SQL = {
    "q10_batches": """WITH a AS (SELECT user_id, event_id, event_type = 'error' AS s, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM events),
b AS (SELECT *, CASE WHEN s THEN 0 ELSE (row_number() OVER (PARTITION BY user_id, i, s ORDER BY event_id) - 1) // 12 END AS p FROM a), c AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY i, s, p) AS batch FROM b)
SELECT user_id, event_id, batch, row_number() OVER (PARTITION BY user_id, batch ORDER BY event_id) AS position FROM c""",
    "q11_alignment": f"WITH {_OPS}, j AS (SELECT o.event_id, o.idx, o.command, r.success, r.got, min(CASE WHEN NOT r.success THEN o.idx END) OVER (PARTITION BY o.batch) AS ff, max(CASE WHEN r.success IS NOT NULL THEN o.idx END) OVER (PARTITION BY o.batch) AS li FROM ops o LEFT JOIN res r USING (batch, idx)) SELECT event_id, CASE WHEN success IS NULL AND (idx > coalesce(ff, 1000000) OR idx > coalesce(li, -1)) THEN 'not_run' WHEN success IS NULL OR got <> command THEN 'mismatch' WHEN success THEN 'executed' ELSE 'failed' END AS status FROM j",
    "q12_verdicts": """WITH a AS (SELECT o_orderpriority, o_orderkey AS k, o_orderstatus AS s, o_orderkey % 4 AS c FROM orders), v AS (SELECT o_orderpriority, CASE WHEN k % 10 = 0 THEN 'manual_required' WHEN k % 10 = 1 THEN 'not_executed' WHEN k % 13 = 0 THEN 'not_executed' WHEN k % 3 = 0 THEN 'not_executed' WHEN k % 19 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'not_executed'
WHEN c = 3 AND (k % 5 = 0 OR s = 'P') THEN 'failed' WHEN c = 1 AND s <> 'O' THEN 'failed' WHEN c = 0 AND k % 5 <> 0 THEN 'failed' WHEN c = 2 AND k % 5 = 0 THEN 'failed' ELSE 'passed' END AS v FROM a)
SELECT o_orderpriority, count(*) FILTER (v = 'passed') AS n_passed, count(*) FILTER (v = 'failed') AS n_failed, count(*) FILTER (v = 'manual_required') AS n_manual_required, count(*) FILTER (v = 'not_executed') AS n_not_executed FROM v GROUP BY ALL""",
    "q13_gates": """WITH e AS (SELECT event_id AS i, event_type AS t, CASE WHEN event_type = 'view' OR event_id % 23 = 0 THEN 'pending' WHEN event_id % 19 = 0 THEN 'blocked' ELSE 'none' END AS r FROM events),
g AS (SELECT CASE WHEN i % 41 = 0 THEN 'contract_invalid' WHEN i % 43 = 0 THEN 'state_invalid' WHEN i % 37 = 0 THEN 'synthetic_failure' WHEN i % 31 = 0 THEN 'schema_invalid' WHEN i % 29 = 0 THEN 'checks_failed'
WHEN t = 'view' AND i % 17 <> 0 AND i % 13 <> 0 THEN 'manual_review_pending' WHEN t = 'view' THEN 'waiting_user_invalid' WHEN t = 'error' THEN 'blocked_result' WHEN i % 11 = 0 THEN 'gate_not_passed' WHEN i % 17 = 0 THEN 'blockers_present' WHEN i % 13 = 0 THEN 'error_present'
WHEN r = 'pending' THEN 'manual_review_pending_when_done' WHEN r = 'blocked' THEN 'manual_review_blocked' WHEN i % 47 = 0 THEN 'run_id_mismatch' WHEN i % 53 = 0 THEN 'stage_mismatch' WHEN i % 59 = 0 THEN 'manifest_broken' WHEN i % 61 = 0 THEN 'evidence_refs_unresolved' WHEN i % 67 = 0 THEN 'next_action_invalid' WHEN i % 71 = 0 THEN 'slots_unresolved' ELSE 'all_passed' END AS reason FROM e)
SELECT CASE WHEN reason = 'all_passed' THEN 'advance' WHEN reason LIKE 'manual_review_pending%' THEN 'waiting_user' ELSE 'blocked' END AS outcome, reason, count(*) AS n FROM g GROUP BY ALL""",
    "q14_chain": "SELECT user_id, list_reduce(list_prepend('', list(event_id || '|' || event_type ORDER BY event_id)), lambda acc, x: sha256(concat(acc, '/', x))) AS chain_head, count(*) AS n_events FROM events GROUP BY user_id",
    "q15_stages": f"""WITH r AS (SELECT user_id, event_id, event_type, {_RANK} AS k, lag({_RANK}) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, max_by(k, event_id)::BIGINT AS last_rank, max(k)::BIGINT AS furthest_rank, max_by(k, event_id) = max(k) AS agrees, count(*) FILTER (k < b) AS n_regressions, count(*) FILTER (event_type = 'error') AS n_attempts, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 3 ELSE greatest(0, 4 - count(*) FILTER (event_type = 'error')) END::BIGINT AS remaining FROM r GROUP BY user_id""",
    "q15b_replays": "WITH k AS (SELECT *, row_number() OVER w AS nth, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_id // 100 ORDER BY event_id)) SELECT CASE WHEN nth = 1 THEN 'first' WHEN event_type = f THEN 'replay' ELSE 'conflict' END AS append, count(*) AS n FROM k GROUP BY ALL",
    "q21_completeness": "WITH k AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS p FROM events WHERE value < 60 GROUP BY 1) SELECT user_id, array_to_string(p, ',') AS present, array_to_string(list_sort(list_filter(['signup', 'view', 'click', 'purchase', 'approval'], lambda x: NOT list_contains(p, x))), ',') AS missing, 'broken' AS status FROM k",
}
