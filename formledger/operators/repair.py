"""Repairs: actions from issues and decisions, batches of operations, results, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.tables import settled
from . import numbering

BATCH = 12  #: operations in a batch


def review_items(issues: DataFrame, run: str, *order: str) -> DataFrame:
    """Issues get a number in their run and an id from it."""
    return numbering.numbered(issues, run, *order).withColumn("review_id", F.format_string("R-%04d", F.col("nth")))


def decided(items: DataFrame, decisions: DataFrame, key: str | list[str] = "review_id") -> DataFrame:
    """Items with their decision; without one they are pending."""
    return items.join(decisions, key, "left").withColumn("decision_status", F.coalesce("decision_status", F.lit("pending")))


def review_counts(items: DataFrame, run: str) -> DataFrame:
    """Blocking items count whether decided or not; unresolved are the blocking ones that are pending."""
    pending = F.col("decision_status") == "pending"
    return items.groupBy(run).agg(
        F.count("*").alias("n_items"), F.count_if(pending).alias("pending_count"), F.count_if(F.col("blocking")).alias("blocking_count"), F.count_if(pending & F.col("blocking")).alias("unresolved_count")
    )


def policy_mismatches(actions: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Actions that may run only if a whitelist row has their operation, type and attribute; code and the action's id."""
    w = whitelist.select("whitelist_id", F.struct("operation", "action_type", "target_attribute").alias("allowed"))
    rows = actions.join(w, "whitelist_id", "left")
    own = F.struct("operation", "action_type", "target_attribute")
    code = (
        F.when(F.col("allowed").isNull(), "policy_unknown")
        .when(own["operation"] != F.col("allowed.operation"), "policy_operation")
        .when(own["action_type"] != F.col("allowed.action_type"), "policy_type")
        .when(~own["target_attribute"].eqNullSafe(F.col("allowed.target_attribute")), "policy_attribute")
    )
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select("action_id", "whitelist_id", "code")


def batches(operations: DataFrame, run: str, order: str, alone: str, size: int = BATCH) -> DataFrame:
    """Add batch and position: at most ``size`` in order; an operation marked ``alone`` stands alone and closes the open batch.

    Running values over chunks of a run, so runs may be of any length.
    """
    return numbering.batched(operations, run, order, alone, size)


def aligned(operations: DataFrame, results: DataFrame, batch: str) -> DataFrame:
    """Status of each operation of a batch from results by index.

    executed or failed with a result; without one not_run after the first failure or past the last result, else mismatch;
    mismatch too for a result of another command.  Duplicate results and indexes out of range are rows of ``result_problems``.
    """
    one = results.groupBy(batch, "index").agg(F.bool_and("success").alias("success"), F.first("command").alias("_command"))
    rows = operations.join(one, [batch, "index"], "left")
    w = Window.partitionBy(batch)
    first = F.min(F.when(~F.col("success"), F.col("index"))).over(w)
    last = F.max(F.when(F.col("success").isNotNull(), F.col("index"))).over(w)
    absent = F.col("success").isNull()
    status = (
        F.when(absent & ((F.col("index") > F.coalesce(first, F.lit(1 << 30))) | (F.col("index") > F.coalesce(last, F.lit(-1)))), "not_run")
        .when(absent | (F.col("_command").isNotNull() & (F.col("_command") != F.col("command"))), "mismatch")
        .when(F.col("success"), "executed")
        .otherwise("failed")
    )
    return rows.withColumn("status", status).drop("_command", "success")


def result_problems(operations: DataFrame, results: DataFrame, batch: str) -> DataFrame:
    """batch, index, code: duplicate_index, out_of_range."""
    sizes = operations.groupBy(batch).agg(F.count("*").alias("n"))
    rows = results.groupBy(batch, "index").agg(F.count("*").alias("c")).join(sizes, batch, "left")
    code = F.when((F.col("index") >= F.coalesce("n", F.lit(0))) | (F.col("index") < 0), "out_of_range").when(F.col("c") > 1, "duplicate_index")
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select(batch, "index", "code")


def verdict():
    """Status of an action from its columns: policy, execution_status, command, n_ops, n_failed, n_done, and what the snapshots say.

    The first condition that holds decides.  ``verdict_code`` names the reason of what isn't passed.
    """
    c = F.col
    chain = [
        (c("policy") == "manual-review", "manual_required", None),
        (c("policy") != "auto-fix", "not_executed", None),
        (c("execution_status") != "executable", "not_executed", "action_not_executable"),
        (c("n_ops") == 0, "not_executed", "missing_result"),
        (c("n_failed") > 0, "failed", "action_failed"),
        (c("n_done") < c("n_ops"), "not_executed", "action_not_run"),
        ((c("command") == "set") & ~c("after_exists"), "failed", "after_node_missing"),
        ((c("command") == "set") & ~c("after_matches"), "failed", "after_property_mismatch"),
        ((c("command") == "raw-set") & ~c("raw_verified"), "failed", "raw_write_not_verified"),
        ((c("command") == "remove") & c("after_exists"), "failed", "removed_node_still_present"),
        (c("command").isin("add", "move", "swap") & ~c("after_exists"), "failed", "action_unverifiable"),
    ]
    status, code = F.lit("passed"), F.lit(None).cast("string")
    for condition, s, k in reversed(chain):
        status = F.when(condition, s).otherwise(status)
        code = F.when(condition, F.lit(k).cast("string")).otherwise(code)
    return status, code


def verdicts(actions: DataFrame) -> DataFrame:
    status, code = verdict()
    return actions.withColumn("verdict", status).withColumn("verdict_code", code)


VERDICTS = ["passed", "failed", "manual_required", "not_executed"]


def verdict_summary(judged: DataFrame, run: str) -> DataFrame:
    """Counts by verdict, one column each."""
    return judged.groupBy(run).agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS])


def applied_decisions(items: DataFrame, decisions: DataFrame, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """(items with the newest decision of each, hash recomputed; decisions for unknown items)."""
    newest = decisions.groupBy(key).agg(F.max_by(F.struct("decision_status", "selected_action", "decided_by", "decided_at"), "decided_at").alias("d"))
    out = items.join(newest, key, "left").withColumn("decision_status", F.coalesce("d.decision_status", "decision_status"))
    out = out.withColumn("selected_action", F.when(F.col("d").isNotNull(), F.col("d.selected_action")).otherwise(F.col("selected_action")))
    out = out.withColumn("selected_action_sha256", F.sha2(F.to_json(F.parse_json("selected_action")), 256)).drop("d")
    return out, decisions.join(items.select(key), key, "left_anti")


def expected_changes(properties):
    """``key=value`` texts of a map of properties, sorted."""
    return F.array_sort(F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))


def property_mismatches(expected, actual):
    """Sorted keys whose value after a change isn't the expected one."""
    off = F.map_filter(expected, lambda k, v: ~v.eqNullSafe(F.try_element_at(actual, k)))
    return F.array_sort(F.map_keys(off))


def inverted(nodes: DataFrame, key: str, node_id: str) -> DataFrame:
    """Index rows (key, node_id), sorted within partitions by key; write them partitioned and they stay rows, never one list."""
    return nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), node_id).repartitionByRange("key").sortWithinPartitions("key", node_id)


def heavy_write_problems(operations: DataFrame, decisions: DataFrame, parts: DataFrame) -> DataFrame:
    """operation_id, code: heavy writes that lack what authorises them.

    The command must be a raw one with a single-node path, one match and the payload's hash; the decision approved and bound to the
    payload; the part in the state that the plan saw; and the operation alone in its batch.
    """
    d = decisions.select(F.col("review_id").alias("_review"), F.col("decision_status").alias("_decision"), F.col("payload_sha256").alias("_bound"))
    p = parts.select("run_id", F.col("part_name").alias("_part"), F.col("sha256").alias("_part_sha"))
    own = (
        F.when(F.col("command") != "raw-set", "heavy_not_raw")
        .when(~F.coalesce(F.col("xpath").rlike(scalars.SINGLE_NODE_XPATH), F.lit(False)), "heavy_xpath")
        .when(F.coalesce(F.col("expected_match_count"), F.lit(0)) != 1, "heavy_match_count")
        .when(F.sha2("xml", 256) != F.col("xml_sha256"), "heavy_payload_hash")
    )
    decision = F.when(F.col("_decision").isNull() | (F.col("_decision") != "approved"), "heavy_not_approved").when(~F.col("_bound").eqNullSafe(F.col("xml_sha256")), "heavy_not_bound")
    last = F.when(~F.col("_part_sha").eqNullSafe(F.col("precondition_sha256")), "heavy_part_changed").when(F.col("n_in_batch") != 1, "heavy_not_alone")
    coded = lambda df: df.where(F.col("code").isNotNull()).select("operation_id", "code")
    # what an operation says of itself is judged before the joins, and each join takes what is still open
    heavy = operations.where("risk_class = 'L3_WRITE'")
    first = heavy.withColumn("code", own)
    open_ = first.where("code IS NULL").select("operation_id", "run_id", "part", "review_id", "xml_sha256", "precondition_sha256", "n_in_batch")
    second = settled(open_.join(d, F.col("review_id") == F.col("_review"), "left").select("operation_id", "run_id", "part", "precondition_sha256", "n_in_batch", decision.alias("code")), "decided-writes")
    third = second.where("code IS NULL").join(p.withColumnRenamed("run_id", "_run"), (F.col("run_id") == F.col("_run")) & (F.col("part") == F.col("_part")), "left").withColumn("code", last)
    return coded(first).unionByName(coded(second)).unionByName(coded(third))


def flattened(batches: DataFrame, operations: str, *keep: str) -> DataFrame:
    """One row for each operation of a batch's array: the kept columns, index (from 0) and the operation's fields."""
    return batches.select(*keep, F.posexplode(operations).alias("index", "_op")).select(*keep, "index", "_op.*")


def raw_writes(actions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """action_id, code (null: verified), after_sha256: raw writes (run_id, part, xpath, xml, xml_sha256, expected_match_count, precondition_sha256) against the parts before and after.

    Parts (run_id, part_name, sha256) meet by name, with or without a leading slash.
    """
    name = lambda c: F.regexp_replace(c, "^/+", "")
    of = lambda df, n: df.select(F.col("run_id").alias(f"_run_{n}"), name("part_name").alias(f"_part_{n}"), F.col("sha256").alias(f"_{n}"))
    meets = lambda n: (F.col("run_id") == F.col(f"_run_{n}")) & (name("part") == F.col(f"_part_{n}"))
    rows = actions.join(of(before, "before"), meets("before"), "left").join(of(after, "after"), meets("after"), "left")
    code = (
        F.when(~F.coalesce(F.col("expected_match_count") == 1, F.lit(False)), "match_count")
        .when(~F.coalesce(F.col("xpath").rlike(scalars.SINGLE_NODE_XPATH), F.lit(False)), "xpath")
        .when(~F.sha2(F.coalesce("xml", F.lit("")), 256).eqNullSafe(F.col("xml_sha256")), "payload_hash")
        .when(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("precondition_sha256")), "precondition")
        .when(F.col("_after").isNull(), "part_missing")
        .when(F.col("_before") == F.col("_after"), "part_unchanged")
    )
    return rows.select("action_id", code.alias("code"), F.col("_after").alias("after_sha256"))
