"""Evidence and run state: artifacts, references, hash chains, gates, attempts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stages of a run, in order.
STAGES = ("init", "rule_selection", "fact_extraction", "semantic_strategy", "rule_packaging", "format_audit", "repair_planning", "manual_review", "repair_execution", "after_snapshot", "review", "toc_acceptance", "final_acceptance", "reporting", "completed")
UNKNOWN_STAGE = 10_000


def stage_rank(stage: Column) -> Column:
    out = F.lit(UNKNOWN_STAGE)
    for i, name in enumerate(STAGES):
        out = F.when(stage == name, i).otherwise(out)
    return out


def verified(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, code for declared artifacts (path, sha256, size_bytes) that the inventory lacks or has otherwise."""
    real = inventory.select("path", F.col("sha256").alias("real_sha256"), F.col("size_bytes").alias("real_size"))
    rows = declared.join(real, "path", "left")
    code = F.when(F.col("real_sha256").isNull(), "artifact_missing").when(F.col("sha256") != F.col("real_sha256"), "artifact_hash").when(F.col("size_bytes") != F.col("real_size"), "artifact_size")
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select("path", "code")


def completeness(artifacts: DataFrame, run: str, required: list[str]) -> DataFrame:
    """present, missing (sorted, joined) and status for each run: missing kinds always make it broken."""
    kinds = artifacts.groupBy(run).agg(F.collect_set("kind").alias("kinds"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), "kinds"))
    return kinds.select(run, F.array_join(F.array_sort("kinds"), ",").alias("present"), F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) > 0, "broken").otherwise("complete").alias("status"))


def chain_heads(events: DataFrame, run: str, order: str, *fields: str) -> DataFrame:
    """run, chain_head, n_events: each event is hashed with the head before it; any change changes the head.

    A run's events come to one task in order, which keeps the head only, however many they are.
    """
    value = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    rows = events.select(F.col(run).alias("run"), F.col(order).alias("k"), value.alias("v")).repartition("run").sortWithinPartitions("run", "k", "v").select("run", "v")

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list) -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["run", "chain_head", "n_events"])

        now, head, n, done = None, "", 0, []
        for part in parts:
            kind = part.schema.field(0).type
            for own, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if n and own != now:
                    done.append((now, head, n))
                    head, n = "", 0
                now, head, n = own, hashlib.sha256(f"{head}/{v}".encode()).hexdigest(), n + 1
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if n:
            yield batch([*done, (now, head, n)])

    kind = events.schema[run].dataType
    schema = T.StructType([T.StructField("run", kind), T.StructField("chain_head", T.StringType()), T.StructField("n_events", T.LongType())])
    return rows.mapInArrow(fold, schema).withColumnRenamed("run", run)


def gate_decision() -> tuple[Column, Column]:
    """(outcome, reason) of a stage result; the first condition that holds decides.

    Columns: contract_valid, state_valid, status, schema_valid, checks_valid, review_state, next_kind, n_blockers, error_code,
    gate_passed, run_matches, stage_matches, manifest_status, refs_resolve, next_valid, slots_ok.
    """
    c = F.col
    pending = c("review_state") == "pending"
    waiting = (c("status") == "waiting_user") & ~c("gate_passed") & pending
    chain = [
        (~c("contract_valid"), "blocked", "contract_invalid"),
        (~c("state_valid"), "blocked", "state_invalid"),
        (c("status") == "synthetic_failure", "blocked", "synthetic_failure"),
        (~c("schema_valid"), "blocked", "schema_invalid"),
        (~c("checks_valid"), "blocked", "checks_failed"),
        (waiting & (c("next_kind") == "wait_user") & (c("n_blockers") == 0) & c("error_code").isNull(), "waiting_user", "manual_review_pending"),
        (waiting, "blocked", "waiting_user_invalid"),
        (c("status") == "blocked", "blocked", "blocked_result"),
        (c("status") != "done", "blocked", "not_done"),
        (~c("gate_passed"), "blocked", "gate_not_passed"),
        (c("n_blockers") > 0, "blocked", "blockers_present"),
        (c("error_code").isNotNull(), "blocked", "error_present"),
        (pending, "waiting_user", "manual_review_pending_when_done"),
        (c("review_state") == "blocked", "blocked", "manual_review_blocked"),
        (~c("run_matches"), "blocked", "run_id_mismatch"),
        (~c("stage_matches"), "blocked", "stage_mismatch"),
        (c("manifest_status") == "broken", "blocked", "manifest_broken"),
        (~c("refs_resolve"), "blocked", "evidence_refs_unresolved"),
        (~c("next_valid"), "blocked", "next_action_invalid"),
        (~c("slots_ok"), "blocked", "slots_unresolved"),
    ]
    outcome, reason = F.lit("advance"), F.lit("all_passed")
    for condition, o, r in reversed(chain):
        outcome, reason = F.when(F.coalesce(condition, F.lit(False)), o).otherwise(outcome), F.when(F.coalesce(condition, F.lit(False)), r).otherwise(reason)
    return outcome, reason


def attempts(log: DataFrame, run: str, order: str, budget: int) -> DataFrame:
    """Add attempt_no and remaining: the first attempt keeps the budget, each later one takes one, never below 0."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(order))
    return log.withColumn("attempt_no", n).withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - (F.col("attempt_no") - 1)))


def regressions(results: DataFrame, run: str, order: str, rank: str) -> DataFrame:
    """Results whose stage is before the one of the result before."""
    before = F.lag(rank).over(Window.partitionBy(run).orderBy(order))
    return results.withColumn("rank_before", before).where(F.col(rank) < F.col("rank_before"))


def resumable(results: DataFrame, run: str, order: str, rank: str) -> DataFrame:
    """run, last, furthest, agrees: whether the last result is of the furthest stage, so a run may go on from it."""
    return results.groupBy(run).agg(F.max_by(rank, order).alias("last_rank"), F.max(rank).alias("furthest_rank"), F.max(order).alias("last_result")).withColumn("agrees", F.col("last_rank") == F.col("furthest_rank"))


def replays(results: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Each result's kind: first, replay (same key and content as the first) or conflict (same key, other content)."""
    first = F.first(content).over(Window.partitionBy(key).orderBy(order))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return results.withColumn("append", F.when(nth == 1, "first").when(F.col(content).eqNullSafe(first), "replay").otherwise("conflict"))


def latest(plans: DataFrame, run: str, *order: Column) -> DataFrame:
    """The last plan of each run, by time and then by number (never by name)."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(*[o.desc_nulls_last() for o in order]))
    return plans.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


#: What a run's status may become.
TRANSITIONS = (("running", "done"), ("running", "retryable_failure"), ("running", "failed"), ("done", "executed_ready"), ("retryable_failure", "running"), ("executed_ready", "review_ready"))


def bad_transitions(log: DataFrame, run: str, order: str, status: str, allowed: tuple = TRANSITIONS) -> DataFrame:
    """Entries whose status may not follow the one before; the first entry of a run may be any."""
    before = F.lag(status).over(Window.partitionBy(run).orderBy(order))
    step = F.concat_ws(">", "source_status", status)
    return log.withColumn("source_status", before).where(F.col("source_status").isNotNull() & ~step.isin([f"{a}>{b}" for a, b in allowed]))


def open_batches(batches: DataFrame, done: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches that a resumed run still has to do."""
    return batches.join(done.select(key).distinct(), key, "left_anti")


def missing_results(results: DataFrame, run: str, order: str) -> DataFrame:
    """run, order: gaps in the numbers of a run's results up to its last."""
    spans = results.groupBy(run).agg(F.max(order).alias("last"))
    want = spans.select(run, F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias(order))
    return want.join(results.select(run, F.col(order).cast("int").alias(order)).distinct(), [run, order], "left_anti")


def resume_decision() -> Column:
    """What to do with a run, from chain_valid, failure_kind, contract_valid, next_kind, agrees and remaining; the first that holds decides."""
    c = F.col
    return (
        F.when(~c("chain_valid") & (c("failure_kind") == "missing"), "synthesize_failure")
        .when(~c("chain_valid"), "manual_recover")
        .when(~c("contract_valid"), "blocked")
        .when(c("next_kind") == "wait_user", "wait_user")
        .when((c("next_kind") == "retry") & (c("remaining") <= 0), "blocked")
        .when(~c("agrees"), "apply_last_result")
        .when(c("next_kind").isin("finalize", "stop"), c("next_kind"))
        .otherwise("run_next")
    )


def safe_outputs(state: DataFrame, results: DataFrame, run: str, column: str) -> DataFrame:
    """All output ids that a run's state or results name, sorted and once."""
    both = state.select(run, F.explode(column).alias("id")).unionByName(results.select(run, F.explode(column).alias("id")))
    return both.groupBy(run).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def missing_files(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """test_id, path of expected evidence files that no inventory row ends with."""
    have = inventory.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_name")).distinct()
    return expected.join(have, F.regexp_extract("path", r"([^/]+)$", 1) == F.col("_name"), "left_anti")


def coverage_summary(tests: DataFrame) -> DataFrame:
    """status, n, ids (sorted): how tests (test_id, status) stand."""
    return tests.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("test_id")).alias("ids"))
