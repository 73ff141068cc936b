"""End-to-end products: rules of a standard, audits of other documents, repair plans, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, ledger, profile, repair, rulepacks, rules
from ..sources import documents
from ..sources.tables import settled


def format_facts(spark: SparkSession, folder: str, role: Column, glob: str = "*.docx") -> tuple[DataFrame, DataFrame]:
    """(facts with roles, problem files) of all documents below a folder; ``role`` is an expression over the paragraphs' columns."""
    return facts_of(documents.flattened(documents.files_below(spark, folder, glob)), role)


def facts_of(flattened: DataFrame, role: Column) -> tuple[DataFrame, DataFrame]:
    """The same of documents' nodes and problems."""
    return facts_in(settled(documents.format_nodes(flattened), "nodes"), role)


def facts_in(rows: DataFrame, role: Column) -> tuple[DataFrame, DataFrame]:
    """The same of ``documents.format_nodes`` that are written: they feed paragraphs, styles and formats."""
    nodes, problems = documents.told_apart(rows)
    roles = documents.paragraphs(nodes).select("doc_id", "element_id", role.alias("role_kind"))
    found = documents.paragraph_formats(nodes).join(roles, ["doc_id", "element_id"])
    return found.select("doc_id", "element_id", F.concat_ws(":", "doc_id", "element_id").alias("fact_id"), "role_kind", "slot", "value_str", "source", "confidence"), problems


def rule_summary(found: DataFrame, contract: DataFrame, conflict_at: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(slot summary, what the contract misses in it) of a standard's facts."""
    summary = profile.slot_summary(found, conflict_at, samples=3)
    return summary, audit.missing_slots(contract, summary)


def audit_items(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues of the targets' facts, each with an id, the expected value and a policy."""
    issues = audit.deviations(targets, rules)
    return issues.select(
        scalars.identifier("I-", 16, F.col("fact_id"), F.col("slot")).alias("issue_id"), "doc_id", "element_id", "role_kind", "slot", F.col("value_str").alias("actual"), "expected", F.col("rule_confidence").alias("confidence"), F.col("policy").alias("auto_fix_policy")
    )


def repair_operations(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Operations of all issues that may run: sure ones, and those a person approved; by document in batches, heavy ones alone.

    ``decisions``: issue_id, decision_status.
    """
    chosen = issues.join(decisions, "issue_id", "left").where((F.col("auto_fix_policy") == "auto-fix") | (F.col("decision_status") == "approved"))
    properties = F.create_map("slot", "expected")
    ops = chosen.withColumn("properties", scalars.native_projection(properties)).withColumn("command", F.lit("set"))
    ops = ops.withColumn("risk_class", scalars.risk_class(F.col("properties"), F.col("command"))).withColumn("sequence", F.concat_ws("/", "element_id", "slot"))
    batched = repair.batches(ops.withColumn("alone", F.col("risk_class") == "L3_WRITE"), "doc_id", "sequence", "alone").drop("alone")
    key = F.sha2(F.concat_ws("\n", "doc_id", "sequence", F.to_json("properties")), 256)
    return batched.withColumn("idempotency_key", key)


def review(operations: DataFrame, results: DataFrame, after: DataFrame) -> DataFrame:
    """Verdict on each operation from its result (issue_id, success) and the facts after the change."""
    now = after.select("doc_id", "element_id", "slot", F.col("value_str").alias("after_value"))
    rows = operations.join(results.select("issue_id", "success"), "issue_id", "left").join(now, ["doc_id", "element_id", "slot"], "left")
    rows = rows.withColumns(
        {
            "policy": F.lit("auto-fix"),
            "execution_status": F.lit("executable"),
            "n_ops": F.when(F.col("success").isNull(), 0).otherwise(1),
            "n_failed": F.when(F.col("success"), 0).otherwise(1),
            "n_done": F.when(F.col("success"), 1).otherwise(0),
            "after_exists": F.col("after_value").isNotNull(),
            "after_matches": F.col("after_value").eqNullSafe(F.col("expected")),
            "raw_verified": F.lit(True),
        }
    )
    return repair.verdicts(rows).select("issue_id", "doc_id", "batch", "verdict", "verdict_code")


def acceptance(artifacts: DataFrame, references: DataFrame, inventory: DataFrame, required: list[str]) -> DataFrame:
    """run_id, status, codes: whether a run's evidence is whole: fields, files as declared, references, kinds.

    ``references``: run_id, artifact_id; all checks give violation rows, and one aggregation closes the gate of each run.
    """
    keyed = artifacts.withColumn("entity", F.col("run_id"))
    found = rules.violations(keyed, "artifact", "entity", rulepacks.ARTIFACT).select(F.col("entity_id").alias("run_id"), "code")
    files = ledger.verified(artifacts, inventory).join(artifacts.select("path", "run_id"), "path").select("run_id", "code")
    lost = rules.dangling(references, "artifact_id", artifacts, "artifact_id").select("run_id", F.lit("reference_dangling").alias("code"))
    kinds = ledger.completeness(artifacts, "run_id", required).where("status = 'broken'").select("run_id", F.lit("kinds_missing").alias("code"))
    problems = found.unionByName(files).unionByName(lost).unionByName(kinds).groupBy("run_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    runs = artifacts.select("run_id").distinct().join(problems, "run_id", "left")
    return runs.select("run_id", F.when(F.col("codes").isNull(), "accepted").otherwise("blocked").alias("status"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
