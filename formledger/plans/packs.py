"""Rule packs over entities that orders and documents stand for: how many break each rule, and the first of them.

Columns of the entities are expressions that Spark and DuckDB read alike (``SHA`` aside); what must hold is the pack's in Spark and
written anew in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rulepacks, rules
from ..sources.tables import table

K = "o_orderkey"
STAGE = "CASE WHEN k % 8 = 0 THEN 'init' WHEN k % 8 = 1 THEN 'format_audit' WHEN k % 8 = 2 THEN 'review' WHEN k % 8 = 3 THEN 'final_acceptance' WHEN k % 8 = 4 THEN 'unknown' WHEN k % 8 = 5 THEN NULL ELSE 'reporting' END"
DIGEST = "CASE WHEN k % 6 = 0 THEN 'abc' WHEN k % 6 = 1 THEN NULL ELSE SHA(CAST(k AS VARCHAR(20))) END"
NODE_ID = "CASE WHEN k % 5 = 0 THEN 'N-1' ELSE 'N-' || left(SHA(CAST(k AS VARCHAR(20))), 24) END"
POLICY = "CASE WHEN k % 4 = 0 THEN 'auto-fix' WHEN k % 4 = 1 THEN 'manual-review' WHEN k % 4 = 2 THEN 'audit-only' ELSE 'never' END"
DECISION = "CASE WHEN k % 5 = 0 THEN 'pending' WHEN k % 5 = 1 THEN 'approved' WHEN k % 5 = 2 THEN 'rejected' WHEN k % 5 = 3 THEN 'modified' ELSE 'other' END"
OPEN = "CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 - 1 END"

#: By pack: the columns of the entity.
ENTITIES: dict[str, dict[str, str]] = {
    "stage_result": {
        "run_id": "CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN 'r 1' ELSE 'r' || k END", "result_id": "CASE WHEN k % 7 > 0 THEN 'x' || k END", "stage": STAGE, "idempotency_key": "o_orderpriority",
        "status": "CASE WHEN k % 5 = 0 THEN 'done' WHEN k % 5 = 1 THEN 'blocked' WHEN k % 5 = 2 THEN 'odd' ELSE 'failed' END", "next_kind": "CASE WHEN k % 6 = 0 THEN 'run_skill' WHEN k % 6 = 1 THEN 'retry' WHEN k % 6 = 2 THEN 'jump' ELSE 'stop' END",
        "order_no": "k % 4", "attempt": "k % 3", "error_code": "CASE WHEN k % 2 = 0 THEN 'e' END", "gate_passed": "k % 4 > 1", "next_stage": "CASE WHEN k % 12 > 3 THEN 'review' END", "retry_of": "CASE WHEN k % 5 > 1 THEN 'y' END",
    },
    "run_state": {
        "run_id": "'r' || k", "mode": "CASE WHEN k % 10 > 0 THEN 'full' END", "stage": STAGE, "status": "CASE WHEN k % 4 = 0 THEN 'wip' WHEN k % 4 = 1 THEN 'ready' ELSE 'done' END", "chain_head": DIGEST,
        "final_acceptance_path": "CASE WHEN k % 3 = 0 THEN 'a/b' END", "applied_result_id": "CASE WHEN k % 4 > 0 THEN k END", "last_result_id": "CASE WHEN k % 7 = 0 THEN k + 1 WHEN k % 7 = 1 THEN NULL ELSE k END",
    },
    "rule_draft": {
        "rule_id": "'x' || k", "role": "CASE WHEN k % 8 > 0 THEN o_orderpriority END", "write_strategy": "CASE WHEN k % 3 = 0 THEN 'audit-only' WHEN k % 3 = 1 THEN 'direct' ELSE '' END", "confidence": "(k % 13) * 0.1",
        "requires_user_confirmation": "k % 2 = 0", "manual_confirmation_reason": "CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE 'low' END",
    },
    "audit_item": {
        "issue_id": "'i' || k", "element_id": "CASE WHEN k % 6 > 0 THEN 'p' END", "semantic_role": "o_orderpriority", "current_problem": "CASE WHEN k % 7 > 0 THEN 'size' ELSE '' END", "action_type": "'set'", "confidence": "CASE WHEN k % 9 > 0 THEN (k % 12) * 0.1 END",
        "auto_fix_policy": POLICY, "risk_level": "CASE WHEN k % 3 = 0 THEN 'low' WHEN k % 3 = 1 THEN 'high' ELSE 'huge' END", "evidence": "CASE WHEN k % 4 = 0 THEN array() WHEN k % 4 = 1 THEN NULL ELSE array('e') END", "expected_role": "CASE WHEN k % 5 > 0 THEN 'title' END",
    },
    "review_item": {
        "review_id": "'v' || k", "proposal_id": "CASE WHEN k % 8 > 0 THEN 'p' END", "category": "o_orderstatus", "problem": "'x'", "confidence": "(k % 11) * 0.1", "decision_status": DECISION, "source_refs": "CASE WHEN k % 3 = 0 THEN array() ELSE array('a') END",
        "blocking": "k % 2 = 0", "allows_continue": "k % 3 > 0", "decided_by": "CASE WHEN k % 4 > 0 THEN 'u' END", "decided_at": "CASE WHEN k % 9 > 0 THEN 't' END",
        "selected_action": "CASE WHEN k % 3 > 0 THEN '{\"a\":1,\"b\":' || k || '}' END", "selected_action_sha256": "CASE WHEN k % 2 = 0 THEN SHA('{\"a\":1,\"b\":' || k || '}') ELSE SHA('x') END",
    },
    "plan": {
        "run_id": "'r' || k", "plan_id": "CASE WHEN k % 9 > 0 THEN 'p' END", "plan_state": "CASE WHEN k % 3 = 0 THEN 'draft' WHEN k % 3 = 1 THEN 'finalized' ELSE 'closed' END", "backend": "'cli'", "backend_version": "CASE WHEN k % 10 > 0 THEN '1.2.3' ELSE '' END", "plan_revision": "k % 4",
        "snapshot_sha256": DIGEST, "capability_sha256": "SHA(o_orderpriority)", "finalized_from_plan_id": "CASE WHEN k % 2 = 0 THEN 'q' END", "finalized_at": "CASE WHEN k % 8 > 2 THEN 't' END", "pending_count": OPEN, "blocking_count": "CASE WHEN k % 7 > 0 THEN 0 ELSE 1 END",
    },
    "action": {
        "action_id": "'a' || k", "action_type": "o_orderstatus", "command": "CASE WHEN k % 6 = 0 THEN 'set' WHEN k % 6 = 1 THEN 'raw-set' WHEN k % 6 = 2 THEN 'paint' ELSE 'move' END", "target_path": "CASE WHEN k % 7 > 0 THEN '/body' END",
        "risk_class": "CASE WHEN k % 4 = 0 THEN 'L1' WHEN k % 4 = 1 THEN 'L3_WRITE' WHEN k % 4 = 2 THEN 'L4' ELSE 'L2' END", "auto_fix_policy": POLICY, "target_node_id": NODE_ID, "decision_status": DECISION, "expected_match_count": "k % 3", "xml": "'<a>' || k || '</a>'",
        "xml_sha256": "CASE WHEN k % 2 = 0 THEN SHA('<a>') ELSE SHA('<a>' || k || '</a>') END",
    },
    "request": {
        "plan_state": "CASE WHEN k % 3 = 0 THEN 'draft' ELSE 'finalized' END", "run_id": "'r' || k % 10", "plan_run_id": "'r' || k % 5", "plan_revision": "k % 4", "request_revision": "k % 8", "snapshot_sha256": DIGEST, "request_snapshot_sha256": "SHA(CAST(k AS VARCHAR(20)))",
        "capability_sha256": "o_orderpriority", "request_capability_sha256": "CASE WHEN k % 11 > 0 THEN o_orderpriority END", "n_operations": "k % 15", "has_heavy": "k % 5 = 0",
    },
    "artifact": {
        "run_id": "'r'", "artifact_id": "CASE WHEN k % 5 > 0 THEN 'a' || k END", "kind": "o_orderpriority", "sha256": DIGEST, "size_bytes": "k % 4 - 1",
        "path": "CASE WHEN k % 6 = 0 THEN '/abs' WHEN k % 6 = 1 THEN 'C:/x' WHEN k % 6 = 2 THEN 'a/../b' WHEN k % 6 = 3 THEN '' WHEN k % 6 = 4 THEN 'a..b/c' ELSE 'ok/' || k END",
    },
    "toc": {
        "toc_mode": "CASE WHEN k % 4 = 0 THEN 'not_required' WHEN k % 4 = 1 THEN 'refreshed' WHEN k % 4 = 2 THEN 'manual' ELSE 'skipped' END", "toc_required": "k % 8 = 0", "refresh_attempted": "k % 3 > 0", "refresh_succeeded": "k % 5 > 0", "placeholder_removed": "k % 7 > 0",
        "field_count": "k % 6", "visible_count": "CASE WHEN k % 9 > 0 THEN k % 11 END", "reason": "CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 > 2 THEN 'offline' END",
    },
    "acceptance": {
        "run_id": "'r' || k", "status": "CASE WHEN k % 6 > 0 THEN 'done' END", "acceptance_type": "CASE WHEN k % 5 = 0 THEN 'accepted' WHEN k % 5 = 1 THEN 'accepted_with_warnings' WHEN k % 5 = 2 THEN 'blocked' WHEN k % 5 = 3 THEN 'rejected' ELSE 'open' END",
        "blocking_categories": "CASE WHEN k % 3 = 0 THEN array() WHEN k % 3 = 1 THEN NULL ELSE array('c') END", "n_warnings": "k % 2", "pending_count": OPEN,
    },
    "node": {
        "doc_id": "o_custkey", "path": "CASE WHEN k % 6 > 0 THEN '/p' ELSE '' END", "node_type": "o_orderstatus", "node_id": NODE_ID, "ordinal": "k % 5 - 1", "selector_kind": "CASE WHEN k % 2 = 0 THEN 'positional' ELSE 'native_id' END", "rebindable": "k % 3 = 0", "content_fingerprint": DIGEST,
    },
    "execution_log": {
        "status": "CASE WHEN k % 6 = 0 THEN 'executed_ready' WHEN k % 6 = 1 THEN 'execution_failed_final' WHEN k % 6 = 2 THEN 'execution_failed_retryable' WHEN k % 6 = 3 THEN 'lost' ELSE 'review_ready' END", "attempt_no": "k % 3", "after_ref": "CASE WHEN k % 4 > 0 THEN 'a' END", "n_failed": "k % 5",
        "retry_reason": "CASE WHEN k % 7 > 2 THEN 'busy' END", "resume_allowed": "k % 4 = 0",
    },
    "resolver_reason": {"message": "CASE WHEN k % 5 > 0 THEN o_orderpriority ELSE '' END", "source": "CASE WHEN k % 7 > 0 THEN 's' END", "reason_code": "CASE WHEN k % 4 = 0 THEN 'USER_CONFIRMED' WHEN k % 4 = 1 THEN 'LOW_CONFIDENCE' WHEN k % 4 = 2 THEN 'GUESS' END"},
    "source": {
        "source_artifact_id": "CASE WHEN k % 5 > 0 THEN 'a' || k END", "snapshot_source_artifact_id": "CASE WHEN k % 10 > 0 THEN 'a' || k END", "source_sha256": DIGEST, "snapshot_source_sha256": "SHA(CAST(k AS VARCHAR(20)))",
        "source_size_bytes": "o_custkey", "snapshot_source_size_bytes": "CASE WHEN k % 3 > 0 THEN o_custkey ELSE o_custkey + 1 END",
    },
    "legacy_log": {
        "run_id": "'r' || k", "plan_path": "CASE WHEN k % 4 > 0 THEN 'p' END", "plan_sha256": DIGEST, "document_path": "'d'", "document_sha256": "CASE WHEN k % 9 > 0 THEN 'h' ELSE '' END", "schema_id": "CASE WHEN k % 3 > 0 THEN 'repair-execution-log' ELSE 'log' END",
        "contract_version": "CASE WHEN k % 5 > 0 THEN 'legacy' END", "plan_size_bytes": "k % 4", "document_size_bytes": "CASE WHEN k % 6 > 0 THEN k % 5 - 1 END",
    },
    "legacy_action": {"action_id": "CASE WHEN k % 5 > 0 THEN 'a' || k END", "status": "CASE WHEN k % 6 = 0 THEN 'blocked' WHEN k % 6 = 1 THEN NULL WHEN k % 6 = 2 THEN 'failed' ELSE 'executed' END"},
    "legacy_check": {
        "check_id": "'c' || k", "action_id": "CASE WHEN k % 8 > 0 THEN 'a' END", "check_type": "CASE WHEN k % 3 = 0 THEN 'snapshot_diff' WHEN k % 3 = 1 THEN 'manual' END", "status": "CASE WHEN k % 4 = 0 THEN 'failed' WHEN k % 4 = 1 THEN 'odd' ELSE 'passed' END",
        "review_status": "CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 5 = 1 THEN 'open' ELSE 'passed' END", "gate_status": "CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'passed' END", "source_action_status": "CASE WHEN k % 6 = 0 THEN 'blocked' ELSE 'ready' END",
        "source_execution_status": "CASE WHEN k % 7 = 0 THEN 'executed' WHEN k % 7 = 1 THEN 'rejected' WHEN k % 7 = 2 THEN NULL ELSE 'skipped' END", "blocking": "k % 3 = 0",
    },
    "reporting": {
        "run_id": "'r' || k", "report_path": "CASE WHEN k % 6 > 0 THEN 'a/b' END", "acceptance_sha256": DIGEST, "accepted_sha256": "SHA(CAST(k AS VARCHAR(20)))", "acceptance_fields": "CASE WHEN k % 3 = 0 THEN array('run_id', 'reported_at') ELSE array('run_id') END", "report_exists": "CASE WHEN k % 4 > 0 THEN k % 5 > 0 END",
    },
}


def _query(pack: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        columns = [F.expr(_spark(e)).alias(c) for c, e in ENTITIES[pack].items()]
        entities = table(spark, folder, "orders").withColumn("k", F.col(K)).select(F.col(K).alias("entity"), *columns)
        found = rules.violations(entities, pack, "entity", rulepacks.PACKS[pack])
        return found.groupBy("code", "field").agg(F.count("*").alias("n"), F.min(F.col("entity_id").cast("long")).alias("first"))

    run.__doc__ = f"Broken rules of the pack {pack}, by code and field."
    return run


def _spark(expression: str) -> str:
    """SHA(x) is sha2(x, 256)."""
    out, at = "", 0
    while (i := expression.find("SHA(", at)) >= 0:
        depth, j = 1, i + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(expression[j], 0)
            j += 1
        out += expression[at:i] + "sha2(" + expression[i + 4 : j - 1] + ", 256)"
        at = j
    return out + expression[at:]


def _missing(*fields: str) -> list[tuple[str, str, str]]:
    return [("field_missing", f, f"{f} IS NOT NULL AND {f}::VARCHAR <> ''") for f in fields]


_HASH = "regexp_full_match({}, '[0-9a-f]{{64}}')"
_NODE = ("node_id_pattern", "regexp_full_match({}, 'N-[0-9a-f]{{24}}')")
_POLICIES = "('auto-fix', 'manual-review', 'audit-only')"
_STAGES = "('init', 'rule_selection', 'fact_extraction', 'semantic_strategy', 'rule_packaging', 'format_audit', 'repair_planning', 'manual_review', 'repair_execution', 'after_snapshot', 'review', 'toc_acceptance', 'final_acceptance', 'reporting', 'completed')"
#: By pack: code, field, and what must hold, in DuckDB's SQL.
HOLDS: dict[str, list[tuple[str, str, str]]] = {
    "stage_result": [
        *_missing("run_id", "result_id", "stage", "idempotency_key"), ("name_pattern", "run_id", "regexp_full_match(run_id, '[A-Za-z0-9_-]{1,80}')"), ("value_unknown", "status", "status IN ('done', 'blocked', 'waiting_user', 'synthetic_failure', 'failed')"),
        ("stage_unknown", "stage", f"stage IN {_STAGES}"), ("value_unknown", "next_kind", "next_kind IN ('run_skill', 'wait_user', 'retry', 'manual_recover', 'finalize', 'stop')"), ("number_positive", "order_no", "order_no > 0"), ("number_positive", "attempt", "attempt > 0"),
        ("error_code_required", "error_code", "status NOT IN ('blocked', 'failed', 'synthetic_failure') OR error_code IS NOT NULL"), ("gate_and_status_differ", "gate_passed", "status <> 'done' OR gate_passed"),
        ("next_stage_required", "next_stage", "next_kind <> 'run_skill' OR next_stage IS NOT NULL"), ("retry_target_required", "retry_of", "next_kind <> 'retry' OR retry_of IS NOT NULL"),
    ],
    "run_state": [
        *_missing("run_id", "mode", "stage", "status"), ("stage_unknown", "stage", f"stage IN {_STAGES}"), ("value_unknown", "status", "status IN ('wip', 'blocked', 'waiting_user', 'done')"), ("chain_head_pattern", "chain_head", f"chain_head IS NULL OR {_HASH.format('chain_head')}"),
        ("too_early", "final_acceptance_path", "coalesce(stage IN ('final_acceptance', 'reporting', 'completed'), true) OR final_acceptance_path IS NULL"), ("applied_differs", "applied_result_id", "applied_result_id IS NULL OR applied_result_id = last_result_id"),
    ],
    "rule_draft": [
        *_missing("rule_id", "role", "write_strategy"), ("value_range", "confidence", "confidence >= 0 AND confidence <= 1"), ("confirmation_required", "requires_user_confirmation", "(confidence >= 0.85 AND write_strategy <> 'audit-only') OR requires_user_confirmation"),
        ("confirmation_reason", "manual_confirmation_reason", "NOT requires_user_confirmation OR coalesce(manual_confirmation_reason, '') <> ''"),
    ],
    "audit_item": [
        *_missing("issue_id", "element_id", "semantic_role", "current_problem", "action_type"), ("value_range", "confidence", "confidence >= 0 AND confidence <= 1"), ("value_unknown", "auto_fix_policy", f"auto_fix_policy IN {_POLICIES}"), ("value_unknown", "risk_level", "risk_level IN ('low', 'medium', 'high')"),
        ("evidence_empty", "evidence", "len(evidence) > 0"), ("role_unresolved", "auto_fix_policy", "expected_role IS NOT NULL OR auto_fix_policy <> 'auto-fix'"),
    ],
    "review_item": [
        *_missing("review_id", "proposal_id", "category", "problem"), ("value_range", "confidence", "confidence >= 0 AND confidence <= 1"), ("value_unknown", "decision_status", "decision_status IN ('pending', 'approved', 'rejected', 'modified')"), ("refs_empty", "source_refs", "len(source_refs) > 0"),
        ("pending_blocks", "allows_continue", "NOT blocking OR decision_status <> 'pending' OR NOT allows_continue"), ("decided_by_missing", "decided_by", "decision_status = 'pending' OR (decided_by IS NOT NULL AND decided_at IS NOT NULL)"),
        ("action_required", "selected_action", "decision_status NOT IN ('approved', 'modified') OR selected_action IS NOT NULL"), ("action_forbidden", "selected_action", "decision_status NOT IN ('pending', 'rejected') OR selected_action IS NULL"),
        ("action_hash", "selected_action_sha256", "selected_action IS NULL OR selected_action_sha256 = sha256(selected_action)"),
    ],
    "plan": [
        *_missing("run_id", "plan_id", "plan_state", "backend", "backend_version"), ("value_unknown", "plan_state", "plan_state IN ('draft', 'finalized')"), ("revision_positive", "plan_revision", "plan_revision > 0"), ("hash_pattern", "snapshot_sha256", _HASH.format("snapshot_sha256")),
        ("hash_pattern", "capability_sha256", _HASH.format("capability_sha256")), ("finalized_from_missing", "finalized_from_plan_id", "plan_state <> 'finalized' OR (finalized_from_plan_id IS NOT NULL AND finalized_at IS NOT NULL)"),
        ("draft_has_finalization", "finalized_from_plan_id", "plan_state <> 'draft' OR finalized_from_plan_id IS NULL"), ("open_reviews", "blocking_count", "plan_state <> 'finalized' OR coalesce(pending_count, 0) + coalesce(blocking_count, 0) = 0"),
    ],
    "action": [
        *_missing("action_id", "action_type", "command", "target_path"), ("value_unknown", "command", "command IN ('set', 'add', 'remove', 'move', 'swap', 'raw-set')"), ("value_unknown", "risk_class", "risk_class IN ('L1', 'L2', 'L3_WRITE')"), ("value_unknown", "auto_fix_policy", f"auto_fix_policy IN {_POLICIES}"),
        (_NODE[0], "target_node_id", _NODE[1].format("target_node_id")), ("raw_is_heavy", "risk_class", "command <> 'raw-set' OR risk_class = 'L3_WRITE'"), ("heavy_needs_decision", "decision_status", "risk_class <> 'L3_WRITE' OR decision_status = 'approved'"),
        ("raw_one_match", "expected_match_count", "command <> 'raw-set' OR expected_match_count = 1"), ("raw_payload_hash", "xml_sha256", "command <> 'raw-set' OR xml_sha256 = sha256(xml)"),
    ],
    "request": [
        ("plan_not_finalized", "plan_state", "plan_state = 'finalized'"), ("run_differs", "run_id", "run_id = plan_run_id"), ("revision_differs", "plan_revision", "plan_revision = request_revision"), ("snapshot_differs", "snapshot_sha256", "snapshot_sha256 = request_snapshot_sha256"),
        ("capability_differs", "capability_sha256", "capability_sha256 = request_capability_sha256"), ("batch_size", "n_operations", "n_operations >= 1 AND n_operations <= 12"), ("heavy_stands_alone", "n_operations", "NOT has_heavy OR n_operations = 1"),
    ],
    "artifact": [
        *_missing("run_id", "artifact_id", "kind", "path"), ("hash_pattern", "sha256", _HASH.format("sha256")), ("size_positive", "size_bytes", "size_bytes > 0"),
        ("path_unsafe", "path", r"path <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT list_contains(string_split(path, '/'), '..')"),
    ],
    "toc": [
        ("value_unknown", "toc_mode", "toc_mode IN ('not_required', 'refreshed', 'manual')"), ("not_required_but_tried", "refresh_attempted", "toc_mode <> 'not_required' OR NOT (toc_required OR refresh_attempted)"),
        ("refresh_failed", "refresh_succeeded", "toc_mode <> 'refreshed' OR (refresh_attempted AND refresh_succeeded AND placeholder_removed AND least(field_count, coalesce(visible_count, 0)) > 0)"), ("manual_without_reason", "reason", "toc_mode <> 'manual' OR coalesce(reason, '') <> ''"),
    ],
    "acceptance": [
        *_missing("run_id", "acceptance_type", "status"), ("value_unknown", "acceptance_type", "acceptance_type IN ('accepted', 'accepted_with_warnings', 'blocked', 'rejected')"), ("accepted_with_blockers", "blocking_categories", "NOT starts_with(acceptance_type, 'accepted') OR coalesce(len(blocking_categories), 0) = 0"),
        ("blocked_without_reason", "blocking_categories", "acceptance_type <> 'blocked' OR len(blocking_categories) > 0"), ("warnings_needed", "n_warnings", "acceptance_type <> 'accepted_with_warnings' OR n_warnings > 0"), ("open_reviews", "pending_count", "NOT starts_with(acceptance_type, 'accepted') OR pending_count = 0"),
    ],
    "node": [
        *_missing("doc_id", "path", "node_type"), (_NODE[0], "node_id", _NODE[1].format("node_id")), ("ordinal_negative", "ordinal", "ordinal >= 0"), ("positional_rebindable", "rebindable", "selector_kind <> 'positional' OR NOT rebindable"), ("hash_pattern", "content_fingerprint", _HASH.format("content_fingerprint")),
    ],
    "execution_log": [
        ("value_unknown", "status", "status IN ('preflight_pending', 'snapshot_ready', 'plan_finalized', 'execution_in_progress', 'execution_failed_retryable', 'execution_failed_final', 'executed_ready', 'blocked_waiting_native_toc', 'toc_refresh_in_progress', 'toc_refresh_failed_final', 'review_ready', 'accepted', 'blocked')"),
        ("retry_reason", "retry_reason", "status <> 'execution_failed_retryable' OR retry_reason IS NOT NULL"), ("resume_forbidden", "resume_allowed", "NOT resume_allowed OR status IN ('execution_in_progress', 'execution_failed_retryable', 'executed_ready')"), ("attempt_positive", "attempt_no", "attempt_no > 0"),
        ("done_without_after", "after_ref", "status NOT IN ('executed_ready', 'review_ready', 'accepted') OR (after_ref IS NOT NULL AND n_failed = 0)"), ("failed_without_ids", "n_failed", "status <> 'execution_failed_final' OR n_failed > 0"),
    ],
    "resolver_reason": [
        *_missing("message", "source"), ("reason_unknown", "reason_code", "reason_code IN ('ROLEMAP_CONSISTENT', 'ROLEMAP_CONFLICT_WARNING', 'ROLEMAP_CONFLICT_BLOCKED', 'LEGACY_ROLE_DIAGNOSTIC', 'STRUCTURE_RULE_USED', 'STRUCTURE_RULE_WARNING', 'STRUCTURE_RULE_BLOCKED', 'USER_CONFIRMED', 'UNRESOLVED_MAPPING', 'LOW_CONFIDENCE', 'MULTI_ROLE_CONFLICT')"),
    ],
    "source": [("source_differs", f, f"{f} IS NOT DISTINCT FROM snapshot_{f}") for f in ("source_artifact_id", "source_sha256", "source_size_bytes")],
    "legacy_log": [
        *_missing("run_id", "plan_path", "plan_sha256", "document_path", "document_sha256"), ("value_unknown", "schema_id", "schema_id = 'repair-execution-log'"), ("value_unknown", "contract_version", "contract_version = 'legacy'"),
        ("size_positive", "plan_size_bytes", "plan_size_bytes > 0"), ("size_positive", "document_size_bytes", "document_size_bytes > 0"),
    ],
    "legacy_action": [*_missing("action_id"), ("value_unknown", "status", "status IN ('executed', 'skipped', 'rejected', 'failed')")],
    "legacy_check": [
        *_missing("check_id", "action_id", "check_type"), ("value_unknown", "status", "status IN ('passed', 'failed', 'skipped', 'not_applicable')"), ("value_unknown", "review_status", "review_status IN ('passed', 'passed_with_warnings', 'failed')"),
        ("blocked_but_executed", "source_execution_status", "source_action_status <> 'blocked' OR coalesce(source_execution_status, 'rejected') = 'rejected'"), ("executed_unchecked", "check_type", "coalesce(source_execution_status, '') <> 'executed' OR check_type IN ('after_value_match', 'snapshot_diff')"),
        ("failed_but_passed", "review_status", "NOT blocking OR status <> 'failed' OR (review_status = 'failed' AND gate_status = 'failed')"),
    ],
    "reporting": [
        *_missing("run_id", "report_path", "acceptance_sha256"), ("acceptance_changed", "acceptance_sha256", "acceptance_sha256 = accepted_sha256"), ("fields_leaked", "acceptance_fields", "NOT list_has_any(acceptance_fields, ['report_path', 'report_sha256', 'reported_at'])"), ("report_missing", "report_exists", "report_exists"),
    ],
}


def _oracle(pack: str) -> str:
    columns = ", ".join(f"{e.replace('SHA(', 'sha256(').replace('array(', 'list_value(')} AS {c}" for c, e in ENTITIES[pack].items())
    broken = " UNION ALL ".join(f"SELECT entity, '{code}' AS code, '{field}' AS field FROM e WHERE NOT coalesce({holds}, false)" for code, field, holds in HOLDS[pack])
    return f"WITH o AS (SELECT *, {K} AS k FROM orders), e AS (SELECT k AS entity, {columns} FROM o), b AS ({broken}) SELECT code, field, count(*) AS n, min(entity) AS first FROM b GROUP BY ALL"


QUERIES = {f"q30_pack_{pack}": _query(pack) for pack in ENTITIES}
ORACLE_SQL = {f"q30_pack_{pack}": _oracle(pack) for pack in ENTITIES}
