"""Rule packs of the entities: what must hold for each row, as data.

Each pack is for a table with one row for each entity and its fields as columns (``with_columns`` adds absent ones as nulls, so
older producers can be checked).  Conditions are SQL; null counts as broken, so optional fields say so themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import STAGES
from .rules import Rule

HASH = "rlike '^[0-9a-f]{64}$'"
NAME = "rlike '^[A-Za-z0-9_-]{1,80}$'"
SAFE = r"AND {0} NOT rlike '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)'"


def required(*fields: str) -> list[Rule]:
    return [Rule("field_missing", f, f"{f} IS NOT NULL AND CAST({f} AS STRING) <> ''") for f in fields]


def one_of(field: str, *values: str, code: str = "value_unknown") -> Rule:
    return Rule(code, field, f"{field} IN ({', '.join(repr(v) for v in values)})")


def between(field: str, low: float, high: float) -> Rule:
    return Rule("value_range", field, f"{field} BETWEEN {low} AND {high}")


def when(condition: str, then: str) -> str:
    """A condition that binds only where another one holds."""
    return f"NOT coalesce({condition}, false) OR ({then})"


POLICIES = ("auto-fix", "manual-review", "audit-only")
NEXT_KINDS = ("run_skill", "wait_user", "retry", "manual_recover", "finalize", "stop")

STAGE_RESULT = [
    *required("run_id", "result_id", "stage", "idempotency_key"),
    Rule("name_pattern", "run_id", f"run_id {NAME}"),
    one_of("status", "done", "blocked", "waiting_user", "synthetic_failure", "failed"),
    one_of("stage", *STAGES, code="stage_unknown"),
    one_of("next_kind", *NEXT_KINDS),
    Rule("number_positive", "order_no", "order_no > 0"),
    Rule("number_positive", "attempt", "attempt > 0"),
    Rule("error_code_required", "error_code", when("status IN ('blocked', 'failed', 'synthetic_failure')", "error_code IS NOT NULL")),
    Rule("gate_and_status_differ", "gate_passed", when("status = 'done'", "gate_passed")),
    Rule("next_stage_required", "next_stage", when("next_kind = 'run_skill'", "next_stage IS NOT NULL")),
    Rule("retry_target_required", "retry_of", when("next_kind = 'retry'", "retry_of IS NOT NULL")),
]
RUN_STATE = [
    *required("run_id", "mode", "stage", "status"),
    one_of("stage", *STAGES, code="stage_unknown"),
    one_of("status", "wip", "blocked", "waiting_user", "done"),
    Rule("chain_head_pattern", "chain_head", f"chain_head IS NULL OR chain_head {HASH}"),
    Rule("too_early", "final_acceptance_path", when(f"array_position(array({', '.join(repr(s) for s in STAGES)}), stage) < {STAGES.index('final_acceptance') + 1}", "final_acceptance_path IS NULL")),
    Rule("applied_differs", "applied_result_id", "applied_result_id IS NULL OR applied_result_id = last_result_id"),
]
RULE_DRAFT = [
    *required("rule_id", "role", "write_strategy"),
    between("confidence", 0, 1),
    Rule("confirmation_required", "requires_user_confirmation", when("confidence < 0.85 OR write_strategy = 'audit-only'", "requires_user_confirmation")),
    Rule("confirmation_reason", "manual_confirmation_reason", when("requires_user_confirmation", "manual_confirmation_reason IS NOT NULL AND manual_confirmation_reason <> ''")),
]
AUDIT_ITEM = [
    *required("issue_id", "element_id", "semantic_role", "current_problem", "action_type"),
    between("confidence", 0, 1),
    one_of("auto_fix_policy", *POLICIES),
    one_of("risk_level", "low", "medium", "high"),
    Rule("evidence_empty", "evidence", "size(evidence) > 0"),
    Rule("role_unresolved", "auto_fix_policy", when("expected_role IS NULL", "auto_fix_policy <> 'auto-fix'")),
]
REVIEW_ITEM = [
    *required("review_id", "proposal_id", "category", "problem"),
    between("confidence", 0, 1),
    one_of("decision_status", "pending", "approved", "rejected", "modified"),
    Rule("refs_empty", "source_refs", "size(source_refs) > 0"),
    Rule("pending_blocks", "allows_continue", when("blocking AND decision_status = 'pending'", "NOT allows_continue")),
    Rule("decided_by_missing", "decided_by", when("decision_status <> 'pending'", "decided_by IS NOT NULL AND decided_at IS NOT NULL")),
    Rule("action_required", "selected_action", when("decision_status IN ('approved', 'modified')", "selected_action IS NOT NULL")),
    Rule("action_forbidden", "selected_action", when("decision_status IN ('pending', 'rejected')", "selected_action IS NULL")),
    Rule("action_hash", "selected_action_sha256", when("selected_action IS NOT NULL", "selected_action_sha256 = sha2(to_json(parse_json(selected_action)), 256)")),
]
PLAN = [
    *required("run_id", "plan_id", "plan_state", "backend", "backend_version"),
    one_of("plan_state", "draft", "finalized"),
    Rule("revision_positive", "plan_revision", "plan_revision > 0"),
    Rule("hash_pattern", "snapshot_sha256", f"snapshot_sha256 {HASH}"),
    Rule("hash_pattern", "capability_sha256", f"capability_sha256 {HASH}"),
    Rule("finalized_from_missing", "finalized_from_plan_id", when("plan_state = 'finalized'", "finalized_from_plan_id IS NOT NULL AND finalized_at IS NOT NULL")),
    Rule("draft_has_finalization", "finalized_from_plan_id", when("plan_state = 'draft'", "finalized_from_plan_id IS NULL")),
    Rule("open_reviews", "blocking_count", when("plan_state = 'finalized'", "coalesce(pending_count, 0) = 0 AND coalesce(blocking_count, 0) = 0")),
]
ACTION = [
    *required("action_id", "action_type", "command", "target_path"),
    one_of("command", "set", "add", "remove", "move", "swap", "raw-set"),
    one_of("risk_class", "L1", "L2", "L3_WRITE"),
    one_of("auto_fix_policy", *POLICIES),
    Rule("node_id_pattern", "target_node_id", "target_node_id rlike '^N-[0-9a-f]{24}$'"),
    Rule("raw_is_heavy", "risk_class", when("command = 'raw-set'", "risk_class = 'L3_WRITE'")),
    Rule("heavy_needs_decision", "decision_status", when("risk_class = 'L3_WRITE'", "decision_status = 'approved'")),
    Rule("raw_one_match", "expected_match_count", when("command = 'raw-set'", "expected_match_count = 1")),
    Rule("raw_payload_hash", "xml_sha256", when("command = 'raw-set'", "xml_sha256 = sha2(xml, 256)")),
]
REQUEST = [
    Rule("plan_not_finalized", "plan_state", "plan_state = 'finalized'"),
    Rule("run_differs", "run_id", "run_id = plan_run_id"),
    Rule("revision_differs", "plan_revision", "plan_revision = request_revision"),
    Rule("snapshot_differs", "snapshot_sha256", "snapshot_sha256 = request_snapshot_sha256"),
    Rule("capability_differs", "capability_sha256", "capability_sha256 = request_capability_sha256"),
    Rule("batch_size", "n_operations", "n_operations BETWEEN 1 AND 12"),
    Rule("heavy_stands_alone", "n_operations", when("has_heavy", "n_operations = 1")),
]
ARTIFACT = [
    *required("run_id", "artifact_id", "kind", "path"),
    Rule("hash_pattern", "sha256", f"sha256 {HASH}"),
    Rule("size_positive", "size_bytes", "size_bytes > 0"),
    Rule("path_unsafe", "path", r"path <> '' AND NOT path rlike '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)'"),
]
TOC = [
    one_of("toc_mode", "not_required", "refreshed", "manual"),
    Rule("not_required_but_tried", "refresh_attempted", when("toc_mode = 'not_required'", "NOT toc_required AND NOT refresh_attempted")),
    Rule("refresh_failed", "refresh_succeeded", when("toc_mode = 'refreshed'", "refresh_attempted AND refresh_succeeded AND placeholder_removed AND field_count > 0 AND visible_count > 0")),
    Rule("manual_without_reason", "reason", when("toc_mode = 'manual'", "reason IS NOT NULL AND reason <> ''")),
]
ACCEPTANCE = [
    *required("run_id", "acceptance_type", "status"),
    one_of("acceptance_type", "accepted", "accepted_with_warnings", "blocked", "rejected"),
    Rule("accepted_with_blockers", "blocking_categories", when("acceptance_type LIKE 'accepted%'", "size(coalesce(blocking_categories, array())) = 0")),
    Rule("blocked_without_reason", "blocking_categories", when("acceptance_type = 'blocked'", "size(blocking_categories) > 0")),
    Rule("warnings_needed", "n_warnings", when("acceptance_type = 'accepted_with_warnings'", "n_warnings > 0")),
    Rule("open_reviews", "pending_count", when("acceptance_type LIKE 'accepted%'", "pending_count = 0")),
]
NODE = [
    *required("doc_id", "path", "node_type"),
    Rule("node_id_pattern", "node_id", "node_id rlike '^N-[0-9a-f]{24}$'"),
    Rule("ordinal_negative", "ordinal", "ordinal >= 0"),
    Rule("positional_rebindable", "rebindable", when("selector_kind = 'positional'", "NOT rebindable")),
    Rule("hash_pattern", "content_fingerprint", f"content_fingerprint {HASH}"),
]
#: The statuses of a run's execution.
RUN_STATUSES = ("preflight_pending", "snapshot_ready", "plan_finalized", "execution_in_progress", "execution_failed_retryable", "execution_failed_final", "executed_ready", "blocked_waiting_native_toc", "toc_refresh_in_progress", "toc_refresh_failed_final", "review_ready", "accepted", "blocked")
EXECUTION_LOG = [
    one_of("status", *RUN_STATUSES),
    Rule("retry_reason", "retry_reason", when("status = 'execution_failed_retryable'", "retry_reason IS NOT NULL")),
    Rule("resume_forbidden", "resume_allowed", when("resume_allowed", "status IN ('execution_in_progress', 'execution_failed_retryable', 'executed_ready')")),
    Rule("attempt_positive", "attempt_no", "attempt_no > 0"),
    Rule("done_without_after", "after_ref", when("status IN ('executed_ready', 'review_ready', 'accepted')", "after_ref IS NOT NULL AND n_failed = 0")),
    Rule("failed_without_ids", "n_failed", when("status = 'execution_failed_final'", "n_failed > 0")),
]
#: Why a resolver chose a role.
REASONS = ("ROLEMAP_CONSISTENT", "ROLEMAP_CONFLICT_WARNING", "ROLEMAP_CONFLICT_BLOCKED", "LEGACY_ROLE_DIAGNOSTIC", "STRUCTURE_RULE_USED", "STRUCTURE_RULE_WARNING", "STRUCTURE_RULE_BLOCKED", "USER_CONFIRMED", "UNRESOLVED_MAPPING", "LOW_CONFIDENCE", "MULTI_ROLE_CONFLICT")
RESOLVER_REASON = [
    *required("message", "source"),
    one_of("reason_code", *REASONS, code="reason_unknown"),
]
#: For rows of a product joined with the snapshot of its run (``snapshot_...``).
SOURCE_CONSISTENCY = [
    Rule("source_differs", f, f"{f} <=> snapshot_{f}") for f in ("source_artifact_id", "source_sha256", "source_size_bytes")
]
LEGACY_LOG = [
    *required("run_id", "plan_path", "plan_sha256", "document_path", "document_sha256"),
    one_of("schema_id", "repair-execution-log"),
    one_of("contract_version", "legacy"),
    Rule("size_positive", "plan_size_bytes", "plan_size_bytes > 0"),
    Rule("size_positive", "document_size_bytes", "document_size_bytes > 0"),
]
LEGACY_ACTION = [
    *required("action_id"),
    one_of("status", "executed", "skipped", "rejected", "failed"),
]
LEGACY_CHECK = [
    *required("check_id", "action_id", "check_type"),
    one_of("status", "passed", "failed", "skipped", "not_applicable"),
    one_of("review_status", "passed", "passed_with_warnings", "failed"),
    Rule("blocked_but_executed", "source_execution_status", when("source_action_status = 'blocked'", "source_execution_status IS NULL OR source_execution_status = 'rejected'")),
    Rule("executed_unchecked", "check_type", when("source_execution_status = 'executed'", "check_type IN ('after_value_match', 'snapshot_diff')")),
    Rule("failed_but_passed", "review_status", when("blocking AND status = 'failed'", "review_status = 'failed' AND gate_status = 'failed'")),
]
REPORTING = [
    *required("run_id", "report_path", "acceptance_sha256"),
    Rule("acceptance_changed", "acceptance_sha256", "acceptance_sha256 = accepted_sha256"),
    Rule("fields_leaked", "acceptance_fields", "NOT arrays_overlap(acceptance_fields, array('report_path', 'report_sha256', 'reported_at'))"),
    Rule("report_missing", "report_exists", "report_exists"),
]
PACKS = {
    "stage_result": STAGE_RESULT, "run_state": RUN_STATE, "rule_draft": RULE_DRAFT, "audit_item": AUDIT_ITEM, "review_item": REVIEW_ITEM, "plan": PLAN, "action": ACTION,
    "request": REQUEST, "artifact": ARTIFACT, "toc": TOC, "acceptance": ACCEPTANCE, "node": NODE, "execution_log": EXECUTION_LOG,
    "resolver_reason": RESOLVER_REASON, "source": SOURCE_CONSISTENCY, "legacy_log": LEGACY_LOG, "legacy_action": LEGACY_ACTION, "legacy_check": LEGACY_CHECK, "reporting": REPORTING,
}


def with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Add the columns that are absent as nulls of the given types."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c.lower() not in have})
