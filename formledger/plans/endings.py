"""States with their next actions, and acceptances with their files: an order is a run, its lines are results and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import acceptance, ledger, nextaction
from ..sources.tables import settled, table

DEALT = 50_000  #: orders that a task turns into states or acceptances
# SQL that Spark and DuckDB both run; {{ and }} are braces of JSON.
STATES = """
SELECT o_orderkey AS run_id, '{{"stage":"' || CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'review' WHEN '2' THEN 'reporting' WHEN '3' THEN 'init' WHEN '4' THEN 'final_acceptance' ELSE 'unheard' END
  || '","status":"' || CASE o_orderstatus WHEN 'F' THEN 'accepted' ELSE 'wip' END || '","final_acceptance_path":' || CASE WHEN o_totalprice > 250000 THEN '"f.json"' ELSE 'null' END
  || CASE WHEN o_totalprice > 400000 THEN ',"reporting_result_path":"r.json"' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN ',"applied_result_id":"R1"' ELSE '' END
  || ',"next_action":{{"kind":"' || CASE o_custkey % 5 WHEN 0 THEN 'run_skill' WHEN 1 THEN 'retry' WHEN 2 THEN 'manual_recover' WHEN 3 THEN 'wait_user' ELSE 'jump' END || '"'
  || CASE WHEN o_custkey % 7 > 0 THEN ',"stage":"review","skill_name":"s","target_result_id":"R' || CAST(o_custkey % 8 AS VARCHAR(9)) || '","target_error_code":"E' || o_orderstatus || '"' ELSE '' END
  || CASE WHEN o_custkey % 11 > 0 THEN ',"resume_from_stage":"final_acceptance","idempotency_key":"k","planned_idempotency_key":"p","source_result_id":"R1"' ELSE '' END
  || CASE WHEN o_custkey % 13 = 0 THEN ',"override_reason":"x"' ELSE '' END || ',"required_inputs":["A1",{{"artifact_id":"A2","path":"' || CASE WHEN o_totalprice < 30000 THEN '../' ELSE '' END || 'p"}}]}}}}' AS state
FROM {orders}"""
RESULTS = """
SELECT DISTINCT l_orderkey AS run_id, 'R' || CAST(l_linenumber AS VARCHAR(9)) AS result_id, '{{"error":{{"code":"E' || l_linestatus || '"}},"blockers":[{{"code":"E' || CASE WHEN l_returnflag = 'R' THEN 'P' ELSE 'X' END || '"}}],'
  || '"next_action":{{"kind":"run_skill","skill_name":"s","stage":"review","resume_from_stage":"final_acceptance","target_result_id":"R3","target_error_code":"EO","planned_idempotency_key":"p","required_inputs":["A1",{{"path":"p","artifact_id":"A2"}}]}}}}' AS result
FROM {lineitem} WHERE l_linenumber > 1 OR l_quantity < 25"""
ARTIFACTS = "SELECT DISTINCT l_orderkey AS run_id, 'A' || CAST(l_suppkey % 5 AS VARCHAR(9)) AS artifact_id FROM {lineitem}"


def _made(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    known = {t: table(spark, folder, t) for t in ("orders", "lineitem")}
    # a table of one file can be one task's: orders are dealt before they become JSON texts, which take most of the time
    known["orders"] = known["orders"].repartition(max(spark.sparkContext.defaultParallelism, -(-known["orders"].count() // DEALT)), "o_orderkey")
    return spark.sql(sql, **{t: df for t, df in known.items() if "{%s}" % t in sql})


def q47_next_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What contradicts stages, statuses, results and artifacts in the runs' states."""
    results = settled(_made(spark, folder, RESULTS), "results")  # two steps read them
    return nextaction.problems(_made(spark, folder, STATES), results, _made(spark, folder, ARTIFACTS))


#: An acceptance's fields by branch come from the order, its files are its lines.
ACCEPTANCES = """
SELECT o_orderkey AS run_id, '{{"schema_id":"final-acceptance","schema_version":"1","contract_version":"1","run_id":"r","acceptance_type":"'
  || CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'final_delivery' WHEN '2' THEN 'audit_only_terminal' WHEN '3' THEN 'build_rules_terminal' WHEN '4' THEN 'blocked_terminal' ELSE 'unheard' END
  || '","status":"' || CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'blocked' ELSE 'accepted_with_warnings' END || '","skill_results":[],"evidence_manifest_path":"e","evidence_manifest_sha256":"e","evidence_manifest_size_bytes":1,"warnings":[],"evaluated_at":"t"'
  || ',"manual_review_summary":{{"pending_count":' || CAST(o_custkey % 2 AS VARCHAR(9)) || ',"blocking_count":0,"unresolved_manual_review_count":0,"high_risk_unconfirmed_count":0}}'
  || ',"blockers":' || CASE WHEN o_custkey % 3 = 0 THEN '["b"]' ELSE '[]' END || ',"blocking_categories":' || CASE o_custkey % 5 WHEN 0 THEN '["toc_failed"]' WHEN 1 THEN '["other"]' ELSE '[]' END
  || CASE WHEN o_custkey % 7 > 0 THEN ',"allowed_warning_categories":' || CASE WHEN o_custkey % 2 = 0 THEN '["non_blocking_warning"]' ELSE '{{}}' END ELSE '' END
  || CASE WHEN o_totalprice > 100000 THEN ',"final_docx_path":"output/a' || CASE WHEN o_totalprice > 300000 THEN '202401010000' ELSE '1' END || '.docx","final_docx_sha256":"h1","final_docx_size_bytes":1' ELSE '' END
  || ',"toc_acceptance_path":"f/2","toc_acceptance_sha256":"h2","toc_acceptance_size_bytes":2,"repair_execution_log_path":"f/../3","repair_execution_log_sha256":"h3","repair_plan_finalized_path":"f/4","repair_plan_finalized_sha256":"h4","repair_plan_finalized_size_bytes":4'
  || ',"original_docx_untouched":' || CASE WHEN o_custkey % 4 = 0 THEN 'true' ELSE 'false' END || ',"original_docx_proof":{{"initial_sha256":"a","current_sha256":"' || CASE WHEN o_custkey % 6 = 0 THEN 'b' ELSE 'a' END || '"}},"rule_ref_path":"f/5","rule_ref_sha256":"h5","package_manifest_path":"f/6"'
  || CASE WHEN o_custkey % 8 > 0 THEN ',"source_audit_refs":[{{"path":"f/1","sha256":"h1","size_bytes":1}},{{"path":"f/7","sha256":"h0"}}],"terminal_blocker_refs":["b"],"terminal_stage":"s","rule_package_status":"active"' ELSE '' END
  || ',"review_result_refs":' || CASE WHEN o_custkey % 9 = 0 THEN '[]' ELSE '[{{"path":"f/2","sha256":"h2","size_bytes":"2","status":"failed"}}]' END || '}}' AS acceptance
FROM {orders}"""
FILES = "SELECT DISTINCT l_orderkey AS run_id, 'f/' || CAST(l_linenumber AS VARCHAR(9)) AS path, 'h' || CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END AS VARCHAR(9)) AS sha256, CAST(l_linenumber AS BIGINT) + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS size_bytes FROM {lineitem} WHERE l_quantity < 30"


def q48_acceptances(spark: SparkSession, folder: str) -> DataFrame:
    """What each kind of ending lacks or may not have, and references without their file."""
    return acceptance.problems(_made(spark, folder, ACCEPTANCES), _made(spark, folder, FILES))


_NAMES = {"orders": "orders", "lineitem": "lineitem"}


def _next_oracle() -> str:
    rank = lambda x: "CASE " + " ".join(f"WHEN {x} = '{s}' THEN {i}" for i, s in enumerate(ledger.STAGES)) + f" ELSE {ledger.UNKNOWN_STAGE} END"
    kinds = ", ".join(f"'{k}'" for k in nextaction.KINDS)
    required = "\n".join(f"UNION ALL SELECT run_id, 'next_action.{f}', 'required' FROM s WHERE NOT list_contains(json_keys(n), '{f}')" for f in nextaction.FIELDS)
    blank = lambda c: f"({c} IS NULL OR {c} = '')"
    empty = [(f, "kind = 'run_skill'") for f in ("stage", "skill_name")] + [(f, "kind IN ('run_skill', 'retry', 'manual_recover')") for f in ("idempotency_key", "planned_idempotency_key")] + [("resume_from_stage", "again")]
    empties = "\n".join(f"UNION ALL SELECT run_id, 'next_action.{f}', 'empty' FROM s WHERE {where} AND {blank(f'n->>{chr(39)}$.{f}{chr(39)}')}" for f, where in empty)
    same = " OR ".join(f"(n->'$.{f}')::VARCHAR IS DISTINCT FROM (result->'$.next_action.{f}')::VARCHAR" for f in nextaction.COPIED if f != "required_inputs")
    return f"""
    WITH a AS ({STATES.format(**_NAMES)}), results AS ({RESULTS.format(**_NAMES)}), artifacts AS ({ARTIFACTS.format(**_NAMES)}),
    b AS (SELECT run_id, state::JSON AS j, (state::JSON)->'$.next_action' AS n FROM a),
    s AS (SELECT *, n->>'$.kind' AS kind, coalesce(n->>'$.kind' IN ('retry', 'manual_recover'), false) AS again, {rank("j->>'$.stage'")} AS rank FROM b),
    e AS (SELECT run_id, result_id, (result::JSON)->>'$.error.code' AS code FROM results UNION SELECT run_id, result_id, (result::JSON)->>'$.blockers[0].code' FROM results),
    t AS (SELECT run_id, n->>'$.target_result_id' AS result_id, n->>'$.target_error_code' AS code FROM s WHERE again),
    c AS (SELECT s.*, result::JSON AS result FROM s JOIN results r ON r.run_id = s.run_id AND r.result_id = j->>'$.applied_result_id'),
    found AS (
      SELECT run_id, 'stage' AS field, 'unknown' AS code FROM s WHERE rank = {ledger.UNKNOWN_STAGE}
      UNION ALL SELECT run_id, 'final_acceptance_path', 'too_early' FROM s WHERE rank < {ledger.STAGES.index('final_acceptance')} AND j->>'$.final_acceptance_path' IS NOT NULL
      UNION ALL SELECT run_id, 'final_acceptance_path', 'required' FROM s WHERE j->>'$.status' = 'accepted' AND j->>'$.final_acceptance_path' IS NULL
      UNION ALL SELECT run_id, 'reporting_result_path', 'too_early' FROM s WHERE rank < {ledger.STAGES.index('reporting')} AND j->>'$.reporting_result_path' IS NOT NULL
      UNION ALL SELECT run_id, 'next_action.kind', 'unknown' FROM s WHERE kind NOT IN ({kinds})
      {required}
      {empties}
      UNION ALL SELECT run_id, 'next_action.target_result_id', 'empty' FROM s WHERE again AND {blank("n->>'$.target_result_id'")} AND {blank("n->>'$.target_error_code'")}
      UNION ALL SELECT run_id, 'next_action.resume_from_stage', 'too_late' FROM s WHERE again AND n->>'$.resume_from_stage' <> '' AND {rank("n->>'$.resume_from_stage'")} > rank
      UNION ALL SELECT run_id, 'next_action.source_result_id', 'value' FROM s WHERE j->>'$.applied_result_id' IS NOT NULL AND n->>'$.source_result_id' IS DISTINCT FROM j->>'$.applied_result_id'
      UNION ALL SELECT run_id, 'next_action.target_result_id', 'unresolved' FROM t ANTI JOIN results USING (run_id, result_id) WHERE result_id <> ''
      UNION ALL SELECT run_id, 'next_action.target_error_code', 'unresolved' FROM t SEMI JOIN results USING (run_id, result_id) WHERE code <> '' AND NOT EXISTS (FROM e WHERE e.run_id = t.run_id AND e.result_id = t.result_id AND e.code = t.code)
      UNION ALL SELECT run_id, 'next_action.target_error_code', 'unresolved' FROM t ANTI JOIN results USING (run_id, result_id) WHERE code <> '' AND NOT EXISTS (FROM e WHERE e.run_id = t.run_id AND e.code = t.code)
      UNION ALL SELECT run_id, 'required_inputs:' || artifact_id, 'unresolved' FROM (SELECT run_id, unnest(['A1', 'A2']) AS artifact_id FROM s) ANTI JOIN artifacts USING (run_id, artifact_id)
      UNION ALL SELECT run_id, 'required_inputs:../p', 'path' FROM s WHERE n->>'$.required_inputs[1].path' = '../p'
      UNION ALL SELECT run_id, 'next_action.planned_idempotency_key', 'not_copied' FROM c WHERE kind = 'run_skill' AND (n->'$.planned_idempotency_key')::VARCHAR IS DISTINCT FROM (result->'$.next_action.planned_idempotency_key')::VARCHAR
      UNION ALL SELECT run_id, 'next_action.override_reason', 'required' FROM c WHERE {blank("n->>'$.override_reason'")} AND ({same} OR n->>'$.required_inputs[1].path' <> 'p'))
    SELECT DISTINCT run_id, field, code FROM found
    """


def _acceptance_oracle() -> str:
    decisions = ", ".join("('%s', '%s', '%s', '%s')" % d for d in acceptance.DECISIONS)
    triples = " UNION ALL ".join(
        f"SELECT run_id, '{p}' AS field, j->>'$.{p}_path' AS path, j->>'$.{p}_sha256' AS sha256, j->>'$.{p}_size_bytes' AS size_bytes FROM d WHERE kind = '{b}'" for b, names in acceptance.FILES.items() for p in names
    )
    objects = " UNION ALL ".join(f"SELECT run_id, '{o}', j->>'$.{o}.path', j->>'$.{o}.sha256', j->>'$.{o}.size_bytes' FROM d WHERE kind = '{b}'" for b, names in acceptance.OBJECTS.items() for o in names)
    lists = " UNION ALL ".join(
        f"SELECT run_id, '{name}[' || i || ']', j->>('$.{name}[' || i || '].path'), j->>('$.{name}[' || i || '].sha256'), j->>('$.{name}[' || i || '].size_bytes') FROM d, range(0, 2) AS r(i) WHERE kind = '{b}' AND i < coalesce(json_array_length(j, '$.{name}'), 0)" for b, name in acceptance.LISTS.items()
    )
    blank = "(value IS NULL OR value IN ('[]', '{}', ''))"
    return f"""
    WITH a AS ({ACCEPTANCES.format(**_NAMES)}), files AS ({FILES.format(**_NAMES)}),
    d AS (SELECT run_id, acceptance::JSON AS j, (acceptance::JSON)->>'$.acceptance_type' AS kind, (acceptance::JSON)->>'$.status' AS status FROM a),
    t(branch, field, need, argument) AS (VALUES {decisions}),
    x AS (SELECT run_id, field, need, argument, j->>('$.' || field) AS value, list_contains(json_keys(j), field) AS here FROM d JOIN t ON branch = '*' OR branch = kind OR (branch = 'not_final' AND kind IN ('audit_only_terminal', 'build_rules_terminal', 'blocked_terminal'))),
    y AS (SELECT run_id, field, CASE WHEN need = 'present' AND NOT here THEN 'required' WHEN need = 'array' AND here AND coalesce(value[1], '') <> '[' THEN 'array' WHEN need = 'absent' AND here THEN 'not_allowed' WHEN need = 'empty' AND NOT {blank} THEN 'not_allowed'
      WHEN need = 'filled' AND {blank} THEN 'empty' WHEN need = 'equal' AND value IS DISTINCT FROM argument THEN 'value' WHEN need = 'like' AND value IS NOT NULL AND NOT regexp_matches(value, argument) THEN 'pattern' END AS code FROM x),
    refs AS ({triples} UNION ALL {objects} UNION ALL {lists}),
    z AS (SELECT refs.run_id, field, CASE WHEN refs.path IS NULL THEN 'path_required' WHEN refs.path LIKE '%..%' THEN 'path_unsafe' WHEN f.path IS NULL THEN 'file_missing' WHEN refs.sha256 IS DISTINCT FROM f.sha256 THEN 'file_hash' WHEN refs.size_bytes <> f.size_bytes::VARCHAR THEN 'file_size' END AS code
      FROM refs LEFT JOIN files f ON f.run_id = refs.run_id AND f.path = refs.path),
    w AS (
      SELECT run_id, 'acceptance_type' AS field, 'value' AS code FROM d WHERE kind = 'unheard'
      UNION ALL SELECT run_id, 'blockers', 'not_blocked' FROM d WHERE j->>'$.blockers' <> '[]' AND status <> 'blocked'
      UNION ALL SELECT run_id, 'blocking_categories', 'accepted' FROM d WHERE status = 'accepted' AND j->>'$.blocking_categories' <> '[]'
      UNION ALL SELECT run_id, 'allowed_warning_categories', 'empty' FROM d WHERE status = 'accepted_with_warnings' AND coalesce(j->>'$.allowed_warning_categories', '[]') IN ('[]', '{{}}')
      UNION ALL SELECT run_id, 'blocking_categories', 'unknown' FROM d WHERE j->>'$.blocking_categories' = '["other"]'
      UNION ALL SELECT run_id, 'original_docx_proof', 'changed' FROM d WHERE kind = 'final_delivery' AND j->>'$.original_docx_proof.current_sha256' = 'b'
      UNION ALL SELECT run_id, 'review_result_refs', 'failed_not_blocked' FROM d WHERE kind = 'final_delivery' AND j->>'$.review_result_refs[0].status' = 'failed' AND status <> 'blocked')
    SELECT DISTINCT run_id, field, code FROM (SELECT * FROM y UNION ALL SELECT * FROM z UNION ALL SELECT * FROM w) WHERE code IS NOT NULL
    """


QUERIES = {"q47_next_actions": q47_next_actions, "q48_acceptances": q48_acceptances}
ORACLE_SQL = {"q47_next_actions": _next_oracle(), "q48_acceptances": _acceptance_oracle()}
