"""Acceptances by the decision table and next actions, each rule once."""

import json

from formledger.operators import acceptance, nextaction

SHA = {c: c * 64 for c in "abcdef"}
FILES = "run_id string, path string, sha256 string, size_bytes long, payload string"


def common(kind, **more):
    base = {f: "x" for f in acceptance.COMMON} | {f: [] for f in acceptance.ARRAYS}
    counts = {c: 0 for c in acceptance.COUNTS}
    return base | {"schema_id": "final-acceptance", "acceptance_type": kind, "status": "accepted", "manual_review_summary": counts} | more


def delivery(**more):
    out = common("final_delivery", original_docx_proof={"initial_sha256": "1", "current_sha256": "1", "initial_size_bytes": 5, "current_size_bytes": 5}, original_docx_untouched=True)
    for name, path in (("final_docx", "output/a202401010000.docx"), ("toc_acceptance", "logs/toc.json"), ("repair_execution_log", "logs/log.json"), ("repair_plan_finalized", "plans/repair_plan.finalized.r3.yaml")):
        out |= {f"{name}_path": path, f"{name}_sha256": SHA["a"], f"{name}_size_bytes": 7}
    ref = {"path": "after.json", "sha256": SHA["a"], "size_bytes": 7}
    return out | {"after_snapshot_ref": ref, "review_result_refs": [ref | {"status": "passed"}]} | more


def run(spark, docs, check=acceptance.problems, files=None):
    paths = ["output/a202401010000.docx", "logs/toc.json", "logs/log.json", "plans/repair_plan.finalized.r3.yaml", "after.json", "rule.json", "m.json"]
    files = files or [(r, p, SHA["a"], 7, None) for r in docs for p in paths]
    found = check(spark.createDataFrame([(r, json.dumps(d)) for r, d in docs.items()], "run_id string, acceptance string"), spark.createDataFrame(files, FILES))
    out = {}
    for r in found.collect():
        out.setdefault(r.run_id, set()).add((r.field, r.code))
    return out


def test_branches(spark):
    rule = {"rule_ref_path": "rule.json", "rule_ref_sha256": SHA["a"]}
    build = common("build_rules_terminal", rule_package_status="active", activation_decision_status="approved", package_manifest_path="m.json", package_manifest_sha256=SHA["a"], **rule)
    audit = common("audit_only_terminal", source_audit_refs=[{"path": "after.json", "sha256": SHA["a"], "size_bytes": 7}], source_snapshot_ref={"path": "after.json", "sha256": SHA["a"], "size_bytes": 7}, audit_summary={}, **rule)
    blocked = common("blocked_terminal", terminal_stage="review", terminal_result_id="r", terminal_blocker_refs=["b"]) | {"status": "blocked", "blockers": ["b"]}
    no_reviews = delivery(review_result_refs=[])
    no_proof = delivery(original_docx_untouched=False)
    no_proof["original_docx_proof"]["current_sha256"] = "2"
    docs = {
        "delivery": delivery(), "audit": audit, "build": build, "blocked": blocked, "no_reviews": no_reviews, "no_proof": no_proof,
        "paths": delivery(final_docx_path="output/../x.docx", repair_plan_finalized_path="plans/x.yaml", toc_acceptance_sha256=SHA["b"], repair_execution_log_size_bytes=8),
        "failed_review": delivery(review_result_refs=[{"path": "gone.json", "sha256": SHA["a"], "size_bytes": 7, "status": "failed"}]),
        "build_pending": build | {"rule_package_status": "draft", "manual_review_summary": {c: int(c == "pending_count") for c in acceptance.COUNTS}, "final_docx_path": "x", "review_result_refs": []},
        "blocked_not": {k: v for k, v in blocked.items() if k != "terminal_stage"} | {"status": "accepted", "terminal_blocker_refs": []},
        "categories": audit | {"status": "accepted_with_warnings", "blocking_categories": ["odd"], "report_path": "r", "warnings": {}},
        "type": common("none"),
    }
    assert run(spark, docs) == {
        "no_reviews": {("review_result_refs", "empty")},
        "no_proof": {("original_docx_untouched", "value"), ("original_docx_proof", "changed")},
        "paths": {("final_docx_path", "pattern"), ("final_docx", "path_unsafe"), ("repair_plan_finalized_path", "pattern"), ("repair_plan_finalized", "file_missing"), ("toc_acceptance", "file_hash"), ("repair_execution_log", "file_size")},
        "failed_review": {("review_result_refs", "failed_not_blocked"), ("review_result_refs[0]", "file_missing")},
        "build_pending": {("rule_package_status", "value"), ("manual_review_summary.pending_count", "value"), ("final_docx_path", "not_allowed")},
        "blocked_not": {("status", "value"), ("terminal_stage", "required"), ("terminal_blocker_refs", "empty"), ("blockers", "not_blocked")},
        "categories": {("allowed_warning_categories", "empty"), ("blocking_categories", "unknown"), ("report_path", "not_allowed"), ("warnings", "array")},
        "type": {("acceptance_type", "value")},
    }


def test_second_version(spark):
    ref = lambda name: {"relative_path": f"{name}.json", "sha256": SHA["c"], "size_bytes": 3}
    good = {f: ref(f) for f in acceptance.REFS} | {"status": "accepted", "final_docx_ref": ref("final_docx_ref"), "result_refs": [ref("result")], "gate_check": {"status": "passed"}, "blocking_codes": [], "source_hash_unchanged": True, "all_actions_reviewed": True, "all_gates_passed": True}
    payloads = {f: '{"gate_check": {"status": "passed"}}' for f in acceptance.REFS} | {"repair_log_ref": '{"current_status": "review_ready"}', "toc_acceptance_ref": '{"status": "passed"}', "before_snapshot_ref": json.dumps({"source_docx_ref": {"sha256": SHA["c"]}})}
    docs = {
        "good": good, "blocked": {k: v for k, v in good.items() if k != "final_docx_ref"} | {"status": "blocked", "all_gates_passed": False, "plan_ref": ref("gone")},
        "bad": good | {"blocking_codes": ["x"], "all_actions_reviewed": False, "plan_ref": {"sha256": "z"}, "lock_ref": ref("gone"), "source_docx_ref": ref("source_docx_ref") | {"sha256": SHA["d"]}, "gate_check": {"status": "failed"}},
        "gates": dict(good),
    }
    files = []
    for r in docs:
        for f in (*acceptance.REFS, "final_docx_ref", "result"):
            payload = payloads.get(f)
            if r == "gates":
                payload = {"review_ref": '{"gate_check": {"status": "failed"}}', "repair_log_ref": '{"current_status": "running"}', "toc_acceptance_ref": '{"status": "failed"}', "result": '{"gate_check": {"status": "blocked"}}'}.get(f, payload)
            files.append((r, f"{f}.json", SHA["c"], 3, payload))
    assert run(spark, docs, acceptance.problems_2, files) == {
        "bad": {("blocking_codes", "accepted"), ("all_actions_reviewed", "not_true"), ("plan_ref", "reference"), ("lock_ref", "file_missing"), ("source_docx_ref", "file_hash"), ("source_docx_ref", "other_source"), ("gate_check", "gate_not_passed")},
        "gates": {("review_ref", "gate_not_passed"), ("repair_log_ref", "log_state"), ("toc_acceptance_ref", "not_passed"), ("result_refs[0]", "gate_not_passed")},
    }


def test_next_actions(spark):
    action = {f: None for f in nextaction.FIELDS} | {"kind": "wait_user", "required_inputs": []}
    run_next = action | {"kind": "run_skill", "stage": "review", "skill_name": "s", "idempotency_key": "k", "planned_idempotency_key": "p", "source_result_id": "R1", "n": 1}
    retry = action | {"kind": "retry", "target_result_id": "R1", "target_error_code": "E1", "resume_from_stage": "init", "idempotency_key": "k", "planned_idempotency_key": "p"}
    base = {"stage": "review", "status": "running", "next_action": action}
    states = {
        "wait": base, "run": base | {"applied_result_id": "R1", "next_action": run_next}, "retry": base | {"next_action": retry},
        "early": base | {"final_acceptance_path": "x", "reporting_result_path": "y"}, "accepted": base | {"stage": "reporting", "status": "accepted"},
        "empty": base | {"next_action": {"kind": "run_skill"}}, "kind": base | {"next_action": action | {"kind": "fly"}, "stage": "odd"},
        "later": base | {"next_action": retry | {"resume_from_stage": "reporting", "target_result_id": "R9", "target_error_code": "E9"}},
        "code": base | {"next_action": retry | {"target_error_code": "E3"}}, "any": base | {"next_action": retry | {"target_result_id": None, "target_error_code": "E3"}},
        "inputs": base | {"next_action": action | {"required_inputs": ["A1", "A2", {"artifact_id": "A3", "path": "../x"}, {"path": "ok"}]}},
        "copied": base | {"applied_result_id": "R1", "next_action": run_next | {"planned_idempotency_key": "other", "source_result_id": "R2"}},
        "reason": base | {"applied_result_id": "R1", "next_action": run_next | {"skill_name": "t", "override_reason": "because"}},
    }
    one = {"error": {"code": "E1"}, "blockers": [{"code": "E2"}], "next_action": run_next}
    results = [(r, "R1", json.dumps(one)) for r in states] + [(r, "R2", json.dumps({"gate_check": {"blockers": [{"code": "E3"}]}})) for r in states]
    make = lambda data, schema: spark.createDataFrame(data, schema)
    found = nextaction.problems(make([(r, json.dumps(s)) for r, s in states.items()], "run_id string, state string"), make(results, "run_id string, result_id string, result string"), make([(r, "A1") for r in states], "run_id string, artifact_id string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.run_id, set()).add((r.field.removeprefix("next_action."), r.code))
    assert got == {
        "early": {("final_acceptance_path", "too_early"), ("reporting_result_path", "too_early")},
        "accepted": {("final_acceptance_path", "required")},
        "empty": {(f, "required") for f in nextaction.FIELDS if f != "kind"} | {(f, "empty") for f in ("stage", "skill_name", "idempotency_key", "planned_idempotency_key")},
        "kind": {("kind", "unknown"), ("stage", "unknown")},
        "later": {("resume_from_stage", "too_late"), ("target_result_id", "unresolved"), ("target_error_code", "unresolved")},
        "code": {("target_error_code", "unresolved")},
        "inputs": {("required_inputs:A2", "unresolved"), ("required_inputs:A3", "unresolved"), ("required_inputs:../x", "path")},
        "copied": {("planned_idempotency_key", "not_copied"), ("override_reason", "required"), ("source_result_id", "value")},
    }


def test_texts_are_parsed_once_for_all_fields(spark):
    from formledger.operators import acceptance, nextaction

    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([(1, "{}")], "run_id long, acceptance string")
    nested = sum("." in f for _, f, _, _ in acceptance.DECISIONS)
    assert "Join" not in of(acceptance.decided(df)) and of(acceptance.decided(df)).count("get_json_object(acceptance") == 0
    assert of(acceptance.decided(df)).count("get_json_object") <= 2 * nested
    for plan in (acceptance.consistent(df), acceptance.references(df), nextaction.state_problems(df.withColumnRenamed("acceptance", "state"))):
        assert "get_json_object(state" not in of(plan) and "get_json_object(acceptance" not in of(plan)


def test_results_are_parsed_only_where_a_state_refers_to_them(spark):
    states = spark.createDataFrame([("r", "{}")], "run_id string, state string")
    results = spark.createDataFrame([("r", "R1", "{}")], "run_id string, result_id string, result string")
    plan = nextaction.copy_problems(states, results)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert plan.count("parseJson(result") == 1 and "parseJson(result" not in below and below.count("parseJson(state") == 1


def test_copied_fields_in_other_notations(spark):
    values = ["1000", "1e3", "1000.0", '"1000"', "0.5", "5e-1", '{"a":1.0,"b":[]}', '{"b":[],"a":1}', '"1.0"', '"x"', "null", None, "true"]
    same = [{0, 1, 2}, {3}, {4, 5}, {6, 7}, {8}, {9}, {10, 11}, {12}]
    text = lambda v: '{"applied_result_id":"R1","next_action":{"kind":"wait_user"%s}}' % ("" if v is None else f',"stage":{v}')
    pairs = [(i, j) for i in range(len(values)) for j in range(len(values))]
    states = spark.createDataFrame([(f"{i}-{j}", text(values[i])) for i, j in pairs], "run_id string, state string")
    results = spark.createDataFrame([(f"{i}-{j}", "R1", text(values[j])) for i, j in pairs], "run_id string, result_id string, result string")
    got = {r.run_id for r in nextaction.copy_problems(states, results).collect()}
    assert got == {f"{i}-{j}" for i, j in pairs if not any(i in s and j in s for s in same)}
