"""Final acceptances by a decision table: what each kind of ending must and may not hold, its files, gates and log.

An acceptance is a JSON text.  The table says, by branch, what a field needs; an acceptance meets the rows of its own branch, of the
branch ``*`` and, unless it is a delivery, of ``not_final``.  The table is fixed and small: each of its rows is a condition on the columns that
an acceptance is parsed into, once.
References of all kinds become one table of (field, path, hash, size) that meets the run's files by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

# Kinds of endings, statuses, categories, fields.
TYPES = ("final_delivery", "audit_only_terminal", "build_rules_terminal", "blocked_terminal")
STATUSES = ("accepted", "accepted_with_warnings", "blocked")
BLOCKING = ("toc_failed", "high_risk_unconfirmed", "manual_review_pending", "evidence_chain_broken", "schema_invalid", "path_escape", "original_docx_modified", "repair_action_failed")
WARNINGS = ("non_blocking_warning",)
COMMON = ("schema_id", "schema_version", "contract_version", "run_id", "acceptance_type", "status", "skill_results", "evidence_manifest_path", "evidence_manifest_sha256", "evidence_manifest_size_bytes", "manual_review_summary", "warnings", "blockers", "blocking_categories", "allowed_warning_categories", "evaluated_at")
ARRAYS = ("skill_results", "warnings", "blockers", "blocking_categories", "allowed_warning_categories")
REPORTING_FIELDS = ("report_refs", "report_path", "report_paths", "report_artifacts", "reporting_result_path", "reporting_manifest_ref")
DELIVERY_FIELDS = ("final_docx_path", "toc_acceptance_path", "repair_execution_log_path", "repair_plan_finalized_path", "after_snapshot_ref", "review_result_refs")
PLAN_PATH, DELIVERY_PATH = r"^plans/repair_plan\.finalized\.r[0-9]+\.yaml$", r"^output/[^/\\]+[0-9]{12}(_r[0-9]{2})?\.docx$"
COUNTS = ("pending_count", "blocking_count", "unresolved_manual_review_count", "high_risk_unconfirmed_count")
FILES = {"final_delivery": ("final_docx", "toc_acceptance", "repair_execution_log", "repair_plan_finalized"), "audit_only_terminal": ("rule_ref",), "build_rules_terminal": ("rule_ref", "package_manifest")}
OBJECTS = {"final_delivery": ("after_snapshot_ref",), "audit_only_terminal": ("source_snapshot_ref",)}
LISTS = {"final_delivery": "review_result_refs", "audit_only_terminal": "source_audit_refs"}
#: Version 2: references that each acceptance has, statuses, and states of the log that allow acceptance.
REFS = ("source_docx_ref", "lock_ref", "capability_ref", "before_snapshot_ref", "after_snapshot_ref", "plan_ref", "request_ref", "repair_log_ref", "review_ref", "evidence_manifest_ref", "toc_acceptance_ref")
STATUSES_2 = ("accepted", "blocked", "rejected")
LOG_STATES = ("review_ready", "accepted")

#: (branch, field, need, argument).
DECISIONS = [
    *[("*", f, "present", "") for f in COMMON],
    *[("*", f, "array", "") for f in ARRAYS],
    *[("*", f, "absent", "") for f in REPORTING_FIELDS],
    ("*", "schema_id", "equal", "final-acceptance"),
    *[("not_final", f, "empty", "") for f in DELIVERY_FIELDS],
    *[("final_delivery", f, "present", "") for f in ("original_docx_proof", "after_snapshot_ref", "review_result_refs")],
    ("final_delivery", "original_docx_untouched", "equal", "true"),
    ("final_delivery", "review_result_refs", "filled", ""),
    ("final_delivery", "repair_plan_finalized_path", "like", PLAN_PATH),
    ("final_delivery", "final_docx_path", "like", DELIVERY_PATH),
    *[("audit_only_terminal", f, "present", "") for f in ("source_audit_refs", "source_snapshot_ref", "rule_ref_path", "rule_ref_sha256", "audit_summary")],
    *[("build_rules_terminal", f, "present", "") for f in ("rule_ref_path", "rule_ref_sha256", "package_manifest_path", "package_manifest_sha256")],
    ("build_rules_terminal", "rule_package_status", "equal", "active"),
    ("build_rules_terminal", "activation_decision_status", "equal", "approved"),
    *[("build_rules_terminal", f"manual_review_summary.{c}", "equal", "0") for c in COUNTS],
    ("blocked_terminal", "status", "equal", "blocked"),
    *[("blocked_terminal", f, "present", "") for f in ("terminal_stage", "terminal_result_id", "terminal_blocker_refs")],
    ("blocked_terminal", "terminal_blocker_refs", "filled", ""),
]


def _at(path: str) -> Column:
    return F.get_json_object("acceptance", f"$.{path}")


def _row(df: DataFrame) -> DataFrame:
    return df.where(F.col("code").isNotNull()).select("run_id", "field", "code")


def _wide(acceptances: DataFrame, fields: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Acceptances with a column for each field, and these columns by field: a text is parsed once for all of them."""
    top = sorted({f.split(".")[0] for f in fields})
    names = [f"_f{i}" for i in range(len(top))]
    rows = acceptances.select("*", F.json_object_keys("acceptance").alias("_keys"), F.json_tuple("acceptance", *top).alias(*names))
    columns = dict(zip(top, map(F.col, names)))
    for field in fields:
        head, _, rest = field.partition(".")
        columns[field] = F.get_json_object(columns[head], f"$.{rest}") if rest else columns[head]
    return rows, columns


def decided(acceptances: DataFrame) -> DataFrame:
    """run_id, field, code for every row of the decision table that an acceptance doesn't meet."""
    rows, columns = _wide(acceptances, [*(f for _, f, _, _ in DECISIONS), "acceptance_type"])
    kind = columns["acceptance_type"]
    of = {"*": F.lit(True), "not_final": F.coalesce(kind.isin(*TYPES[1:]), F.lit(False))}
    found = []
    for branch, field, need, argument in DECISIONS:
        value = columns[field]
        here = F.coalesce(F.array_contains("_keys", field), F.lit(False))
        blank = value.isNull() | value.isin("[]", "{}", "")
        broken, code = {
            "present": lambda: (~here, "required"),
            "array": lambda: (here & (F.coalesce(F.left(value, F.lit(1)), F.lit("")) != "["), "array"),
            "absent": lambda: (here, "not_allowed"),
            "empty": lambda: (~blank, "not_allowed"),
            "filled": lambda: (blank, "empty"),
            "equal": lambda: (~value.eqNullSafe(F.lit(argument)), "value"),
            "like": lambda: (value.isNotNull() & ~F.coalesce(value, F.lit("")).rlike(argument), "pattern"),
        }[need]()
        own = of.get(branch, F.coalesce(kind == branch, F.lit(False)))
        found.append(F.when(own & broken, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))))
    return rows.select("run_id", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("f")).select("run_id", "f.*")


def consistent(acceptances: DataFrame) -> DataFrame:
    """run_id, field, code: statuses against blockers, categories and reviews, and the proof of the untouched original."""
    proofs = [f"original_docx_proof.{f}" for f in ("initial_sha256", "current_sha256", "initial_size_bytes", "current_size_bytes")]
    rows, at = _wide(acceptances, ["status", "acceptance_type", "blockers", "blocking_categories", "allowed_warning_categories", "review_result_refs", *proofs])
    status, kind = at["status"], at["acceptance_type"]
    filled = lambda f: ~(at[f].isNull() | at[f].isin("[]", "{}", ""))
    listed = lambda f: F.coalesce(F.from_json(at[f], "array<string>"), F.array().cast("array<string>"))
    unknown = lambda f, known: F.size(F.array_except(listed(f), F.array(*[F.lit(k) for k in known]))) > 0
    proof = lambda f: at[f"original_docx_proof.{f}"]
    failed = F.exists(F.coalesce(F.from_json(at["review_result_refs"], "array<struct<status:string>>"), F.array().cast("array<struct<status:string>>")), lambda x: x["status"] == "failed")
    delivery = kind == "final_delivery"
    checks = [
        ("acceptance_type", "value", ~F.coalesce(kind.isin(*TYPES), F.lit(False))),
        ("status", "value", ~F.coalesce(status.isin(*STATUSES), F.lit(False))),
        ("blockers", "not_blocked", filled("blockers") & ~status.eqNullSafe("blocked")),
        ("blocking_categories", "accepted", (status == "accepted") & filled("blocking_categories")),
        ("allowed_warning_categories", "empty", (status == "accepted_with_warnings") & ~filled("allowed_warning_categories")),
        ("blocking_categories", "unknown", unknown("blocking_categories", BLOCKING)),
        ("allowed_warning_categories", "unknown", unknown("allowed_warning_categories", WARNINGS)),
        ("original_docx_proof", "changed", delivery & (~proof("initial_sha256").eqNullSafe(proof("current_sha256")) | ~proof("initial_size_bytes").eqNullSafe(proof("current_size_bytes")))),
        ("review_result_refs", "failed_not_blocked", delivery & failed & ~status.eqNullSafe("blocked")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"))) for f, c, broken in checks]))
    return rows.select("run_id", F.explode(found).alias("f")).select("run_id", "f.*")


_REF = "field string, path string, sha256 string, size_bytes string"


def references(acceptances: DataFrame) -> DataFrame:
    """run_id, field, path, sha256, size_bytes (null: not stated), by the branch's fields: triples, objects, lists of objects."""
    triples = [f"{p}_{x}" for names in FILES.values() for p in names for x in ("path", "sha256", "size_bytes")]
    objects = [f"{o}.{x}" for names in OBJECTS.values() for o in names for x in ("path", "sha256", "size_bytes")]
    rows, at = _wide(acceptances, ["acceptance_type", *triples, *objects, *LISTS.values()])
    kind = at["acceptance_type"]
    ref = lambda name, path, sha, size: F.struct(name.alias("field"), path.alias("path"), sha.alias("sha256"), size.alias("size_bytes"))
    none = F.array().cast("array<struct<field:string,path:string,sha256:string,size_bytes:string>>")
    parts = []
    for branch in TYPES:
        own = [ref(F.lit(p), at[f"{p}_path"], at[f"{p}_sha256"], at[f"{p}_size_bytes"]) for p in FILES.get(branch, ())]
        own += [ref(F.lit(o), at[f"{o}.path"], at[f"{o}.sha256"], at[f"{o}.size_bytes"]) for o in OBJECTS.get(branch, ())]
        all_ = F.array(*own) if own else none
        if branch in LISTS:
            name = LISTS[branch]
            listed = F.coalesce(F.from_json(at[name], "array<struct<path:string,sha256:string,size_bytes:string>>"), F.array().cast("array<struct<path:string,sha256:string,size_bytes:string>>"))
            all_ = F.concat(all_, F.transform(listed, lambda x, i: ref(F.format_string(f"{name}[%d]", i), x["path"], x["sha256"], x["size_bytes"])))
        parts.append(F.when(kind == branch, all_).otherwise(none))
    return rows.select("run_id", F.explode(F.concat(*parts)).alias("r")).select("run_id", "r.*")


def file_problems(refs: DataFrame, files: DataFrame) -> DataFrame:
    """run_id, field, code of references whose path is unsafe or whose file (run_id, path, sha256, size_bytes) isn't there or is another."""
    real = files.select("run_id", "path", F.lit(True).alias("_there"), F.col("sha256").alias("_sha"), F.col("size_bytes").cast("string").alias("_size"))
    rows = refs.join(real, ["run_id", "path"], "left")
    code = (
        F.when(F.col("path").isNull(), "path_required")
        .when(scalars.path_problem(F.col("path")).isNotNull(), "path_unsafe")
        .when(F.col("_there").isNull(), "file_missing")
        .when(~F.col("sha256").eqNullSafe(F.col("_sha")), "file_hash")
        .when(F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("_size")), "file_size")
    )
    return _row(rows.withColumn("code", code))


def problems(acceptances: DataFrame, files: DataFrame) -> DataFrame:
    """run_id, field, code: everything that keeps an acceptance (run_id, acceptance) of version 1 from being valid."""
    return decided(acceptances).unionByName(consistent(acceptances)).unionByName(file_problems(references(acceptances), files)).distinct()


def problems_2(acceptances: DataFrame, files: DataFrame) -> DataFrame:
    """run_id, field, code for acceptances of version 2; ``files`` also have ``payload``, the JSON of those that are.

    References must be whole in any case.  To be accepted, all must be the run's files, with passed gates where these have any; the log
    must be in a state for it, the original the one that the first snapshot saw, and nothing may block.
    """
    status = _at("status")
    accepted = F.coalesce(status == "accepted", F.lit(False))
    object_of = lambda f: F.struct(F.lit(f).alias("field"), _at(f"{f}.relative_path").alias("path"), _at(f"{f}.sha256").alias("sha256"), _at(f"{f}.size_bytes").alias("size_bytes"))
    listed = F.coalesce(F.from_json(_at("result_refs"), "array<struct<relative_path:string,sha256:string,size_bytes:string>>"), F.array().cast("array<struct<relative_path:string,sha256:string,size_bytes:string>>"))
    results = F.transform(listed, lambda x, i: F.struct(F.format_string("result_refs[%d]", i).alias("field"), x["relative_path"].alias("path"), x["sha256"].alias("sha256"), x["size_bytes"].alias("size_bytes")))
    final = F.when(_at("final_docx_ref").isNotNull() & (_at("final_docx_ref") != "null"), F.array(object_of("final_docx_ref"))).otherwise(F.array().cast("array<struct<field:string,path:string,sha256:string,size_bytes:string>>"))
    refs = acceptances.select("run_id", accepted.alias("_accepted"), F.explode(F.concat(F.array(*[object_of(f) for f in REFS]), results, final)).alias("r")).select("run_id", "_accepted", "r.*")
    whole = F.col("path").isNotNull() & F.coalesce(F.col("sha256").rlike(scalars.HASH), F.lit(False)) & F.coalesce(F.col("size_bytes").rlike("^[0-9]+$"), F.lit(False))
    shape = _row(refs.withColumn("code", F.when(~whole, "reference")))
    mine = refs.where("_accepted")
    there = mine.join(files.select("run_id", "path", F.col("payload")), ["run_id", "path"])
    in_payload = lambda p: F.get_json_object("payload", p)
    gate, log = in_payload("$.gate_check.status"), in_payload("$.current_status")
    found = F.array_compact(
        F.array(
            F.when(gate.isNotNull() & (gate != "passed") & ~F.col("field").isin("source_docx_ref", "final_docx_ref"), F.lit("gate_not_passed")),
            F.when((F.col("field") == "review_ref") & gate.isNull(), F.lit("gate_not_passed")),
            F.when((F.col("field") == "toc_acceptance_ref") & ~in_payload("$.status").eqNullSafe("passed"), F.lit("not_passed")),
            F.when((F.col("field") == "repair_log_ref") & ~F.coalesce(log.isin(*LOG_STATES), F.lit(False)), F.lit("log_state")),
        )
    )
    gates = there.select("run_id", "field", F.explode(found).alias("code"))
    source = acceptances.select("run_id", _at("source_docx_ref.sha256").alias("_source"))
    seen = there.where("field = 'before_snapshot_ref'").join(source, "run_id").select("run_id", F.lit("source_docx_ref").alias("field"), F.when(in_payload("$.source_docx_ref.sha256") != F.col("_source"), "other_source").alias("code"))
    blank = lambda f: _at(f).isNull() | _at(f).isin("[]", "null")
    checks = [
        ("status", "value", ~F.coalesce(status.isin(*STATUSES_2), F.lit(False))),
        ("final_docx_ref", "required", accepted & blank("final_docx_ref")),
        ("blocking_codes", "accepted", accepted & ~blank("blocking_codes")),
        ("gate_check", "gate_not_passed", accepted & ~_at("gate_check.status").eqNullSafe("passed")),
        *[(f, "boolean", ~F.coalesce(_at(f).isin("true", "false"), F.lit(False))) for f in ("source_hash_unchanged", "all_actions_reviewed", "all_gates_passed")],
        *[(f, "not_true", accepted & ~_at(f).eqNullSafe("true")) for f in ("source_hash_unchanged", "all_actions_reviewed", "all_gates_passed")],
    ]
    own = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"))) for f, c, broken in checks]))
    flat = acceptances.select("run_id", F.explode(own).alias("f")).select("run_id", "f.*")
    return shape.unionByName(file_problems(mine.where(whole).drop("_accepted"), files)).unionByName(gates).unionByName(_row(seen)).unionByName(flat).distinct()
