"""What a run's state must say: conditions on its stage and status, and on the next action with what it refers to.

States (run_id, state) and results (run_id, result_id, result) are JSON texts.  Conditions on one row are columns; whatever refers to
results, error codes or artifacts meets them by run and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.tables import settled
from . import ledger

# Fields that a next action has, kinds, fields that are copied from the applied result.
FIELDS = ("kind", "stage", "skill_name", "target_result_id", "target_error_code", "source_result_id", "override_reason", "resume_from_stage", "idempotency_key", "planned_idempotency_key", "reason", "required_inputs", "user_message")
KINDS = ("run_skill", "wait_user", "retry", "manual_recover", "finalize", "stop")
COPIED = ("kind", "stage", "skill_name", "target_result_id", "target_error_code", "resume_from_stage", "planned_idempotency_key", "required_inputs")


def _at(path: str, column: str = "state") -> Column:
    return F.get_json_object(column, f"$.{path}")


def _blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def _found(checks: list[tuple[str, str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"))) for f, c, broken in checks]))


def _copied(action: Column) -> Column:
    """The copied fields of a next action, as JSON; what isn't there is null."""
    return F.struct(*[F.coalesce(F.to_json(F.try_variant_get(action, f"$.{f}", "variant")), F.lit("null")).alias(f) for f in COPIED])


def _action(text: str) -> Column:
    """A text's next action, to be named as a column of its own: then a text is parsed once for all fields."""
    return F.try_variant_get(F.try_parse_json(text), "$.next_action", "variant")


def _differs(a: Column, b: Column) -> Column:
    """Whether two values, written by ``_copied``, are different: equal texts are equal, and only numbers have several notations."""
    same = lambda x: F.when(x.rlike("[0-9][.eE]"), F.coalesce(scalars.canonical_json(x), F.lit("null"))).otherwise(x)
    return F.when(a == b, False).otherwise(same(a) != same(b))


def _told(states: DataFrame) -> DataFrame:
    """A row for each state with all that the checks take of it.

    found: what contradicts the stage, the status or the action's kind; target: what a retry refers to; applied: the applied result
    and the copied fields as they stand; inputs: artifacts and paths that the next action asks for.
    """
    # a text is parsed once for all its fields, and so is its next action
    top = ("stage", "status", "final_acceptance_path", "reporting_result_path", "applied_result_id", "next_action")
    parsed = states.select("run_id", "state", F.json_tuple("state", *top).alias(*[f"_{f}" for f in top]))
    rows = parsed.select("*", F.json_object_keys("_next_action").alias("_keys"), F.json_tuple("_next_action", *FIELDS).alias(*[f"_n_{f}" for f in FIELDS]))
    at, action = lambda f: F.col(f"_{f}"), lambda f: F.col(f"_n_{f}")
    # under names of their own: a name for a rank is a column, which is computed once for all checks
    used = _at("applied_result_id")
    ranks = rows.withColumns({"_kind": _at("next_action.kind"), "_used": used, "_action": F.when(used.isNotNull(), _action("state")), "_rank": ledger.stage_rank(at("stage")), "_resume": ledger.stage_rank(action("resume_from_stage")), "_lack": F.array_except(F.array(*[F.lit(f) for f in FIELDS]), F.coalesce("_keys", F.array().cast("array<string>")))})
    rank, status, kind = F.col("_rank"), at("status"), action("kind")
    final, reporting = ledger.STAGES.index("final_acceptance"), ledger.STAGES.index("reporting")
    again = kind.isin("retry", "manual_recover")
    run = kind == "run_skill"
    checks = [
        ("stage", "unknown", F.coalesce(rank == ledger.UNKNOWN_STAGE, F.lit(True))),
        ("final_acceptance_path", "too_early", (rank < final) & at("final_acceptance_path").isNotNull()),
        ("final_acceptance_path", "required", status.isin("accepted", "accepted_with_warnings") & at("final_acceptance_path").isNull()),
        ("reporting_result_path", "too_early", (rank < reporting) & at("reporting_result_path").isNotNull()),
        ("next_action.kind", "unknown", ~F.coalesce(kind.isin(*KINDS), F.lit(False))),
        *[(f"next_action.{f}", "empty", run & _blank(action(f))) for f in ("stage", "skill_name")],
        *[(f"next_action.{f}", "empty", (run | again) & _blank(action(f))) for f in ("idempotency_key", "planned_idempotency_key")],
        ("next_action.target_result_id", "empty", again & _blank(action("target_result_id")) & _blank(action("target_error_code"))),
        ("next_action.resume_from_stage", "empty", again & _blank(action("resume_from_stage"))),
        ("next_action.resume_from_stage", "too_late", again & ~_blank(action("resume_from_stage")) & (F.col("_resume") > rank)),
        ("next_action.source_result_id", "value", at("applied_result_id").isNotNull() & ~action("source_result_id").eqNullSafe(at("applied_result_id"))),
    ]
    lacking = F.transform("_lack", lambda f: F.struct(F.concat(F.lit("next_action."), f).alias("field"), F.lit("required").alias("code")))
    target = F.when(F.col("_kind").isin("retry", "manual_recover"), F.struct(_at("next_action.target_result_id").alias("result_id"), _at("next_action.target_error_code").alias("error_code")))
    own = F.struct(F.col("_kind").alias("kind"), _at("next_action.override_reason").alias("reason"), _copied(F.col("_action")).alias("fields"))
    each = F.try_variant_get(F.try_parse_json(_at("next_action.required_inputs")), "$", "array<variant>")
    text = lambda v: F.schema_of_variant(v) == "STRING"
    asked = lambda v: F.struct(F.when(text(v), F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.artifact_id", "string")).alias("artifact_id"), F.when(~text(v), F.try_variant_get(v, "$.path", "string")).alias("path"))
    return ranks.select("run_id", F.concat(_found(checks), lacking).alias("found"), target.alias("target"), F.when(F.col("_used").isNotNull(), F.struct(F.col("_used").alias("result_id"), own.alias("own"))).alias("applied"), F.transform(each, asked).alias("inputs"))


def state_problems(states: DataFrame) -> DataFrame:
    """run_id, field, code: what contradicts the stage or status, and what the next action's kind asks for."""
    return _state_problems(_told(states))


def _state_problems(told: DataFrame) -> DataFrame:
    return told.select("run_id", F.explode("found").alias("f")).select("run_id", "f.*")


def _codes() -> Column:
    many = lambda path: F.transform(F.coalesce(F.from_json(_at(path, "result"), "array<struct<code:string>>"), F.array().cast("array<struct<code:string>>")), lambda x: x["code"])
    return F.array_distinct(F.array_compact(F.concat(F.array(_at("error.code", "result")), many("blockers"), many("gate_check.blockers"))))


def error_codes(results: DataFrame) -> DataFrame:
    """run_id, result_id, error_code: of a result's error, its blockers and its gate's blockers."""
    return results.select("run_id", "result_id", F.explode(_codes()).alias("error_code"))


def _met(told: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, result_id, error_code, is_target and what is known of each result that states refer to.

    here: whether there is such a result; known: whether it has the error code; key_differs, differs: whether the action of a state
    that applied it isn't its own.  Only results that states refer to are parsed.
    """
    schema = told.schema["applied"].dataType["own"].dataType.simpleString()
    targets = told.where("target IS NOT NULL").select("run_id", "target.result_id", "target.error_code", F.lit(None).cast(schema).alias("own"))
    applied = told.where("applied IS NOT NULL").select("run_id", "applied.result_id", F.lit(None).cast("string").alias("error_code"), "applied.own")
    rows = targets.unionByName(applied).join(results.select("run_id", "result_id", "result", F.lit(True).alias("_here")), ["run_id", "result_id"], "left")
    is_target, here = F.col("own").isNull(), F.coalesce("_here", F.lit(False))
    rows = rows.select("run_id", "result_id", "error_code", "own", is_target.alias("is_target"), here.alias("here"), F.when(is_target & here & ~_blank(F.col("error_code")), F.array_contains(_codes(), F.col("error_code"))).alias("known"), F.when(~is_target & here, _action("result")).alias("_action"))
    rows = rows.withColumn("b", F.when(~F.col("is_target") & F.col("here"), _copied(F.col("_action")))).drop("_action")
    pair = lambda f: _differs(F.col(f"own.fields.{f}"), F.col(f"b.{f}"))
    key = (F.col("own.kind") == "run_skill") & pair("planned_idempotency_key")
    other = pair(COPIED[0])
    for f in COPIED[1:]:
        other = other | pair(f)
    rows = rows.select("run_id", "result_id", "error_code", "is_target", "here", "known", F.when(F.col("b").isNotNull(), key).alias("key_differs"), F.when(F.col("b").isNotNull(), _blank(F.col("own.reason")) & other).alias("differs"))
    # those of one run and result lie together after the join; a flag that holds for one row holds for them all
    return rows.groupBy("run_id", "result_id", "error_code", "is_target").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("here", "known", "key_differs", "differs")])


def _target_problems(met: DataFrame, results: DataFrame) -> DataFrame:
    targets = met.where("is_target")
    asked = ~_blank(F.col("error_code"))
    own = targets.select("run_id", F.explode(_found([("next_action.target_result_id", "unresolved", ~_blank(F.col("result_id")) & ~F.col("here")), ("next_action.target_error_code", "unresolved", asked & F.col("here") & ~F.col("known"))])).alias("f")).select("run_id", "f.*")
    # a target that isn't there: the codes of any result of the run
    lost = targets.where(asked & ~F.col("here")).select("run_id", "error_code").distinct()
    codes = error_codes(results.join(lost.select("run_id"), "run_id", "left_semi")).select("run_id", "error_code").distinct()
    unknown = lost.join(codes, ["run_id", "error_code"], "left_anti")
    return own.unionByName(unknown.select("run_id", F.lit("next_action.target_error_code").alias("field"), F.lit("unresolved").alias("code")))


def _input_problems(told: DataFrame, artifacts: DataFrame) -> DataFrame:
    each = told.select("run_id", F.explode("inputs").alias("i")).select("run_id", "i.*")
    absent = each.where(~_blank(F.col("artifact_id"))).join(artifacts.select("run_id", "artifact_id").distinct(), ["run_id", "artifact_id"], "left_anti")
    absent = absent.select("run_id", F.concat(F.lit("required_inputs:"), F.col("artifact_id")).alias("field"), F.lit("unresolved").alias("code"))
    unsafe = each.where(F.col("path").isNotNull() & scalars.path_problem(F.col("path")).isNotNull()).select("run_id", F.concat(F.lit("required_inputs:"), F.col("path")).alias("field"), F.lit("path").alias("code"))
    return absent.unionByName(unsafe)


def _copy_problems(met: DataFrame) -> DataFrame:
    checks = [("next_action.planned_idempotency_key", "not_copied", F.col("key_differs")), ("next_action.override_reason", "required", F.col("differs"))]
    return met.where("NOT is_target").select("run_id", F.explode(_found(checks)).alias("f")).select("run_id", "f.*")


def reference_problems(states: DataFrame, results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run_id, field, code: targets, error codes and inputs (artifacts: run_id, artifact_id) that aren't there, paths that aren't safe."""
    told = _told(states)
    return _target_problems(_met(told, results), results).unionByName(_input_problems(told, artifacts)).distinct()


def copy_problems(states: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, field, code: a next action that isn't the applied result's, without a reason for the difference.

    Fields are compared as canonical JSON, so the notation of numbers and the order of keys don't matter.
    """
    return _copy_problems(_met(_told(states), results))


def problems(states: DataFrame, results: DataFrame, artifacts: DataFrame) -> DataFrame:
    told = settled(_told(states), "told")
    met = settled(_met(told, results), "met")
    return _state_problems(told).unionByName(_target_problems(met, results)).unionByName(_input_problems(told, artifacts)).unionByName(_copy_problems(met)).distinct()
