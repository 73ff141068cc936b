"""Requests and the plans they come from: operations of actions, batches, and what a request has otherwise than its plan's rebuilt batches.

An action is a JSON text.  What may run becomes an operation with a number in its batch, an idempotency key and what must
hold after it; batches hold at most ``repair.BATCH`` operations, and a heavy write stands alone.  Whole batches are compared in a
canonical form (sorted keys, equal numbers equal, whatever their notation); only those that differ are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.tables import settled
from . import repair

# Commands that a request may hold, raw writes, fields that make an operation's key, what a run adds to a batch.
COMMANDS = ("set", "add", "remove", "move", "swap", "raw-set")
KEYED = ("command", "destination_path", "element_type", "index", "path", "properties", "raw")
ADDED_BY_RUN = ("batch_ref", "checkpoint_ref")
TIMEOUT_SECONDS = 120
FAILED_OPERATION, FAILED_BATCH = "DFR-POSTCONDITION-FAILED", "DFR-VALIDATE-FAILED"


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def operations(actions: DataFrame) -> DataFrame:
    """run_id, position and the fields of an operation, for each action (run_id, position, action) that may run."""
    v = F.col("_v")
    rows = actions.select("run_id", "position", "action", F.try_parse_json("action").alias("_v"))
    command = _text(v, "$.backend_action.command")
    may = (_text(v, "$.execution_status") == "executable") & (_text(v, "$.status") == "executable") & command.isin(*COMMANDS)
    part = lambda path: F.get_json_object("action", path)  # noqa: E731  numbers keep their notation
    return rows.where(may).select(
        "run_id",
        "position",
        F.coalesce(_text(v, "$.action_id"), F.lit("")).alias("source_action_id"),
        command.alias("command"),
        F.coalesce(_text(v, "$.backend_action.path"), _text(v, "$.target_binding.path"), F.lit("")).alias("path"),
        _text(v, "$.backend_action.element_type").alias("element_type"),
        F.coalesce(_text(v, "$.risk_class"), F.lit("L2")).alias("risk_class"),
        F.coalesce(part("$.backend_action.properties"), F.lit("{}")).alias("properties"),
        F.coalesce(part("$.target_binding"), F.lit("{}")).alias("target_binding"),
        F.to_json(F.try_variant_get(v, "$.backend_action.index", "variant")).alias("index"),
        _text(v, "$.backend_action.destination_path").alias("destination_path"),
        F.when(command == "raw-set", part("$.backend_action.raw")).alias("raw"),
        _text(v, "$.manual_confirmation_ref").alias("manual_confirmation_ref"),
    )


def raw_problems(ops: DataFrame) -> DataFrame:
    """run_id, position, code: raw writes without a known action."""
    act = _text(F.try_parse_json("raw"), "$.action")
    known = F.coalesce(act.isin(*scalars.RAW_ACTIONS), F.lit(False))
    return ops.where((F.col("command") == "raw-set") & ~known).select("run_id", "position", F.lit("raw_action").alias("code"))


def native() -> Column:
    """An operation (the columns of ``operations``) as the editor takes it, a JSON text.

    Governance fields and nulls are gone, values of properties are texts.  Only ``add`` has a type, only ``move`` a destination,
    only ``raw-set`` the raw fields; an index must be a whole number.
    """
    command, index, raw = F.col("command"), F.try_parse_json("index"), F.try_parse_json("raw")
    props = F.map_filter(F.try_variant_get(F.try_parse_json("properties"), "$", "map<string,variant>"), lambda k, x: ~F.is_variant_null(x))
    named = F.transform_values(props, lambda k, x: scalars.variant_text(x))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.to_json(
        F.struct(
            command,
            F.col("path"),
            F.when(command == "add", given("element_type")).alias("type"),
            F.when(F.size(named) > 0, named).alias("props"),
            F.when(command == "move", given("destination_path")).alias("to"),
            F.when(F.schema_of_variant(index) == "BIGINT", F.try_variant_get(index, "$", "bigint")).alias("index"),
            *[F.when(command == "raw-set", _text(raw, f"$.{f}")).alias(f) for f in ("part", "xpath", "action", "xml")],
        )
    )


def batches(ops: DataFrame, plans: DataFrame) -> DataFrame:
    """run_id, sequence, batch (canonical JSON) rebuilt from operations and plans (run_id, plan_sha256, before_sha256).

    A batch holds at most ``repair.BATCH`` operations, which bounds what is gathered into one row.  Operations are written first: laying
    them out reads them three times, and each time would parse all actions.
    """
    placed = settled(ops, "operations").withColumn("_alone", F.col("risk_class") == "L3_WRITE").withColumnRenamed("position", "_order")
    numbered = repair.batches(placed, "run_id", "_order", "_alone")
    rows = numbered.join(plans.select("run_id", "plan_sha256", "before_sha256"), "run_id")
    number = F.format_string("%03d-%03d", F.col("batch"), F.col("position"))
    parsed = lambda c: F.try_parse_json(c).alias(c)
    as_variant = {c: parsed(c) for c in ("properties", "target_binding", "index", "raw")}
    field = lambda c: as_variant.get(c, F.col(c))
    keyed = scalars.canonical_json(_json(*[field(c) for c in KEYED]))
    payload = F.concat_ws("\n", "plan_sha256", "before_sha256", F.col("batch").cast("string"), keyed)
    after = F.struct(
        F.concat(F.lit("POST-OP-"), number).alias("predicate_id"), F.lit("property_equals").alias("type"), F.col("path").alias("target_ref"), F.lit(None).cast("string").alias("json_pointer"),
        F.lit(True).alias("expected"), F.lit(FAILED_OPERATION).alias("failure_code"),
    )
    whole = _json(
        F.concat(F.lit("OP-"), number).alias("operation_id"), F.sha2(payload, 256).alias("idempotency_key"), after.alias("expected_result"),
        *[field(c) for c in ("source_action_id", "command", "path", "element_type", "risk_class", "properties", "target_binding", "index", "destination_path", "raw", "manual_confirmation_ref")],
    )
    each = rows.select("run_id", "batch", "position", whole.alias("op"))
    grouped = each.groupBy("run_id", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "op"))).alias("ops"))
    seq = F.format_string("%03d", F.col("batch"))
    clean = F.struct(F.concat(F.lit("POST-B-"), seq).alias("predicate_id"), F.lit("validate_clean").alias("type"), F.lit("working_docx").alias("target_ref"), F.lit(None).cast("string").alias("json_pointer"), F.lit(True).alias("expected"), F.lit(FAILED_BATCH).alias("failure_code"))
    made = _json(
        F.concat(F.lit("BATCH-"), seq).alias("batch_id"), F.col("batch").alias("sequence"), F.lit("stop_on_first_error").alias("atomicity"), F.lit(TIMEOUT_SECONDS).alias("timeout_seconds"),
        F.size("ops").alias("max_operations"), F.array().alias("preconditions"), F.transform("ops", lambda x: F.try_parse_json(x["op"])).alias("operations"), F.array(clean).alias("postconditions"),
    )
    return grouped.select("run_id", F.col("batch").alias("sequence"), scalars.canonical_json(made).alias("batch"))


def batches_of(requests: DataFrame) -> DataFrame:
    """run_id, sequence, batch of requests (run_id, request): place in the request's list, without what a run adds."""
    listed = F.try_variant_get(F.try_parse_json("request"), "$.batches", "array<variant>")
    rows = requests.select("run_id", F.posexplode(listed).alias("_at", "_batch"))
    return rows.select("run_id", (F.col("_at") + 1).cast("long").alias("sequence"), F.to_json("_batch").alias("batch"))


def without_run_fields(batch: Column) -> Column:
    return F.to_json(F.map_filter(F.try_variant_get(F.try_parse_json(batch), "$", "map<string,variant>"), lambda k, v: ~k.isin(*ADDED_BY_RUN)))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """run_id, sequence, json_path, expected, actual: each value that one of two tables of batches has otherwise.

    A batch on one side only is one row with the path ``$``.  Batches meet by run and place; equal canonical texts go at once.
    """
    a = expected.select("run_id", "sequence", F.col("batch").alias("_a"))
    b = actual.select("run_id", "sequence", scalars.canonical_json(without_run_fields(F.col("batch"))).alias("_b"))
    off = settled(a.join(b, ["run_id", "sequence"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))), "differing-batches")
    one_sided = off.where("_a IS NULL OR _b IS NULL").select("run_id", "sequence", F.lit("$").alias("json_path"), F.col("_a").alias("expected"), F.col("_b").alias("actual"))
    both = off.where("_a IS NOT NULL AND _b IS NOT NULL")
    return one_sided.unionByName(_inside(both))


def _leaf(text: Column) -> Column:
    return ~F.left(text, F.lit(1)).isin("{", "[") | text.isin("{}", "[]")


def _below(text: Column) -> Column:
    """What is one step below a JSON value: step (``.key`` or ``[place]``) -> JSON text; empty for what has nothing below."""
    v = F.try_parse_json(text)
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = F.transform(fields, lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("k"), F.to_json(e["value"]).alias("t")))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("k"), F.to_json(x).alias("t")))
    none = F.array().cast("array<struct<k:string,t:string>>")
    return F.map_from_entries(F.when(F.left(text, F.lit(1)) == "{", named).when(F.left(text, F.lit(1)) == "[", listed).otherwise(none))


def _inside(both: DataFrame) -> DataFrame:
    """Values that differ in pairs of texts (run_id, sequence, _a, _b): level by level, only below values that differ, and without a join."""
    whole = lambda c: F.to_json(F.try_parse_json(c)).alias(c)
    level = both.select("run_id", "sequence", F.lit("$").alias("json_path"), whole("_a"), whole("_b"))
    found = []
    while True:
        now = settled(level.where(~F.col("_a").eqNullSafe(F.col("_b"))), "differing-values")
        if not now.take(1):
            break
        found.append(now)
        deep = now.where(~_leaf(F.col("_a")) | ~_leaf(F.col("_b"))).select("run_id", "sequence", "json_path", _below(F.coalesce("_a", F.lit(""))).alias("_ma"), _below(F.coalesce("_b", F.lit(""))).alias("_mb"))
        steps = deep.select("*", F.explode(F.array_union(F.map_keys("_ma"), F.map_keys("_mb"))).alias("_k"))
        at = lambda m: F.try_element_at(m, F.col("_k"))
        level = steps.select("run_id", "sequence", F.concat("json_path", "_k").alias("json_path"), at("_ma").alias("_a"), at("_mb").alias("_b"))
    out = now.limit(0)
    for part in found:
        out = out.unionByName(part)
    own = lambda c, name: F.when(_leaf(F.col(c)), F.col(c)).alias(name)
    return out.select("run_id", "sequence", "json_path", own("_a", "expected"), own("_b", "actual")).where("expected IS NOT NULL OR actual IS NOT NULL")


def first_differences(found: DataFrame) -> DataFrame:
    """The first path that differs in each batch."""
    return found.groupBy("run_id", "sequence").agg(F.min_by(F.struct("json_path", "expected", "actual"), "json_path").alias("_f")).select("run_id", "sequence", "_f.*")
