"""Lists against lists: the least set of elements that moved, and an observed sequence against the expected steps.

Both work on runs of any length.  Ranks and running values come from ``numbering``.  What goes through Python is small: of two orders only
the stretches in which they disagree, of a sequence one function on the expected steps for each chunk of a run.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numbering


def heaviest_increasing(values: list[int], weights: list[int]) -> list[int]:
    """Places of the increasing subsequence with the greatest weight; of equal ones the one found first.

    The frontier holds, by last value, the best weights so far; a value extends the best one below it.
    """
    keys: list[int] = []
    best: list[tuple[int, int]] = []  # weight, place
    before = [-1] * len(values)
    for i, (v, w) in enumerate(zip(values, weights)):
        at = bisect.bisect_left(keys, v)
        total = w
        if at:
            total, before[i] = best[at - 1][0] + w, best[at - 1][1]
        if at < len(keys) and keys[at] == v and best[at][0] >= total:
            continue
        keys.insert(at, v)
        best.insert(at, (total, i))
        end = at + 1
        while end < len(keys) and best[end][0] <= total:
            end += 1
        del keys[at + 1 : end], best[at + 1 : end]
    out, i = [], best[-1][1] if best else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_g, _stretch of what stays of each piece; rows (_g, _piece, _stretch, _a, _w) come by piece, in the expected order.

    Pieces are many and mostly small, so a batch holds those of many; one that is longer than a batch goes on in the next.
    """
    now, values, weights, of = None, [], [], []
    for batch in batches:
        groups, stretches = [], []
        for g, piece, stretch, a, w in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (g, piece):
                kept = heaviest_increasing(values, weights)
                groups += [now[0] for _ in kept]
                stretches += [of[i] for i in kept]
                now, values, weights, of = (g, piece), [], [], []
            values.append(a)
            weights.append(w)
            of.append(stretch)
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(groups, kind), pa.array(stretches, pa.int64())], names=["_g", "_stretch"])
    if now is not None:
        kept = heaviest_increasing(values, weights)
        yield pa.RecordBatch.from_arrays([pa.array([now[0] for _ in kept], kind), pa.array([of[i] for i in kept], pa.int64())], names=["_g", "_stretch"])


def moved(common: DataFrame, group: str, element: str, expected: str, actual: str, rows: int = numbering.ROWS) -> DataFrame:
    """group, element of the fewest elements that must move to turn one order of a group's elements into the other.

    Elements next to each other in both orders are one stretch with a weight.  Where the first stretches of both orders are the same set,
    the lists are cut (nothing moves across).  The heaviest increasing subsequence of each piece stays, so the work in one task grows
    with what is out of order there, not with the lists.
    """
    one = numbering.numbered(common.select(F.col(group).alias("_g"), F.col(element).alias("_x"), F.col(expected).alias("_pe"), F.col(actual).alias("_pa")), "_g", "_pe", "_x", into="_re", rows=rows)
    both = numbering.numbered(one, "_g", "_pa", "_x", into="_ra", rows=rows).select("_g", "_x", "_re", "_ra")
    before = both.select("_g", (F.col("_re") + 1).alias("_re"), F.col("_ra").alias("_prev"))
    laid = numbering.laid_out(both.join(before, ["_g", "_re"], "left"), "_g", "_re", rows=rows)
    begins = F.when(F.col("_ra") == F.col("_prev") + 1, 0).otherwise(1)
    placed = numbering.dropped(numbering.running(laid, "_g", {"_stretch": begins})).select("_g", "_x", "_re", "_ra", "_stretch")
    stretches = placed.groupBy("_g", "_stretch").agg(F.min("_re").alias("_e"), F.min("_ra").alias("_a"), F.count("*").alias("_w"))
    rows_ = numbering.laid_out(stretches, "_g", "_e", rows=rows)
    reach = numbering.running(rows_, "_g", maxima={"_reach": F.col("_a") + F.col("_w")})
    cut = (F.col("_reach") == F.col("_e") + F.col("_w")).cast("int")
    pieces = numbering.dropped(numbering.running(reach, "_g", {"_cuts": cut})).withColumn("_piece", F.col("_cuts") - cut)
    settled = pieces.select("_g", "_stretch", "_e", "_a", "_w", "_piece")
    single = settled.groupBy("_g", "_piece").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    tangled = settled.join(single, ["_g", "_piece"], "left_semi")
    kind = common.schema[group].dataType
    schema = T.StructType([T.StructField("_g", kind), T.StructField("_stretch", T.LongType())])
    laid_by_piece = tangled.repartition("_g", "_piece").sortWithinPartitions("_g", "_piece", "_e")
    stays = laid_by_piece.select("_g", "_piece", "_stretch", "_a", "_w").mapInArrow(_stay, schema)
    goes = tangled.select("_g", "_stretch").join(stays, ["_g", "_stretch"], "left_anti")
    return placed.join(goes, ["_g", "_stretch"], "left_semi").select(F.col("_g").alias(group), F.col("_x").alias(element))


def order_changes(expected: DataFrame, actual: DataFrame, group: str, element: str, position: str, rows: int = numbering.ROWS) -> DataFrame:
    """group, element, change: inserted, deleted, repeated (in the actual list), moved.  Null groups and elements take no part."""
    first = lambda df, c: df.where(F.col(group).isNotNull() & F.col(element).isNotNull()).groupBy(group, element).agg(F.min(position).alias(c), F.count("*").alias(f"{c}_n"))
    e, a = first(expected, "_pe"), first(actual, "_pa")
    row = lambda df, change: df.select(group, element, F.lit(change).alias("change"))
    out = row(e.join(a, [group, element], "left_anti"), "deleted").unionByName(row(a.join(e, [group, element], "left_anti"), "inserted")).unionByName(row(a.where("_pa_n > 1"), "repeated"))
    return out.unionByName(row(moved(e.join(a, [group, element]), group, element, "_pe", "_pa", rows), "moved"))


def field_changes(expected: DataFrame, actual: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """keys, field, expected, actual: fields of elements in both tables that differ (policies, reasons); nulls are values."""
    a = actual.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"_{f}").cast("string").alias("actual")) for f in fields]))
    return expected.join(a, keys).select(*keys, each.alias("d")).select(*keys, "d.*").where(~F.col("expected").eqNullSafe(F.col("actual")))


def steps_table(steps: list[tuple[str, bool]]) -> dict[str, list[int]]:
    """name -> for each next expected step the place it matches, -1 if it doesn't; only optional steps are skipped."""
    out = {}
    for name in {n for n, _ in steps}:
        row = []
        for s in range(len(steps) + 1):
            j = s
            while j < len(steps) and steps[j][0] != name and steps[j][1]:
                j += 1
            row.append(j if j < len(steps) and steps[j][0] == name else -1)
        out[name] = row
    return out


def matched_steps(observed: DataFrame, run: str, order: str, name: str, ok: str, steps: list[tuple[str, bool]], rows: int = numbering.ROWS) -> DataFrame:
    """run, n_observed, matched: array of (step, ok) of the expected steps (name, optional) that each run's rows, in order, match.

    Every row is a function on the next expected step.  A task folds a chunk's rows for each step that the chunk could begin
    with, so chunks of one run are folded at once and then joined in order; a run has at most one row for each chunk there.
    """
    table, n = steps_table(steps), len(steps)
    laid = numbering.laid_out(observed.select(F.col(run).alias("run"), F.col(order).alias("_o"), F.col(name).cast("string").alias("name"), F.coalesce(F.col(ok), F.lit(False)).alias("ok")), "run", "_o", rows=rows)
    kind = laid.schema["run"].dataType
    schema = T.StructType([T.StructField("run", kind), *T.StructType.fromDDL("chunk long, seen long, ends array<int>, matched array<array<struct<step:int,ok:boolean>>>").fields])
    inner = pa.struct([("step", pa.int32()), ("ok", pa.bool_())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, kind, seen, state, found = None, None, None, 0, [], []

        def made() -> pa.RecordBatch:
            columns = [pa.array([now], kind), pa.array([chunk], pa.int64()), pa.array([seen], pa.int64()), pa.array([state], pa.list_(pa.int32())), pa.array([found], pa.list_(pa.list_(inner)))]
            return pa.RecordBatch.from_arrays(columns, names=["run", "chunk", "seen", "ends", "matched"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, item, good, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not seen or own != now or part != chunk:
                    if seen:
                        yield made()
                    now, chunk, seen, state, found = own, part, 0, list(range(n + 1)), [[] for _ in range(n + 1)]
                seen += 1
                to = table.get(item)
                if to:
                    for s, at in enumerate(state):
                        if to[at] >= 0:
                            found[s].append({"step": to[at], "ok": good})
                            state[s] = to[at] + 1
        if seen:
            yield made()

    # rows of a chunk lie in one file in their order; a task that reads parts of several files sees their chunks one after another
    ordered = laid.repartition(numbering.CHUNK).sortWithinPartitions(numbering.CHUNK, numbering.AT).select("run", "name", "ok", numbering.CHUNK)
    parts = ordered.mapInArrow(fold, schema)
    chunks = parts.groupBy("run").agg(F.sum("seen").alias("n_observed"), F.array_sort(F.collect_list(F.struct("chunk", "ends", "matched"))).alias("parts"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<step:int,ok:boolean>>").alias("found"))
    joined = F.aggregate("parts", none, lambda acc, x: F.struct(F.element_at(x["ends"], acc["at"] + 1).alias("at"), F.concat(acc["found"], F.element_at(x["matched"], acc["at"] + 1)).alias("found")))
    return chunks.select(F.col("run").alias(run), "n_observed", joined["found"].alias("matched"))


def sequence_report(matches: DataFrame, run: str, steps: list[tuple[str, bool]]) -> DataFrame:
    """run, n_matched, n_extra, missing, failed (names of required steps, in order, joined), status.

    Steps that failed or never came block a run if they are required; optional ones don't.
    """
    places = F.transform("matched", lambda x: x["step"])
    bad = F.transform(F.filter("matched", lambda x: ~x["ok"]), lambda x: x["step"])
    required = [(i, name) for i, (name, optional) in enumerate(steps) if not optional]
    pick = lambda holds: F.array_compact(F.array(*[F.when(holds(i), F.lit(f"{i}:{name}")) for i, name in required]))
    missing, failed = pick(lambda i: ~F.array_contains(places, i)), pick(lambda i: F.array_contains(bad, i))
    blocked = (F.size(missing) > 0) | (F.size(failed) > 0)
    return matches.select(run, F.size("matched").cast("long").alias("n_matched"), (F.col("n_observed") - F.size("matched")).alias("n_extra"), F.array_join(missing, ",").alias("missing"), F.array_join(failed, ",").alias("failed"), F.when(blocked, "blocked").otherwise("passed").alias("status"))
