"""Live runs: results once, the state of each run, and alerts for runs that stand still."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STAGE_SECONDS = 120  #: without a result before a run counts as stuck
STATE = "chain_head string, n_events long, last_order long, last_stage string"
OUT = "run_id string, chain_head string, n_events long, last_order long, last_stage string, alert string"


def once(results: DataFrame, key: str = "key", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each idempotency key once; keys are forgotten when the watermark has passed them."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head, n, last, stage = state.get if state.exists else ("", 0, -1, None)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], head, n, last, stage, "stuck")], columns=[c.split()[0] for c in OUT.split(", ")])
        return
    rows = pd.concat(list(parts)).sort_values("order")
    newest = rows["ts"].max()
    gap = None
    for order, content, name in zip(rows["order"], rows["content"], rows["stage"]):
        if order <= last:
            gap = "late"  # its place in the chain is taken
            continue
        head = hashlib.sha256(f"{head}/{content}".encode()).hexdigest()
        n, last, stage = n + 1, int(order), name
    state.update((head, n, last, stage))
    state.setTimeoutTimestamp(int(newest.timestamp() * 1000) + STAGE_SECONDS * 1000)
    yield pd.DataFrame([(key[0], head, n, last, stage, gap)], columns=[c.split()[0] for c in OUT.split(", ")])


def track(results: DataFrame, late: str = "0 seconds") -> DataFrame:
    """State of each run after each batch (run_id, order, stage, content, ts): head of its hash chain, number of results, last stage.

    An event-time timer turns a run without results into an alert; a result out of order is told, not folded in.
    """
    rows = results.withWatermark("ts", late)
    return rows.groupBy("run_id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def gate_counts(results: DataFrame, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Results by window and kind; tumbling, or sliding with ``slide``.  ``late`` is None where the results have a watermark already."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    rows = results if late is None else results.withWatermark(time, late)
    return rows.groupBy(window.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def sessions(results: DataFrame, key: str, time: str = "ts", silence: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each key's sessions: results with less than ``silence`` between them; start, end (of the last result), n.

    A session is given once, when the watermark has passed its end (append mode); late results merge sessions before that.
    """
    rows = results.withWatermark(time, late)
    w = F.session_window(time, silence)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")
