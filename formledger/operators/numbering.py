"""Numbers and running values within runs, however many rows one run has.

Rows are ordered by run and place over range partitions of about ``ROWS`` rows, so a run with most of the rows lies in
many of them, its chunks.  A running value is that of the row's chunk (a window over chunk and run) and what the run's chunks
before add: one row for each chunk of a run, so a run has at most as many as there are partitions.  No task
sees more than some chunks.  The laid-out rows are written once; ranges come from samples, so a second shuffle might cut elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

ROWS = 1_000_000  #: of a chunk
CHUNK, AT = "_chunk", "_at"


def laid_out(df: DataFrame, run: str, *order: str | Column, rows: int = ROWS) -> DataFrame:
    """The rows with their chunk and their place in it, by run and order."""
    n = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(n, run, *order).sortWithinPartitions(run, *order)
    return settled(cut.withColumn(AT, F.monotonically_increasing_id()).withColumn(CHUNK, F.shiftright(AT, 33)), "laid-out")


def running(rows: DataFrame, run: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums and maxima within each run, the row itself included; a maximum without values so far is null."""
    sums, maxima = sums or {}, maxima or {}
    here = Window.partitionBy(run, CHUNK).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()], *[F.max(c).over(here).alias(f"_m_{n}") for n, c in maxima.items()])
    totals = rows.groupBy(run, CHUNK).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()])
    before = Window.partitionBy(run).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(run).alias("_run"), F.col(CHUNK).alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(n).over(before).alias(f"_b_{n}") for n in maxima]
    )
    met = local.join(offsets, F.col(run).eqNullSafe(F.col("_run")) & (F.col(CHUNK) == F.col("_of")))
    own = [(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums] + [F.greatest(f"_m_{n}", f"_b_{n}").alias(n) for n in maxima]
    return met.select(*rows.columns, *own)


def dropped(rows: DataFrame) -> DataFrame:
    return rows.drop(CHUNK, AT)


def numbered(df: DataFrame, run: str, *order: str | Column, into: str = "nth", rows: int = ROWS) -> DataFrame:
    """Add each row's number in its run, from 1."""
    return dropped(running(laid_out(df, run, *order, rows=rows), run, {into: F.lit(1)}))


def batched(operations: DataFrame, run: str, order: str, alone: str, size: int, rows: int = ROWS) -> DataFrame:
    """Add batch and position: at most ``size`` operations in order; one marked ``alone`` stands alone and closes the open batch.

    Three running values: how many weren't alone, and how many of these there were at the last one alone, tell where a batch
    begins; the beginnings' sum is the batch, the number of rows since the last beginning the position.
    """
    single = F.coalesce(F.col(alone), F.lit(False))
    laid = laid_out(operations.withColumn("_alone", single), run, order, rows=rows)
    joined = F.when(F.col("_alone"), 0).otherwise(1)
    first = running(running(laid, run, {"_n": F.lit(1), "_joined": joined}), run, maxima={"_last": F.when(F.col("_alone"), F.col("_joined"))})
    begins = F.col("_alone") | ((F.col("_joined") - F.coalesce("_last", F.lit(0)) - 1) % size == 0)
    second = running(first.withColumn("_begins", begins), run, {"batch": F.col("_begins").cast("int")}, {"_from": F.when(F.col("_begins"), F.col("_n"))})
    position = F.col("_n") - F.col("_from") + 1
    return dropped(second.withColumn("position", position)).drop("_alone", "_n", "_joined", "_last", "_begins", "_from")
