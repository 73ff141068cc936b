"""Mixing sources to target weights.

The words of a source, its documents one after another, are packed into blocks of a fixed length.  The mix is a row of
output shards with a fixed number of slots; for every shard the slots of each source are a multinomial draw.  A source's
slots are numbered through all shards; slot j holds block p(j) where p is a pseudorandom permutation of the source's
blocks, another one for each pass over the source.  Slots and blocks meet in a join by source and block number.

A source's number of slots follows from its target (weights share all words; no target exceeds ``CAP`` times its source,
the excess goes to the others by weight): what the draws give beyond it is cut, what they leave open fills a last shard,
and the last slot takes only the words that are still missing.  So a source's words are its target to the nearest word,
and no document is taken more often than ``CAP`` times.  All draws come from keyed counters: a rerun gives the same mix.

Defined results: null or empty texts have size 0 and nothing is taken from them; a null source is a source, after all
others; rows that repeat are documents of their own (those with equal doc_id and size are exchangeable); an empty table
gives an empty result.  Source sums are read by the driver: one row for each source, with an error beyond ``SOURCES``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAP = 3  #: times that a source, and so each of its documents, may be taken at most
BLOCK = 256  #: words in a block
SLOTS = 1024  #: slots in an output shard
SOURCES = 100_000
CHUNK_ROWS = 20_000  #: documents of a source that are lined up in one task
SEED = 20240607

U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _round(x: np.ndarray, key: np.ndarray, n: np.ndarray, back: bool) -> np.ndarray:
    """A Feistel network on the smallest even number of bits that hold n; several n at once."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(U64)
    mask = (U64(1) << half) - U64(1)
    left, right = x >> half, x & mask
    for i in reversed(range(6)) if back else range(6):
        if back:
            left, right = right ^ (_mixed(left + key + U64(i * 0x9E3779B9)) & mask), left
        else:
            left, right = right, left ^ (_mixed(right + key + U64(i * 0x9E3779B9)) & mask)
    return (left << half) | right


def permuted(at: np.ndarray, key: np.ndarray, n: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts ``at`` (or what it puts there, ``back``): the network again until the value is below n."""
    at, key, n = (np.asarray(x).astype(U64) for x in (at, key, n))
    out = _round(at, key, n, back)
    while (out_of := np.flatnonzero(out >= n)).size:
        out[out_of] = _round(out[out_of], key[out_of], n[out_of], back)
    return out.astype(np.int64)


def key_of(rank: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """The key of a source's permutation in one of its passes."""
    return _mixed(_mixed(np.asarray(rank).astype(U64) + U64(seed)) + np.asarray(turn).astype(U64))


def targets(sizes: list[int], weights: list[float], share: float = 1.0, cap: float = CAP) -> list[float]:
    """Share all words by weight; targets stop at ``cap`` times the source, the excess goes to the others by weight."""
    out, total = [0.0] * len(sizes), share * sum(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        left = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)
        by = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * by > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * by
            break
        open_ -= full
        for i in full:
            out[i] = float(cap * sizes[i])
    return out


@dataclasses.dataclass
class Plan:
    """One source: its words, target, blocks, slots, and the words of its last slot."""

    rank: int
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def plan(rank: int, size: int, target: float, block: int, seed: int) -> Plan:
    """Turn a target into slots: whole passes, then as many slots of one more as the rest needs."""
    blocks, want = -(-size // block), round(target)
    if not want:
        return Plan(rank, size, target, blocks, 0, 0)
    turn, rest = divmod(want, size)
    if not rest:  # the last slot is a whole block of the last pass
        return Plan(rank, size, target, blocks, turn * blocks, block)
    tail = size - (blocks - 1) * block
    one = np.ones(1, np.int64)
    short_at = int(permuted(one * (blocks - 1), key_of(one * rank, one * turn, seed), one * blocks, back=True)[0])
    held = lambda m: m * block - (block - tail) * (short_at < m)  # noqa: E731  words in m slots of this pass
    slots = rest // block
    while held(slots) < rest:
        slots += 1
    return Plan(rank, size, target, blocks, turn * blocks + slots, rest - held(slots - 1))


def lined_up(docs: DataFrame, size: str = "size") -> DataFrame:
    """Add ``begins``: the words of the same source before this document, in an order fixed by doc_id and size.

    Chunks of a source are dealt by a hash, summed, and only a chunk's own rows meet in one task.
    """
    n = docs.count()
    chunks = max(1, -(-n // CHUNK_ROWS)) * 4
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", size), F.lit(chunks)))
    by = Window.partitionBy("rank")
    before = by.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("rank", "chunk").agg(F.sum(size).alias("words")).select("rank", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_begins"))
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(sums, ["rank", "chunk"]).withColumn("begins", F.col("chunk_begins") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("chunk", "chunk_begins")


def drawn_slots(docs: DataFrame, plans: list[Plan], slots: int, seed: int) -> DataFrame:
    """rank, shard, first, number: which of a source's slots each shard holds."""
    spark = docs.sparkSession
    total = sum(p.slots for p in plans)
    shards = -(-total // slots)
    share = np.array([p.slots for p in plans], float) / max(total, 1)
    ranks = np.array([p.rank for p in plans])

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                counts = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(slots, share)
                yield pd.DataFrame({"rank": ranks, "shard": shard, "number": counts})

    draws = spark.range(shards, numPartitions=max(1, -(-shards // 1000))).mapInPandas(draw, "rank int, shard long, number long")
    known = spark.createDataFrame([(p.rank, p.slots) for p in plans], "rank int, slots long")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("number").over(before), F.lit(0))
    cut = draws.join(F.broadcast(known), "rank").withColumn("first", first).withColumn("number", F.least("number", F.greatest(F.lit(0), F.col("slots") - F.col("first"))))
    done = cut.groupBy("rank").agg(F.sum("number").alias("done"))  # the draws of a source cover 0..done-1
    rest = F.broadcast(known).join(done, "rank").select("rank", F.lit(shards).cast("long").alias("shard"), F.col("done").alias("first"), (F.col("slots") - F.col("done")).alias("number"))
    return cut.select("rank", "shard", "first", "number").unionByName(rest).where("number > 0")


def blocks_of_slots(ranges: DataFrame, plans: list[Plan], seed: int) -> DataFrame:
    """One row for each slot: rank, block, and the words that are taken from the block's beginning."""
    known = {p.rank: p for p in plans}
    blocks = np.zeros(max(known, default=0) + 1, np.int64)
    slots, last = blocks.copy(), blocks.copy()
    for r, p in known.items():
        blocks[r], slots[r], last[r] = p.blocks, p.slots, p.last

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rank, j = part["rank"].to_numpy(np.int64), part["slot"].to_numpy(np.int64)
            n = blocks[rank]
            block = permuted(j % n, key_of(rank, j // n, seed), n)
            yield pd.DataFrame({"rank": rank, "block": block, "words": np.where(j == slots[rank] - 1, last[rank], np.iinfo(np.int64).max)})

    rows = ranges.select("rank", F.explode(F.sequence("first", F.col("first") + F.col("number") - 1)).alias("slot"))
    return rows.mapInPandas(find, "rank int, block long, words long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK, slots: int = SLOTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs`` (doc_id, source, text).

    Sources by code point, null last, have the weights in turn.
    """
    sized = common.settled(docs.select("doc_id", "source", common.words(F.col("text")).alias("size")), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(SOURCES + 1).collect()
    if len(sums) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sums = sorted(sums, key=lambda r: (r.source is None, (r.source or "").encode()))
    share = [weights[i % len(weights)] for i in range(len(sums))]
    aims = targets([r.source_size for r in sums], share, cap=cap)
    plans = [plan(i, r.source_size, t, block, seed) for i, (r, t) in enumerate(zip(sums, aims))]
    spark = docs.sparkSession
    sources = spark.createDataFrame([(p.rank, r.source, p.size, p.target) for p, r in zip(plans, sums)], "rank int, source string, source_size long, target double")
    sized = sized.join(F.broadcast(sources.withColumnRenamed("source", "own_source")), F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    lined = common.settled(lined_up(sized), "mix-lined")
    end = F.col("begins") + F.col("size")
    piece = (
        lined.where("size > 0")
        .select("rank", "begins", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begins") / block), F.floor((end - 1) / block))).alias("block"))
        .select("rank", "begins", "block", (F.greatest("begins", F.col("block") * block) - F.col("block") * block).alias("low"), (F.least("end", (F.col("block") + 1) * block) - F.col("block") * block).alias("high"))
    )
    taken = piece.join(blocks_of_slots(drawn_slots(docs, [p for p in plans if p.slots], slots, seed), plans, seed), ["rank", "block"]).groupBy("rank", "begins").agg(F.sum(F.greatest(F.lit(0), F.least("high", "words") - F.col("low"))).alias("taken"))
    # rows of size 0 begin where another may begin; nothing is taken from them
    with_words = lined.where("size > 0").join(taken, ["rank", "begins"], "left")
    out = with_words.unionByName(lined.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def whole_documents(mixed: DataFrame) -> DataFrame:
    """doc_id, source, size, copies: how often a mix of whole documents has each, from the rows of ``mix``.

    A document is there as many whole times as the mix takes it; which ones are there once more follows from running sums of
    the fractions that are left, by size in each source, rounded where they pass a half.  So a source's words differ from
    its target by about its largest document.  Rows of equal doc_id, source and size are treated alike; documents without words
    stay once.
    """
    unit = 1 << 20
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # no null, so it can be joined
    rows = mixed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"), F.sum("taken").alias("taken")).withColumn("own", source)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / (F.col("m") * F.col("size")))).otherwise(1)
    rows = rows.withColumn("whole", whole.cast("long"))
    left = F.when(F.col("size") > 0, F.floor((F.col("taken") - F.col("whole") * F.col("m") * F.col("size")) * unit / F.col("size"))).otherwise(0)
    rows = common.settled(rows.withColumn("left", left.cast("long")), "mix-fractions")
    n = rows.count()
    chunks = rows.groupBy("own", "size").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    rows = common.settled(rows.join(common.narrow(chunks), ["own", "size"]).withColumn("chunk", chunk).drop("chunks"), "mix-chunks", rows=n)
    before = Window.partitionBy("own").orderBy("size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("own", "size", "chunk").agg(F.sum("left").alias("sum")).select("own", "size", "chunk", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("own", "size", "chunk").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("first") + F.coalesce(F.sum("left").over(inside), F.lit(0)) + unit // 2
    once_more = F.floor((F.col("begins") + F.col("left")) / unit) - F.floor(F.col("begins") / unit)
    out = rows.join(sums, ["own", "size", "chunk"]).withColumn("begins", begins)
    return out.select("doc_id", "source", "size", (F.col("whole") + F.round(once_more / F.col("m"))).cast("int").alias("copies"))
