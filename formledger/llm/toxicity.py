"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 5 characters, lower case, white space as one blank) of the whole text, hashed to
``2**BITS`` buckets.  Fitting takes a bounded sample of labelled rows (at most ``SAMPLE``; the rows with the smallest hash of
their id, so every run takes the same): the log-count ratio of each bucket, the ``KEPT`` buckets that tell the classes
apart best, and a logistic regression on presence times ratio.  Both steps run in a task each; the driver
only holds weights.  Scoring needs a table of 2**BITS floats in each worker.

Defined results: null and empty texts have no n-grams and get the score of the bias; the score depends on the text alone,
so copies score alike; rows may repeat; with no labelled row, or one class only, every score is the share of label 1
(0 without rows); a null label is no label.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZES = (3, 4, 5)
BITS = 20
SAMPLE = 10_000  #: labelled rows that a fit takes at most
KEPT = 4_000  #: buckets with a weight
SMOOTHING, PENALTY, ROUNDS = 1.0, 0.3, 300
BLOCK_ROWS = 500
PARTS = 4  #: tasks that count the sample's n-grams
CHUNK = 1 << 19  #: characters that are hashed at once

U32 = np.uint32
#: Odd multipliers, one for each place in an n-gram.
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], U32)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, with repeats, a bounded number at a time."""
    clean = " " + " ".join(text.lower().split()) + " "
    if len(clean) < 3:
        return
    longest = max(SIZES)
    for at in range(0, len(clean), CHUNK):
        window = clean[at : at + CHUNK + longest - 1]
        c = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), U32)
        total = np.zeros(len(c), U32)
        for i in range(longest):
            n = len(c) - i
            if n <= 0:
                break
            total = total[:n] + (c[i:] + U32(1)) * PLACES[i]
            if i + 1 in SIZES:
                own = total[:CHUNK]
                mixed = (own ^ (own >> U32(15))) * U32(0x2C1B3C6D + 2 * i)
                yield mixed >> U32(32 - BITS)


class Distinct:
    """Each bucket once for a text, without sorting: of the places that write to a bucket's cell one finds its own number there."""

    def __init__(self):
        self.cell = np.zeros(1 << BITS, np.int32)

    def of(self, found: np.ndarray) -> np.ndarray:
        numbers = np.arange(len(found), dtype=np.int32)
        self.cell[found] = numbers
        return found[self.cell[found] == numbers]


@dataclasses.dataclass
class Model:
    """``weight``: by bucket, the regression's weight times the log-count ratio."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        kept, distinct = self.weight != 0, Distinct()
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            found = [b[kept[b]] for b in buckets(text)] if text else []
            own = distinct.of(np.concatenate(found)) if found else np.empty(0, np.int64)
            out[k] = self.bias + np.sort(self.weight[own]).sum()  # in one order, so equal texts agree to the last bit
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def _regression(begins: np.ndarray, columns: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on sparse rows, both classes of equal weight, by gradient steps with momentum.

    Row i has the columns from begins[i] to begins[i + 1]; a column's value is its ratio.  Rows are taken in blocks, so a step needs
    little more memory than the columns themselves.
    """
    n, width = len(y), len(ratio)
    blocks = [np.arange(i, min(i + BLOCK_ROWS, n)) for i in range(0, n, BLOCK_ROWS)]
    square = float((ratio[columns[:1_000_000]] ** 2).sum()) / max(1, np.searchsorted(begins, 1_000_000) if len(columns) > 1_000_000 else n) + 1
    w, v, bias, bias_v = np.zeros(width), np.zeros(width), 0.0, 0.0
    rate = 4 / square
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    lines = [np.repeat(np.arange(len(r), dtype=np.int32), np.diff(begins[r[0] : r[-1] + 2])) for r in blocks]
    for _ in range(ROUNDS):
        ahead, ahead_bias = w + 0.9 * v, bias + 0.9 * bias_v
        by_value, gradient, slope = ratio * ahead, PENALTY / n * ahead, 0.0
        for r, line in zip(blocks, lines):
            own = columns[begins[r[0]] : begins[r[-1] + 1]]
            z = np.bincount(line, by_value[own], len(r)) + ahead_bias
            error = even[r] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[r])
            gradient += ratio * np.bincount(own, error[line], width) / n
            slope += float(error.sum()) / n
        v, bias_v = 0.9 * v - rate * gradient, 0.9 * bias_v - rate * slope
        w, bias = w + v, bias + bias_v
    return w, bias


def sample(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled ids, those with the smallest hash; a repeated id counts once."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    once = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return once.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    chosen = sample(labels, id_col, label, rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    texts = common.settled(texts.select("y", "t").repartition(PARTS), "toxic-sample")  # a bounded sample in a few files

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n, distinct = np.zeros((2, 1 << BITS), np.int32), [0, 0], Distinct()
        for part in parts:
            for y, t in zip(part["y"].tolist(), part["t"]):
                n[y] += 1
                if found := list(buckets(t)):
                    counts[y, distinct.of(np.concatenate(found))] += 1
        if sum(n):
            yield pd.DataFrame({"label": [0, 1], "rows": n, "counts": [c.tobytes() for c in counts]})

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2)
        for part in parts:
            for r in part.itertuples():
                counts[r.label] += np.frombuffer(r.counts, np.int32)
                n[r.label] += r.rows
        kept, ratio = _chosen(counts, n) if n.all() else (np.empty(0, np.int64), np.empty(0))
        yield pd.DataFrame({"n0": [n[0]], "n1": [n[1]], "kept": [kept], "ratio": [ratio]})

    # a few arrays of a fixed size meet in one task; the driver gets the buckets that it keeps
    few = texts.coalesce(PARTS).mapInPandas(count, "label int, rows long, counts binary")
    chosen = few.repartition(1).mapInPandas(choose, "n0 double, n1 double, kept array<long>, ratio array<double>").first()
    n = (chosen.n0, chosen.n1) if chosen else (0.0, 0.0)
    if not all(n):
        share = n[1] / sum(n) if sum(n) else 0.0
        return Model(np.zeros(1 << BITS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    kept, ratio = np.array(chosen.kept, np.int64), np.array(chosen.ratio)
    if not len(kept):
        return Model(np.zeros(1 << BITS), float(np.log(n[1] / n[0])))

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, distinct = np.full(1 << BITS, -1, np.int32), Distinct()
        place[kept] = np.arange(len(kept))
        for part in parts:
            own = []
            for t in part["t"]:
                found = [place[b] for b in buckets(t)]
                found = [x[x >= 0] for x in found]
                own.append(np.sort(distinct.of(np.concatenate(found))).astype(np.int32).tobytes() if found else b"")
            yield pd.DataFrame({"y": part["y"], "own": own})

    def regress(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(y, own) for part in parts for y, own in zip(part["y"].tolist(), part["own"])]
        got.sort()  # in one order, whatever the partitions
        begins = np.cumsum([0] + [len(own) // 4 for _, own in got])
        w, bias = _regression(begins, np.frombuffer(b"".join(own for _, own in got), np.int32), ratio, np.array([y for y, _ in got], float))
        yield pd.DataFrame({"w": [w * ratio], "bias": [bias]})

    # the sample is bounded, so one task fits it; the driver gets KEPT weights
    fitted = texts.mapInPandas(features, "y int, own binary").repartition(1).mapInPandas(regress, "w array<double>, bias double").first()
    weight = np.zeros(1 << BITS)
    weight[kept] = fitted.w
    return Model(weight, fitted.bias)


def _chosen(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart best, and their log-count ratios."""
    # the share of each class's documents that hold a bucket, its log ratio, and how sure the difference is
    p, q = ((counts[y] + SMOOTHING) / (n[y] + 2 * SMOOTHING) for y in (1, 0))
    both = (counts[0] + counts[1] + SMOOTHING) / (n.sum() + 2 * SMOOTHING)
    sure = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    sure[counts.sum(0) < 3] = 0
    kept = np.sort(np.argsort(-sure, kind="stable")[:KEPT])
    kept = kept[sure[kept] > 2.5]
    return kept, np.log(p / q)[kept]


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    kept = np.flatnonzero(model.weight).astype(np.int32)
    packed = df.sparkSession.sparkContext.broadcast((kept, model.weight[kept], model.bias))  # KEPT numbers at most

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, values, bias = packed.value
        weight = np.zeros(1 << BITS)
        weight[own] = values
        model = Model(weight, bias)
        for part in parts:
            yield pd.Series(model.scores(part.tolist()))

    return df.withColumn(common.fresh(df, into)[0], run(F.coalesce(F.col(text), F.lit(""))))


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from fitting: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
