"""Ranked lexical search: MaxScore whose bounds come from pairs of terms.

Documents become narrow rows: their number of terms, and which terms of the queries they hold how often.  Counts over all of these give
the weights.  Then tasks read the rows in shards of ``POSTINGS`` postings.  A shard holds, for each term, the list of its documents
with their impacts and the largest impact; and for pairs of terms, the intersection of two lists with the largest joint impact.
A query takes its terms in order of their largest impacts, two by two.  What the terms from some place on can add to a
document is bounded by the sum over their pairs of max(joint impact, either impact alone), well below the sum of the
terms' maxima where rare terms don't meet.  Once that bound is below the worst of the best scores so far (known from the
shards before, and from partial sums), no further document can enter: the rest of the lists is only looked up for
candidates, which leave as soon as their sum and the bound of what is left fall below.  Ties are never skipped.  Each task
emits its best for each query, Spark ranks those.

Queries come in blocks of ``PAIRS`` terms, so what goes to the tasks is bounded; each block reads the documents once.

Defined results: a null or empty text, or one of separators alone, is no document and as a query has no result; an item's terms are those of all
rows with its id; rows of documents may repeat, each is ranked, null ids come last among equals; scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

# Terms and the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FLAT, SHARE = 50, 50  #: parts of 100 of a document's length norm

TOP = 50
PAIRS = 200_000  #: of an item and a term in one block of queries
POSTINGS = 2_000_000  #: of a shard
DOCS_A_TASK = 10_000  #: at least, so what tasks emit stays small beside what they read

#: Bytes as terms see them: letters and digits, capitals as small ones, everything else in ASCII a space.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def items_of(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """item, term: each term of each item once."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return queries.select(F.col(id_col).alias("item"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """id, n, terms, counts of each document that has a term; ``terms`` are the numbers of those of the vocabulary."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("n long, terms array<int>, counts array<int>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            sizes, ends, numbers, counts, kept = [], [0], [], [], []
            for i, value in enumerate(batch.column(1)):
                own = terms(value.as_py())
                if not own:
                    continue
                known, often = np.unique(np.fromiter((x for x in map(get, own) if x is not None), np.int32), return_counts=True)
                kept.append(i)
                sizes.append(len(own))
                numbers.append(known)
                counts.append(often.astype(np.int32))
                ends.append(ends[-1] + len(known))
            flat = lambda parts: pa.array(np.concatenate([np.empty(0, np.int32), *parts]))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, flat(p)) for p in (numbers, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(read, schema)


class Shard:
    """Lists of documents by term, with impacts; documents are numbered in the order of their ids."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, numbers: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        docs = np.repeat(np.arange(len(n)), np.diff(ends))
        norm = (100 - FLAT + (SHARE * n.astype(np.int64) * n_docs) // total)[docs]
        tf = counts.astype(np.int64)
        impact = weights[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm))
        order = np.argsort(numbers, kind="stable")
        self.docs, self.impacts = docs[order], impact[order]
        self.begins = np.searchsorted(numbers[order], np.arange(len(weights) + 1))
        self.n_docs = len(n)
        self.largest = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.begins))
        if len(held):
            self.largest[held] = np.maximum.reduceat(self.impacts, self.begins[held])
        self.joint: dict[tuple[int, int], int] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.begins[term], self.begins[term + 1]
        return self.docs[a:z], self.impacts[a:z]

    def looked_up(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The term's impact in each of some documents, 0 where it isn't."""
        listed, impacts = self.of(term)
        at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
        return np.where(listed[at] == docs, impacts[at], 0)

    def pair(self, a: int, b: int) -> int:
        """The most that two terms add to a document: jointly where their lists meet, else alone."""
        key = (a, b) if a < b else (b, a)
        if key not in self.joint:
            short, long = sorted(key, key=lambda t: self.begins[t + 1] - self.begins[t])
            docs, impacts = self.of(short)
            other = self.looked_up(long, docs)
            met = other > 0
            self.joint[key] = int((impacts[met] + other[met]).max(initial=0))
        return max(self.joint[key], int(self.largest[a]), int(self.largest[b]))

    def bounds(self, ordered: list[int]) -> list[int]:
        """What the terms from each place on can add; the last is 0."""
        out = [0] * (len(ordered) + 1)
        for i in range(len(ordered) - 1, -1, -1):
            paired = i % 2 == 0 and i + 1 < len(ordered)
            out[i] = out[i + 2] + self.pair(ordered[i], ordered[i + 1]) if paired else out[i + 1] + int(self.largest[ordered[i]])
        return out

    def best(self, query: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may be among the ``top`` best, none of a score below ``floor``, which must be 1 or more."""
        largest = self.largest[query]
        ordered = query[np.lexsort((query, -largest))][: int((largest > 0).sum())].tolist()
        bound = self.bounds(ordered)
        sums, i = np.zeros(self.n_docs, np.int64), 0
        seen = 0
        while i < len(ordered) and bound[i] >= floor:
            docs, impacts = self.of(ordered[i])
            sums[docs] += impacts
            seen += len(docs)
            i += 1
            if seen >= top and (i % 4 == 0 or bound[i] < 2 * floor) and self.n_docs > top:
                floor = max(floor, int(np.partition(sums, -top)[-top]))
        docs = np.flatnonzero((sums > 0) & (sums + bound[i] >= floor))
        scores = sums[docs]
        for j in range(i, len(ordered)):
            scores = scores + self.looked_up(ordered[j], docs)
            if len(docs) > top:
                floor = max(floor, int(np.partition(scores, -top)[-top]))
            left = scores + bound[j + 1] >= floor
            docs, scores = docs[left], scores[left]
        if len(docs) > top:
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
        left = scores >= floor
        return docs[left], scores[left]


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("terms").flatten())
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _block(docs: DataFrame, pairs: DataFrame, id_col: str, text: str, top: int) -> DataFrame:
    """item, id, score of one block of queries: the best of each task."""
    kind = pairs.schema["item"].dataType
    rows = pairs.collect()  # at most some PAIRS of them
    vocabulary = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r.item, []).append(vocabulary[r.term])
    items = [(item, np.array(sorted(found), np.int64)) for item, found in by_item.items()]
    held = common.settled(postings(docs, {t.encode(): i for t, i in vocabulary.items()}, id_col, text), "search-postings")
    n_docs, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row a term of the block
        weights[r.t] = weight(n_docs, r.df)
    id_kind = held.schema["id"].dataType
    items_type = pairs.limit(0).toArrow().schema.field("item").type
    schema = T.StructType([T.StructField("item", kind), T.StructField("id", id_kind), T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        id_type = None
        for table in _shards(batches, POSTINGS):
            id_type = table.schema.field("id").type
            table = table.take(pc.sort_indices(table["id"])).combine_chunks()  # nulls last
            if len(table) == 0:
                continue
            lists = table["terms"].combine_chunks()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            shard = Shard(table["n"].to_numpy(), ends, lists.flatten().to_numpy(), table["counts"].combine_chunks().flatten().to_numpy(), weights, n_docs, total)
            ids = table["id"].to_pylist()
            for i, (_, query) in enumerate(items):
                had = found.get(i, [])
                docs, scores = shard.best(query, top, had[-1][0] if len(had) == top else 1)
                if len(docs):
                    more = [(s, ids[d]) for d, s in zip(docs.tolist(), scores.tolist())]
                    found[i] = sorted(had + more, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:top]
        for i, rows in found.items():
            item = items[i][0]
            columns = [pa.array([item] * len(rows), items_type), pa.array([x[1] for x in rows], id_type), pa.array([x[0] for x in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return held.coalesce(max(1, n_docs // DOCS_A_TASK)).mapInArrow(search, schema)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """item, rank, id, score: the ``top`` documents of each query with a score above 0."""
    pairs = common.settled(items_of(queries, item_col, item_text), "search-items")
    n_blocks = max(1, -(-pairs.count() // PAIRS))
    best = None
    for i in range(n_blocks):
        block = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)
        found = _block(docs, block, id_col, text, top)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "id", "score")


def oracle(top: int = TOP) -> str:
    """DuckDB SQL of ``search`` for all of ``benchmark`` in ``documents``."""
    found = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))"
    return f"""
    with d as (select row_number() over () as r, doc_id, text from documents),
    t as (select r, {found} as term from d),
    n as (select r, count(*) as n from t group by r),
    s as (select count(*) as docs, sum(n)::bigint as total from n),
    q as (select distinct item_id, {found} as term from benchmark),
    p as (select r, term, count(*) as tf from t where term in (select term from q) group by r, term),
    w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from p group by term), s),
    m as (select r, {100 - FLAT} + ({SHARE} * n * docs) // total as m from n, s),
    i as (select r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) as impact from p join w using (term) join m using (r)),
    z as (select item_id, r, sum(impact)::bigint as score from q join i using (term) group by item_id, r having sum(impact) > 0),
    k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id, r) as rank, doc_id, score from z join d using (r))
    select item_id, rank::int as rank, doc_id, score from k where rank <= {top}
    """
