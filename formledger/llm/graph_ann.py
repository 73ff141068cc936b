"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Vectors are scaled to length 1, so Euclidean order is cosine order.  Equal vectors are one node; its smallest ids go along.
Nodes of equal length (number of components) are dealt to shards of about ``SHARD`` by a hash; vectors of different lengths have no cosine.  In a shard the nodes join the graph in batches: a greedy search
from the nearest of its seeds (a sample of the nodes, so groups without links between them are all entered) proposes neighbours, and of these the closest is kept and all that are ``ALPHA`` times closer to it than to
the node are dropped, again and again; the edges get their way back under the same rule.  A second pass over all nodes
follows with the whole graph in place.  The graphs are settled as a table.  Queries visit each shard in blocks of ``BLOCK``, so
a task holds one shard and one block; each shard gives a query's best by beam search, with beams twice as wide until a query's best stay
the same; distances are doubles, for of tight groups floats can't tell the members apart; scores are computed anew in double precision on the original vectors, and the best of all shards are kept.

Defined results: vectors that are null, empty, zero or with null or non-finite components take no part; a vector is only compared with
those of its length; ties go to the smaller id; a query never finds its own id, also if its id is there twice; fewer candidates
than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD = 20_000  #: nodes in a shard, which one task builds
DEGREE, BEAM, ALPHA = 32, 64, 1.2
BATCH = 256
WIDEST = 2048  #: beam at which a query's best are taken as they are
SEEDS = 8  #: one in so many nodes is a seed, 64 at least
HELD = 48 << 20  #: bytes of vectors that a step gathers
BLOCK = 32_768  #: queries that visit a shard at once


def _top(distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of each row, in order."""
    if distance.shape[1] > k:
        part = np.argpartition(distance, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(distance, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(distance, axis=1, kind="stable")


class Graph:
    """Nodes are rows of ``x`` (length 1); ``edges`` holds up to DEGREE neighbours of each, -1 where there is none; ``seeds`` are where searches begin."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float64)
        self.order = np.random.Generator(np.random.Philox(7)).permutation(len(self.x))
        self.seeds = self.order[: max(64, len(self.x) // SEEDS)]
        if edges is not None:
            self.edges = edges
            return
        self.edges = np.full((len(x), DEGREE), -1, np.int32)
        self._build()

    def search(self, queries: np.ndarray, beam: int, visited: bool = False, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries in lockstep: nodes and distances, nearest first; with ``visited`` all expanded nodes too."""
        n, m = len(self.x), len(queries)
        seeds = self.seeds if seeds is None else seeds
        wide = max(1, min(beam // 16, HELD // (m * DEGREE * self.x.shape[1] * 8)))  # nodes expanded in a step
        seen = np.zeros((m, n), bool)
        nodes = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf)
        far = 1 - queries @ self.x[seeds].T
        first = _top(far, min(beam // 2, len(seeds)))
        nodes[:, : first.shape[1]], dist[:, : first.shape[1]] = seeds[first], np.take_along_axis(far, first, 1)
        seen[np.arange(m)[:, None], seeds[first]] = True
        done = np.zeros((m, beam), bool)
        trail = []
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live] | (nodes[live] < 0), np.inf, dist[live])
            more = np.isfinite(open_).any(1)
            live, open_ = live[more], open_[more]
            if not len(live):
                break
            at = _top(open_, wide)
            fine = np.isfinite(np.take_along_axis(open_, at, 1))
            current = np.where(fine, nodes[live[:, None], at], -1)
            done[live[:, None], at] = True
            if visited:
                step = np.full((m, wide), -1, np.int64)
                step[live, : current.shape[1]] = current
                trail.append(step)
            near = np.where(current[:, :, None] >= 0, self.edges[current], -1).reshape(len(live), -1).astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            row, column = np.nonzero(fresh)
            if current.shape[1] > 1:  # a node that two of them lead to counts once
                _, once = np.unique(row * n + near[row, column], return_index=True)
                fresh[:] = False
                row, column = row[once], column[once]
                fresh[row, column] = True
            found = near[row, column]
            seen[live[row], found] = True
            d = np.full(near.shape, np.inf)
            d[row, column] = 1 - np.einsum("md,md->m", queries[live[row]], self.x[found])
            all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1)
            all_dist = np.concatenate([dist[live], d], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            best = _top(all_dist, beam)
            nodes[live], dist[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_nodes, all_dist, all_done))
        if visited:
            return np.concatenate([nodes, *trail], 1), dist
        return nodes, dist

    def best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nodes and distances, the first k of them settled: wider beams didn't change them."""
        parts = [self._best(queries[i : i + BATCH], k) for i in range(0, len(queries), BATCH)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        beam = max(BEAM, k)
        nodes, dist = self.search(queries, beam)
        live, width = np.arange(len(queries)), beam
        while len(live) and beam < min(WIDEST, len(self.x)):
            beam *= 2
            new, far = self.search(queries[live], beam)
            other = (new[:, :k] != nodes[live, :k]).any(1)
            nodes[live], dist[live] = new[:, :width], far[:, :width]
            live = live[other]
        return nodes, dist

    def _prune(self, owner: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Relaxed pruning for many nodes in lockstep: take the closest, drop those that are ALPHA times closer to it than to the node."""
        size = max(1, HELD // (candidates.shape[1] * self.x.shape[1] * 8))
        if len(owner) > size:
            return np.concatenate([self._prune(owner[i : i + size], candidates[i : i + size]) for i in range(0, len(owner), size)])
        own = self.x[owner]
        near = np.where(candidates < 0, owner[:, None], candidates)
        d = 1 - np.einsum("md,mkd->mk", own, self.x[near])
        candidates = candidates.copy()
        candidates[(candidates == owner[:, None]) | (candidates < 0)] = -1
        d[candidates < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
        same = np.concatenate([np.zeros((len(owner), 1), bool), (candidates[:, 1:] == candidates[:, :-1])], 1)
        d[same] = np.inf
        vectors = self.x[np.where(candidates < 0, 0, candidates)]
        out, rows = np.full((len(owner), DEGREE), -1, np.int32), np.arange(len(owner))
        for k in range(DEGREE):
            at = d.argmin(1)
            ok = np.isfinite(d[rows, at])
            if not ok.any():
                break
            out[ok, k] = candidates[rows, at][ok]
            chosen = vectors[rows, at]
            between = 1 - np.einsum("md,mkd->mk", chosen, vectors)
            # 1 - cosine is half the squared distance, so the factor is squared
            d[(ALPHA * ALPHA * between <= d) & ok[:, None]] = np.inf
            d[rows[ok], at[ok]] = np.inf
        return out

    def _join(self, batch: np.ndarray, seeds: np.ndarray) -> None:
        found, _ = self.search(self.x[batch], BEAM, visited=True, seeds=seeds)
        found = np.concatenate([found, self.edges[batch].astype(np.int64)], 1)
        self.edges[batch] = self._prune(batch, found)
        # the way back: those with room append, the full ones prune again
        to = self.edges[batch].reshape(-1).astype(np.int64)
        source = np.repeat(batch, DEGREE)
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        width = int(counts.max()) if len(counts) else 0
        new = np.full((len(targets), width), -1, np.int64)
        place = np.arange(len(to)) - np.repeat(first, counts)
        new[np.repeat(np.arange(len(targets)), counts), place] = source
        old = self.edges[targets].astype(np.int64)
        new[(new[:, :, None] == old[:, None, :]).any(2)] = -1
        both = np.concatenate([old, new], 1)
        total = (both >= 0).sum(1)
        roomy = total <= DEGREE
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
        self.edges[targets[roomy]] = packed[roomy]
        if (~roomy).any():
            full = np.flatnonzero(~roomy)
            for part in np.array_split(full, -(-len(full) // BATCH)):
                self.edges[targets[part]] = self._prune(targets[part], both[part])

    def _build(self) -> None:
        order, at = self.order, 1
        while at < len(order):  # batches grow with the graph
            size = min(BATCH, at)
            self._join(order[at : at + size], self.seeds[:at])
            at += size
        for at in range(0, len(order), BATCH):
            self._join(order[at : at + BATCH], self.seeds)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (doubles): rows whose vector has a direction."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def search(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row where ``is_query(id column)`` holds, itself left out."""
    rows = common.settled(usable(df, vec_id, vector), "ann-rows")
    # a node for each distinct vector, with the k + 1 smallest of its ids: more can't be among the k nearest
    nodes = common.settled(_smallest(rows, k + 1), "ann-nodes")
    shards = nodes.groupBy(F.size("v").alias("size")).agg(F.greatest(F.lit(1), F.round(F.count("*") / shard)).cast("long").alias("shards"))
    shards = common.narrow(common.settled(shards, "ann-shards"))
    dealt = nodes.withColumn("size", F.size("v")).join(shards, "size").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards"))).select("size", "shard", "v", "ids")
    graphs = common.settled(dealt.groupBy("size", "shard").applyInPandas(_built, "size int, shard long, x binary, ids binary, counts binary, edges binary"), "ann-graphs")
    queries = common.settled(rows.where(is_query(F.col("id"))).distinct(), "ann-queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("size", F.size("v")).join(shards, "size").withColumn("shard", every(F.col("shards")))

    def visit(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(block):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        g = graph.iloc[0]
        counts, ids = np.frombuffer(g["counts"], np.int64), np.frombuffer(g["ids"], np.int64)
        x, q = np.frombuffer(g["x"]).reshape(len(counts), -1), np.stack(block["v"].tolist())
        long_x, long_q = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        index = Graph(x / long_x[:, None], np.frombuffer(g["edges"], np.int32).reshape(len(x), DEGREE))
        found, _ = index.best(q / long_q[:, None], 2 * k + 2)
        a, b = np.nonzero(found >= 0)
        node = found[a, b]
        score = np.einsum("md,md->m", q[a], x[node]) / (long_q[a] * long_x[node])
        order = np.lexsort((-score, a))
        a, node, score = a[order], node[order], score[order]
        begin = np.searchsorted(a, np.arange(len(q)))
        near = np.arange(len(a)) - begin[a] < 2 * k + 2
        a, node, score = a[near], node[near], score[near]
        lines = np.repeat(np.arange(len(a)), counts[node])
        first = np.cumsum(counts) - counts
        within = np.arange(len(lines)) - np.repeat(np.cumsum(counts[node]) - counts[node], counts[node])
        members = ids[first[node][lines] + within]
        result = pd.DataFrame({"query_id": block["id"].to_numpy()[a[lines]], "vec_id": members, "score": score[lines]})
        result = result[result["query_id"] != result["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return result.groupby("query_id", sort=False).head(k)

    pairs = graphs.withColumn("block", every(F.lit(blocks).cast("long"))).groupBy("size", "shard", "block").cogroup(asked.groupBy("size", "shard", "block"))
    found = pairs.applyInPandas(visit, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _built(index: pd.DataFrame) -> pd.DataFrame:
    """One shard: its vectors, the ids of each, and the graph's edges."""
    x = np.stack(index["v"].tolist())
    graph = Graph(x / np.sqrt((x * x).sum(1))[:, None])
    ids = [np.asarray(i, np.int64) for i in index["ids"]]
    counts = np.array([len(i) for i in ids], np.int64)
    return pd.DataFrame({"size": [index["size"].iloc[0]], "shard": [index["shard"].iloc[0]], "x": [x.tobytes()], "ids": [np.concatenate(ids).tobytes()], "counts": [counts.tobytes()], "edges": [graph.edges.tobytes()]})


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: the k smallest ids of each distinct vector; copies meet in salted groups first, so a hot vector is not one task's."""
    salted = Window.partitionBy("v", "salt").orderBy("id")
    few = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("at", F.row_number().over(salted)).where(F.col("at") <= k)
    last = few.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k)
    return last.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
