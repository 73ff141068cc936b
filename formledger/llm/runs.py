"""Periodic runs of words, caught while a stream of words grows.

A run is a stretch of words with a smallest period ``q`` that is at least three periods long and can't be extended.  The words
of a batch of texts are one stream, with a separator of its own between two texts, so no run crosses it; a ``Stream`` takes it
in slices.  For each power of two ``b`` it keeps a catcher of the last completed block of ``b`` words: its hash.  A run whose
period lies in ``b .. 2 b - 1`` holds, in its first two periods, a whole block, and the block's words recur one period
later, which is a start in the block after it.  So each appended word completes one window of ``b`` words for each ``b``, and the window
is compared with one catcher: linear work for each power of two, whatever the text.  A hit is a square in the making: equal
neighbours merge, suffix comparisons word by word extend them to both sides, and what reaches the end of the stream stays open and goes on with
the next slice.  Hashes of ``2 b`` words come from two of ``b``; they only propose, words decide.  A hit inside a run of a
smaller period can't be a run of its own (two periods on so long a stretch would have a common divisor as period), so it is dropped at once.

Defined results: a null or empty text has no words and no runs; texts and rows may repeat; an id that is null is written like
any other value; columns of any names pass.  A batch of texts is held with about 16 bytes a word
beside its distinct words, and a stream works on slices of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LENGTH, LEAST_PERIODS = 24, 3  #: of a run
SLICE = 1 << 18  #: words that a stream takes at once
STRETCH = 16  #: words that a suffix comparison takes in its first step; each further step takes twice as many
WIDE = 1 << 20  #: words compared at once by all comparisons of a step
SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class _Level:
    """What a stream keeps for windows of ``b`` words: hashes that longer windows still need, and the catchers."""

    def __init__(self, b: int):
        self.b = b
        self.known = 0  #: windows that begin before this word have been hashed
        self.tail = np.empty(0, np.uint64)  #: hashes of the windows before ``known`` that the next level needs
        self.catchers = np.empty(0, np.uint64)  #: of the last one or two completed blocks
        self.first = 0  #: number of the block of the first of them


class Stream:
    """Runs of a growing stream of word numbers."""

    def __init__(self, longest: int):
        """``longest``: words of the longest text; no period is longer than a third of it."""
        self._held = np.empty(0, np.int64)
        self.words = self._held
        self.levels: list[_Level] = []
        while LEAST_PERIODS << len(self.levels) <= longest:
            self.levels.append(_Level(1 << len(self.levels)))
        self.open: dict[tuple[int, int], int] = {}  #: (start, period) of stretches that reach the end
        self.runs: dict[tuple[int, int], int] = {}  #: (start, end) of finished runs, and their period

    def append(self, more: np.ndarray) -> None:
        """Add words; each completes a window of every size and goes on with the open comparisons."""
        before, n = len(self.words), len(self.words) + len(more)
        if n > len(self._held):
            self._held = np.concatenate([self.words, np.empty(max(n, 2 * before) - before, np.int64)])
        self._held[before:n] = more
        self.words = self._held[:n]
        self._advance()
        hashes = _mix(more.astype(np.uint64) * _A + _C)
        for i, level in enumerate(self.levels):
            if len(hashes) == 0:
                break
            self._look(level, hashes)
            if i + 1 == len(self.levels):
                break
            kept = np.concatenate([level.tail, hashes])
            longer = max(0, len(kept) - level.b)
            hashes = _mix(kept[:longer] * _A + kept[len(kept) - longer :] * _B + _C)
            level.tail = kept[longer:]

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and then by period."""
        n = len(self.words)
        for (start, period), _ in self.open.items():
            self._close(start, n, period)
        self.open.clear()
        return sorted((s, e - s, p) for (s, e), p in self.runs.items())

    def _close(self, start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * period):
            self.runs[start, end] = min(period, self.runs.get((start, end), period))

    def _advance(self) -> None:
        n = len(self.words)
        held, self.open = self.open, {}
        for (start, period), end in held.items():
            unequal = self.words[end:n] != self.words[end - period : n - period]
            stop = int(unequal.argmax()) if unequal.any() else -1
            if stop < 0:
                self.open[start, period] = n
            else:
                self._close(start, end + stop, period)

    def _look(self, level: _Level, hashes: np.ndarray) -> None:
        """Compare the new windows of a level with the catcher of the block before the one they begin in."""
        b, begin = level.b, level.known
        end = level.known = begin + len(hashes)
        fresh = np.arange(-(-begin // b) * b, end, b)
        level.catchers = np.concatenate([level.catchers, hashes[fresh - begin]])
        starts = np.arange(max(begin, b), end)
        if len(starts):
            block = starts // b - 1
            hit = np.flatnonzero(hashes[starts - begin] == level.catchers[block - level.first])
            if len(hit):
                self._follow(b, block[hit] * b, starts[hit])
        drop = max(0, end // b - 1 - level.first)  # catchers of blocks that no later window begins after
        level.catchers, level.first = level.catchers[drop:], level.first + drop

    def _covered(self, b: int, blocks: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether a known run of a period up to ``b`` holds the block and its recurrence, or an open stretch of the same period does."""
        out = np.zeros(len(blocks), bool)
        for (s, p), _ in self.open.items():
            out |= (period == p) & (blocks >= s)
        known = [(s, e) for (s, e), p in self.runs.items() if p <= b] + [(s, e) for (s, p), e in self.open.items() if p <= b and e - s >= LEAST_PERIODS * p]
        if known:
            begins, ends = np.array(sorted(known), np.int64).T
            furthest = np.maximum.accumulate(ends)
            at = np.searchsorted(begins, blocks, "right") - 1
            out |= (at >= 0) & (furthest[at] >= blocks + period + b)
        return out

    def _follow(self, b: int, blocks: np.ndarray, starts: np.ndarray) -> None:
        """Extend hits (a block's words recur at a start) to both sides and keep what may be a run."""
        period = starts - blocks
        left = ~self._covered(b, blocks, period)
        blocks, period = blocks[left], period[left]
        if len(blocks) == 0:
            return
        order = np.lexsort((blocks, period))
        blocks, period = blocks[order], period[order]
        chain = np.ones(len(blocks), bool)  # neighbours of the same period are one stretch
        chain[1:] = (period[1:] != period[:-1]) | (blocks[1:] != blocks[:-1] + b)
        first = np.flatnonzero(chain)
        last = np.append(first[1:], len(blocks)) - 1
        low, p = blocks[first], period[first]
        high = blocks[last] + b
        # words low .. high - 1 recur p later (by hash); how far to both sides does that go?
        n = len(self.words)
        low = low - self._equal(low - 1, p, -1, n)
        high = high + self._equal(high, p, 1, n)
        for s, e, q in zip(low.tolist(), high.tolist(), p.tolist()):
            if e + q < n and e - s + q < max(LEAST_LENGTH, LEAST_PERIODS * q):
                continue
            for s, e in self._exact(s, e, q):
                if e + q == n:
                    self.open[s, q] = n
                else:
                    self._close(s, e + q, q)

    def _equal(self, at: np.ndarray, period: np.ndarray, step: int, n: int) -> np.ndarray:
        """How many words from ``at`` on, in a direction, equal the word one period later."""
        out = np.zeros(len(at), np.int64)
        going, width = np.arange(len(at)), STRETCH
        while len(going):
            done = []
            for part in np.array_split(going, -(-len(going) * width // WIDE)):
                places = at[part, None] + step * (out[part, None] + np.arange(width))
                inside = (places >= 0) & (places + period[part, None] < n)
                places = np.where(inside, places, 0)
                same = inside & (self.words[places] == self.words[np.where(inside, places + period[part, None], 0)])
                whole = same.all(axis=1)
                out[part] += np.where(whole, width, (~same).argmax(axis=1))
                done.append(part[whole])
            going, width = np.concatenate(done), min(2 * width, WIDE)
        return out

    def _exact(self, low: int, high: int, period: int) -> list[tuple[int, int]]:
        """Stretches of low .. high - 1 whose words do recur; all of it, but where a hash was wrong."""
        bad = np.flatnonzero(self.words[low:high] != self.words[low + period : high + period]) + low
        if len(bad) == 0:
            return [(low, high)]
        edges = [low - 1, *bad.tolist(), high]
        return [(a + 1, z) for a, z in zip(edges, edges[1:]) if z - a - 1 >= (LEAST_PERIODS - 1) * period]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each of some texts, given as numbers of their words."""
    sizes = [len(t) for t in texts]
    begins = np.cumsum([0, *[s + 1 for s in sizes]])
    stream = Stream(max(sizes, default=0))
    words = np.empty(int(begins[-1]), np.int64)
    for i, (t, begin) in enumerate(zip(texts, begins.tolist())):
        words[begin : begin + len(t)], words[begin + len(t)] = t, -1 - i  # a separator of its own
    for begin in range(0, len(words), SLICE):
        stream.append(words[begin : begin + SLICE])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in stream.finish():
        i = int(np.searchsorted(begins, start, "right")) - 1
        out[i].append((start - int(begins[i]), length, period))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; the smallest start, then period, of equal ones."""
    best = None
    for run in runs:  # by start and period, so the first of equal ones stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that stay: of each run its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.flatnonzero(np.cumsum(steps[:n]) == 0)


def repeated_tail(doc_id: object, n: int) -> tuple[int, int] | None:
    """(first word, period) of the tail that one id in ten repeats, by the checksum of the id; None for the others and a null id."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def rows_of(texts: list[bytes | None], rewritten: Callable[[int, int], tuple[int, int] | None] = lambda i, n: None) -> list[tuple]:
    """A row of ``SCHEMA`` for each text.  ``rewritten``: of text i with n words, where its repeated tail begins and its period."""
    known: dict[bytes, int] = {}
    numbers, empty = [], np.empty(0, np.int64)
    for i, text in enumerate(texts):
        words = (text or b"").split()  # bytes split at ASCII white space alone
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) if words else empty
        tail = rewritten(i, len(own))
        if tail:
            a, p = tail
            own = np.concatenate([own[:a], np.resize(own[a : a + p], len(own) - a)])
        numbers.append(own)
    vocabulary = list(known)
    out = []
    for own, runs in zip(numbers, runs_of(numbers)):
        best = greatest(runs)
        listed = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        digest = hashlib.sha256()
        kept = own[kept_words(len(own), runs)]
        for i in range(0, len(kept), SLICE):
            digest.update((b" " if i else b"") + b" ".join([vocabulary[w] for w in kept[i : i + SLICE].tolist()]))
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((len(own), len(runs), *row, listed, digest.hexdigest()))
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tails: bool = False) -> DataFrame:
    """id and ``SCHEMA`` of each row: its runs and its text with each run cut to one period.

    ``tails``: the texts of one id in ten get a repeated tail first (``repeated_tail``), which shows what is found.
    """
    kind = docs.schema[id_col].dataType
    own = T.StructType.fromDDL(SCHEMA)
    schema = T.StructType([T.StructField("id", kind), *own.fields])
    target = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in own.fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            keys = ids.to_pylist()
            rows = rows_of(batch.column(1).to_pylist(), (lambda i, n: repeated_tail(keys[i], n)) if tails else (lambda i, n: None))  # noqa: B023
            columns = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(target)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *target.names])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(found, schema)
