"""Byte-level BPE encoding and decoding.

Boundaries between pre-tokens are found without a regex.  Every code point becomes a symbol (its class, with at most
two code points of look-ahead folded in); every symbol is a function on the states of a small automaton; the functions
are closed under composition, so a batch of texts is scanned with one table of compositions: rows of a block in
lockstep, block totals the same way, then all positions at once.  The slices go through a cache of merged pieces.

Defined results: a null or empty text has no tokens; rows may repeat; columns of the input stay as they are and the
added ones get a leading underscore if they would clash; texts of any length are scanned in windows of ``WINDOW`` code
points that hand the automaton's state on, so the memory for a scan is bounded (a pre-token itself is held whole).
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 1 << 19  #: code points in one scan
CACHED = 150_000  #: merged pieces that a worker remembers; then it starts anew
SHORT_PIECE = 32  #: pieces of more bytes are merged one by one, with a heap, and not remembered
NONE = 1 << 40  #: the rank of a pair that makes no token

# Symbols.  Q1/Q2: an apostrophe before a contraction of one or two letters, if it begins a pre-token.
# GLUE: a space before what isn't white space; LAST: other white space there; SPACE: white space before more, or at the end.
LETTER, NUMBER, OTHER, Q1, Q2, GLUE, LAST, SPACE, RESET = range(9)
# States, after a symbol.
_L, _N, _P, _G, _W, _X, _C1, _C2, _E, _START = range(10)

#: White space as regular expressions define it, and the contractions.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at this symbol."""
    if symbol == RESET:
        return _START, True
    if symbol == LETTER:
        if state in (_C1, _C2):
            return (_E if state == _C1 else _C1), False
        return _L, state not in (_L, _G)
    if symbol == NUMBER:
        return _N, state not in (_N, _G)
    if symbol in (OTHER, Q1, Q2):
        if symbol == OTHER or state in (_P, _G):
            return _P, state not in (_P, _G)
        return (_C1 if symbol == Q1 else _C2), True
    if symbol == SPACE:
        return _W, state != _W
    return (_G if symbol == GLUE else _X), True


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol its function's number; the table of compositions; each function's result by state; boundaries by state and symbol."""
    made = {tuple(range(10)): 0}  # number 0 is the identity
    first = [tuple(_step(q, s)[0] for q in range(10)) for s in range(9)]
    queue = list(made)
    for f in first:
        if f not in made:
            made[f] = len(made)
            queue.append(f)
    for f in queue:  # grows while it is read: the closure under composition
        for g in first:
            h = tuple(g[q] for q in f)
            if h not in made:
                made[h] = len(made)
                queue.append(h)
    functions = list(made)
    then = np.array([[made[tuple(g[q] for q in f)] for g in functions] for f in functions], np.int16)
    begins = np.array([[_step(q, s)[1] for s in range(9)] for q in range(10)], bool)
    return np.array([made[f] for f in first], np.int16), then, np.array(functions, np.int8), begins


def _scan(f: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Inclusive scan of function numbers under composition."""
    n, width = len(f), 128
    if n <= width:
        out = np.empty_like(f)
        last = 0
        for i, x in enumerate(f.tolist()):
            out[i] = last = then[last, x]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, f.dtype)  # padded with the identity
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):  # all blocks in lockstep
        grid[i] = then[grid[i - 1], grid[i]]
    before = np.zeros(rows, f.dtype)
    before[1:] = _scan(grid[-1], then)[:-1]
    return then[before[None, :], grid].T.reshape(-1)[:n]


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER or SPACE."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def _symbols(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Symbols of a window; ``marks`` are the places of separators between texts."""
    symbols = _classes()[points]
    symbols[marks] = SPACE  # white space before it is at the end of its text
    following = np.full(len(points) + 1, SPACE, np.uint8)
    following[:-1] = symbols
    last = (symbols == SPACE) & (following[1:] != SPACE)
    symbols[last] = np.where(points[last] == 32, GLUE, LAST)
    symbols[marks] = RESET
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.append(points, [0, 0]).astype(points.dtype)
        a, b = padded[quotes + 1], padded[quotes + 2]
        symbols[quotes[np.isin(a, [ord(c) for c in SHORT])]] = Q1
        for pair in LONG:
            symbols[quotes[(a == ord(pair[0])) & (b == ord(pair[1]))]] = Q2
    return symbols


def _cut(window: str, marks: np.ndarray, state: int = _START, ahead: int = 0) -> tuple[str, np.ndarray, int]:
    """What the scan covers of a window (all but ``ahead`` code points), where pre-tokens begin there, and the state after it."""
    by_symbol, then, result, begins = _automaton()
    points = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbols(points, marks)[: len(points) - ahead]
    states = result[_scan(by_symbol[symbols], then), state]
    before = np.empty_like(states)
    before[0], before[1:] = state, states[:-1]
    return window[: len(symbols)], np.flatnonzero(begins[before, symbols]), int(states[-1])


def _slices(own: str, starts: np.ndarray) -> list[str]:
    cuts = [*starts.tolist(), len(own)]
    return [own[a:b] for a, b in zip(cuts, cuts[1:])]


def pre_tokens(text: str) -> Iterator[list[str]]:
    """The slices of one text, window by window."""
    state, held, at = _START, "", 0
    while at < len(text):
        ahead = 2 if at + WINDOW + 2 < len(text) else 0
        own, starts, state = _cut(text[at : at + WINDOW + 2], np.empty(0, np.int64), state, ahead)
        at += len(own)
        if not len(starts):
            held += own
            continue
        first = held + own[: starts[0]]
        slices = _slices(own, starts)
        held = slices.pop()
        yield ([first] if first else []) + slices
    if held:
        yield [held]


def pre_tokens_of(texts: list[str]) -> list[list[str]]:
    """The slices of each of some shorter texts, by one scan."""
    window = "\n".join(texts) + "\n"
    marks = np.cumsum([len(t) + 1 for t in texts]) - 1
    own, starts, _ = _cut(window, marks)
    slices = _slices(own, starts)
    ends = np.searchsorted(starts, marks).tolist()
    return [slices[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks of a byte-level BPE, and the cache of merged pieces as little-endian ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.start = np.cumsum(self.length) - self.length
        by_id = sorted(ranks, key=ranks.get)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bits = max(4, len(pairs).bit_length() + 2)
        self.keys, self.joined = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        keys, joined = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(keys)
        while len(keys):  # open addressing: the first comer gets the slot, the others try the next
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.joined[slot[won]] = keys[won], joined[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, joined, slot = keys[rest], joined[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair of tokens makes, or NONE."""
        keys = (a << 32) | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.joined[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.joined[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """Merge pieces of at most SHORT_PIECE bytes in lockstep; ids as little-endian bytes."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        ids = np.full(inside.shape, -1, np.int64)
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full(inside.shape, NONE, np.int64)
        both = inside[:, 1:].nonzero()
        rank[both] = self.pair(ids[both], ids[both[0], both[1] + 1])
        row, columns = np.arange(len(pieces)), np.arange(width)
        while True:
            at = rank[row].argmin(1)
            joined = rank[row, at]
            more = joined < NONE
            row, at, joined = row[more], at[more], joined[more]
            if not len(row):
                break
            shifted = np.minimum(columns + (columns > at[:, None]), width - 1)  # what is right of the pair moves up
            own, kept = np.take_along_axis(ids[row], shifted, 1), np.take_along_axis(rank[row], shifted, 1)
            size[row] -= 1
            ones = np.arange(len(row))
            own[ones, at] = joined
            own[columns >= size[row][:, None]] = -1
            kept[columns >= size[row][:, None] - 1] = NONE
            for side in (at, at - 1):
                ok = np.flatnonzero((side >= 0) & (side < size[row] - 1))
                kept[ok, side[ok]] = self.pair(own[ok, side[ok]], own[ok, side[ok] + 1])
            ids[row], rank[row] = own, kept
        flat = ids[np.arange(width) < size[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(size) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbours of lowest rank, leftmost first, until none can be joined."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, stop = heapq.heappop(pairs)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue  # one of its sides has been joined meanwhile
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(pairs, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(pairs, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks; the shorter ones stay in it."""
        if len(self.cache) + len(pieces) > CACHED:
            self.cache.clear()
        raw = {p: p.encode("utf-8", "replace") for p in pieces}
        out = {}
        for low, high in ((0, 12), (12, SHORT_PIECE)):
            if some := [p for p, r in raw.items() if low < len(r) <= high]:
                out.update(zip(some, self.merge_together([raw[p] for p in some])))
        self.cache.update(out)
        out.update((p, np.array(self.merge(r), "<u4").tobytes()) for p, r in raw.items() if len(r) > SHORT_PIECE)
        return out

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        get = self.cache.get
        found = [list(map(get, slices)) for slices in texts]
        lacking = {p for slices, ids in zip(texts, found) if None in ids for p, x in zip(slices, ids) if x is None}
        new = self.learn(lacking) if lacking else {}
        return [b"".join(ids if None not in ids else [new[p] if x is None else x for p, x in zip(slices, ids)]) for slices, ids in zip(texts, found)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, group, held = [], [], 0
        for text in [*texts, None]:
            if group and (text is None or held + len(text) > WINDOW):
                out += self._ids(pre_tokens_of(group))
                group, held = [], 0
            if text is None:
                break
            if len(text) > WINDOW:
                out.append(b"".join(self._ids([slices])[0] for slices in pre_tokens(text)))
            else:
                group.append(text)
                held += len(text) + 1
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def offsets(self, ids: bytes) -> bytes:
        """Where each token's bytes begin in the text's UTF-8, as little-endian unsigned 64-bit integers."""
        length = self.length[np.frombuffer(ids, "<u4")]
        return (np.cumsum(length) - length).astype("<u8").tobytes()

    def decode(self, ids: bytes, offsets: bytes | None = None) -> bytes:
        """The bytes of the tokens, each put where its offset says."""
        numbers = np.frombuffer(ids, "<u4")
        if not len(numbers):
            return b""
        at = np.frombuffer(self.offsets(ids) if offsets is None else offsets, "<u8").astype(np.int64)
        length = self.length[numbers]
        source = np.repeat(self.start[numbers] - at, length)
        return self.bytes[source + np.arange(at[0], at[0] + len(source))].tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and path."""
    return Vocabulary(read_ranks(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of every whole text and the byte offsets of its tokens, both as little-endian integers (32 and 64 bits) in binary columns.

    ``path`` is a file of ranks that every executor can read.  ``keep`` names the columns to carry along (all by default).
    """
    keep = df.columns if keep is None else keep
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias(own := common.fresh(df, "bpe_text")[0]))
    ids, offsets = common.fresh(df.select(*keep), ids, offsets)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.BinaryType()), T.StructField(offsets, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            encoded = v.encode_all(texts.to_pylist())
            columns = [*batch.columns[:-1], pa.array(encoded, pa.binary()), pa.array([v.offsets(x) for x in encoded], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], ids, offsets])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str = "offsets", into: str = "decoded") -> DataFrame:
    """Add the bytes of the tokens in ``ids``; null ids give null."""

    @F.pandas_udf(T.BinaryType())
    def run(numbers, begins):
        v = vocabulary(path)
        return numbers.combine(begins, lambda x, y: None if x is None else v.decode(x, y))

    return df.withColumn(common.fresh(df, into)[0], run(F.col(ids), F.col(offsets)))
