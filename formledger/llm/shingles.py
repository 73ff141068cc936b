"""Sets of hashed word shingles, by arrays: no loop over words."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)  #: odd, so its powers have inverses modulo 2**64
BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = (9, 10, 11, 12, 13, 32)  #: fixed: the white space that ends a word
PIECE = 1 << 20  #: bytes hashed at once; a longer text is cut at white space
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and which bytes are white space."""
    values = mixed(np.arange(1, 257, dtype=U64) * STEP)
    return values, np.isin(np.arange(256), SPACES)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = np.full(n, STEP), np.full(n, BACK)
    forth[0] = back[0] = 1
    return np.cumprod(forth, dtype=U64), np.cumprod(back, dtype=U64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, in order, and where it begins."""
    values, space = _tables()
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = max(PIECE + 1, 1 << int(len(data) + 1).bit_length()) if len(data) > PIECE else PIECE + 1
    forth, back = _powers(size)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * forth[: len(data)], dtype=U64, out=total[1:])
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64)), starts


def _pieces(raw: bytes):
    """Cuts of a long text at white space, of PIECE bytes or one word."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = max(raw.rfind(bytes([s]), at, end) for s in SPACES)
            if cut < 0:
                cut = min((x for s in SPACES if (x := raw.find(bytes([s]), end)) >= 0), default=len(raw))
            end = cut + 1
        yield raw[at:end]
        at = end


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; fewer words: all of them as one; no word: none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            hashes, starts = word_hashes(b" ".join(group))
            first = np.cumsum([0] + [len(g) + 1 for g in group])
            cuts = np.searchsorted(starts, first)
            rows = _shingles(hashes, k)
            out.extend(_set(hashes, rows, a, b, k) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            group.clear()

    held = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held + len(raw) >= PIECE:
            flush()
            held = 0
        if len(raw) >= PIECE:
            hashes = np.concatenate([word_hashes(p)[0] for p in _pieces(raw)])
            out.append(_set(hashes, _shingles(hashes, k), 0, len(hashes), k))
        else:
            group.append(raw)
            held += len(raw) + 1
    flush()
    return out


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, U64(k))
    for i in range(k):
        total = total * STEP + hashes[i : i + n]
    return mixed(total)


def _set(hashes: np.ndarray, rows: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    if b - a >= k:
        return np.unique(rows[a : b - k + 1])
    return _shingles(hashes[a:b], b - a) if b > a else np.empty(0, U64)


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()
