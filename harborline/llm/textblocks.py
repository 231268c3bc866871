"""Arrow text columns as flat numpy arrays of word and n-gram hashes.

Spark partitions and shuffles the rows; inside a task these helpers turn a batch of texts into
64-bit hashes without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of these are single bytes in
UTF-8, so cutting bytes cuts the same words as cutting characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed in one numpy pass; bounds the memory of a pass.
PIECE_BYTES = 1 << 19
#: Longer words are hashed by blake2b instead of the polynomial.
LONG_WORD = 256

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """hashes of all words of a batch; first[i] is where document i begins in them (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        table = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            table.append(np.multiply.accumulate(p))
        _powers[:] = table
    return _powers[0][:n], _powers[1][:n]


def lowered(body: np.ndarray) -> np.ndarray:
    return _LOWER[body]


def solid(body: np.ndarray) -> np.ndarray:
    """Which bytes are no white space."""
    return ~_SPACE[body] if len(body) else np.zeros(0, bool)


def hashes_of(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ascending stretches [starts[i], ends[i]) of body."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        s, e = starts[at:upto], ends[at:upto]
        base = s[0]
        if e[-1] - base > PIECE_BYTES:
            out[at] = 0  # one long word, hashed below
        else:
            p, inv = powers(int(e[-1] - base))
            h = np.zeros(int(e[-1] - base) + 1, U64)
            np.cumsum((body[base : e[-1]].astype(U64) + U64(1)) * p, out=h[1:])
            out[at:upto] = mix((h[e - base] - h[s - base]) * inv[s - base] + (e - s).astype(U64))
        at = upto
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(body[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(offsets: np.ndarray, body: np.ndarray) -> Words:
    n = len(body)
    full = solid(body)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | cut[1:n]
    stops = full.copy()
    stops[:-1] &= ~full[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(hashes_of(body, starts, ends), np.searchsorted(starts, offsets).astype(np.int64), starts, ends)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `size` words inside a document, in order.

    short: a document of fewer words gives its whole sequence as one window; without words, none.
    """
    total, counts = len(hashes), np.diff(first)
    doc = doc_of(first)
    if total < size:
        at = np.zeros(0, np.int64)
        run = np.zeros(0, U64)
    else:
        run = np.zeros(total - size + 1, U64)
        for k in range(size):
            run = run * U64(0x100000001B3) + hashes[k : total - size + 1 + k]
        at = np.flatnonzero(doc[: total - size + 1] == doc[size - 1 :])
        run = mix(run[at] ^ U64(size * 0x51ED270B))
    of = doc[at]
    if short and len(few := np.flatnonzero((counts > 0) & (counts < size))):
        whole = []
        for i in few:
            h = 0
            for x in hashes[first[i] : first[i + 1]].tolist():
                h = (h * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
            whole.append(h ^ (int(counts[i]) * 0x51ED270B))
        run, of = np.concatenate([run, mix(np.array(whole, U64))]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        run, of = run[order], of[order]
    return run, of


def pieces(texts: pa.Array, at_most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of whole texts that hold about at_most bytes."""
    offsets, body = raw(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_most, "right")) - 1)
        upto = min(upto, n)
        yield row, offsets[row : upto + 1] - offsets[row], body[offsets[row] : offsets[upto]]
        row = upto


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of values over [first[i], first[i + 1])."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def means_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The mean of values over [first[i], first[i + 1]), 0 of none; each from its own values alone."""
    n = np.diff(first)
    out = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(values, first[some]) / n[some]
    return out
