"""Elias-Fano sequences over numpy arrays, and files of such arrays that are memory-mapped.

All queries are vectorised: they take and return whole arrays.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

U64 = np.uint64


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th (from 0) set bit of each 64-bit word."""
    at, r = np.zeros(len(word), np.int64), r.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & U64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        go = r >= n
        r = r - n * go
        word = np.where(go, word >> U64(width), low)
        at += width * go
    return at


class Monotone:
    """A non-decreasing sequence of n values: low bits packed, high bits in unary with counts per word."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.bits = (int(x) for x in arrays[f"{name}.shape"])
        self.low, self.high, self.ones = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones"))

    @staticmethod
    def pack(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = np.zeros((n + (top >> bits) + 2 + 63) // 64 + 1, U64)
        place = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(U64))
        low = np.zeros((n * bits + 63) // 64 + 1, U64)
        if bits:
            rest, at = values & U64((1 << bits) - 1), np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, rest << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (U64(64) - shift[over]))
        ones = np.zeros(len(high) + 1, np.uint32 if n < 1 << 32 else np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return {f"{name}.shape": np.array([n, bits], np.int64), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        x = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        x[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return x & U64((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(U64) << U64(self.bits)) | self._lows(i)

    def _upto(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most h."""
        out = np.zeros(len(h), np.int64)
        zeros = getattr(self, "zeros", None)
        if zeros is None:
            zeros = self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        inside = (h >= 0) & (h < zeros[-1])
        out[h >= zeros[-1]] = self.n
        j = h[inside]
        word = np.searchsorted(zeros, j, "right") - 1
        out[inside] = word * 64 + _select_in_word(~self.high[word], j - zeros[word]) - j
        return np.minimum(out, self.n)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is at least x (n: none)."""
        h = (x >> U64(self.bits)).astype(np.int64)
        lo, hi = self._upto(h - 1), self._upto(h)
        want = x & U64((1 << self.bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x, or -1."""
        p = self.successor(x)
        got = np.full(len(x), -1, np.int64)
        inside = np.flatnonzero(p < self.n)
        hit = inside[self.at(p[inside]) == x[inside]]
        got[hit] = p[hit]
        return got


def _place(uri: str):
    """(file system, path) of a file in any store that pyarrow can reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of all arrays; a retried task replaces it as a whole."""
    store, path = _place(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (str(v.dtype), at, len(v))
        at += (v.nbytes + 63) // 64 * 64
    said = json.dumps(head).encode()
    said += b" " * (-(len(said) + 8) % 64)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(len(said).to_bytes(8, "little") + said)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + b"\0" * (-v.nbytes % 64))
    store.move(part, path)


def arrays_of(uri: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, read as a whole; None if there is no such file."""
    store, path = _place(uri)
    if not store.get_file_info(path).is_file:
        return None
    with store.open_input_stream(path) as f:
        data = np.frombuffer(f.read(), np.uint8)
    n = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + n].tobytes())
    return {k: data[8 + n + a : 8 + n + a + np.dtype(t).itemsize * size].view(t) for k, (t, a, size) in head.items()}


_mapped: dict[str, dict[str, np.ndarray]] = {}


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a remote file is mapped from a local copy that has no name any more."""
    if uri not in _mapped:
        store, path = _place(uri)
        local = path
        if store.type_name != "local":
            handle, local = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as f:
                while block := f.read(1 << 22):
                    out.write(block)
        data = np.memmap(local, np.uint8, "r")
        if local != path:
            os.unlink(local)
        n = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + n].tobytes())
        if len(_mapped) > 4096:
            _mapped.clear()
        _mapped[uri] = {k: np.asarray(data[8 + n + a : 8 + n + a + np.dtype(t).itemsize * size]).view(t) for k, (t, a, size) in head.items()}
    return _mapped[uri]
