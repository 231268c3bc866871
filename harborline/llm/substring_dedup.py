"""Removal of every byte run of 50 bytes or more that an earlier document holds, by a column-wise BWT of all windows that could repeat.

A window is a run of `length` bytes inside one document.  Its anchor is the `gram`-byte run in it with the smallest
hash (the leftmost of equals), so equal windows have equal anchors; consecutive windows with one anchor
make a segment of at most 2 * length - gram bytes.  Three passes over the texts, which are first written as
blocks in the shared folder:

1. Blocks list their distinct anchors; an anchor that occurs once in all documents is no anchor of a repeated
   window.  Lists are dealt by hash ranges and each block gets back those of its anchors that repeat.
2. Blocks send each different segment of these anchors once, with the smallest id that holds it, to
   ranges of the anchor's hash.  A range is a collection of short strings, in which the anchor is a short code
   (`coded`): its Burrows-Wheeler transform and the
   array of common prefixes grow by one symbol of every string a round (`columns`), from the last symbol to the
   first, in files that are read and rewritten in sequence.  Rows with common prefixes of `length` or more
   are one window, and the smallest id of such a run is its first document.  Equal segments are one string with the
   smallest id before; a string whose anchor no other has shares no window and stays out.  Blocks get back, for each
   segment, the first document of its windows.
3. Blocks mark windows whose first document has a smaller id, and join their bytes.

Scale: a block holds `block_bytes` of text, a range `range_bytes` of segments.  An anchor with `hot` segments or more
(a phrase in ever new surroundings) is dealt by whole windows instead, each of which a block
sends once; so no key has more rows than there are blocks.  The number of messages is at most that of
anchors.  Files between the passes lie in the shared folder, one for each block, replaced as a whole by a task
that runs again.  Scratch files of a range stay in memory up to `spool` bytes and have no name beyond.
Hash collisions of anchors only add work; segments of a range are compared by bytes; a block finds its segments again by 64-bit
hashes, so two of the n in a block fall together with a chance of n**2 / 2**65.

Edge cases: null texts are empty; nothing is removed from texts under `length` bytes; a null id is larger than any
other, and rows of equal ids are not earlier than one another, so repeated rows are each judged against
smaller ids only; ids are whole numbers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import shared_dir, table
from harborline.llm.succinct import arrays_of, write_arrays
from harborline.llm.textblocks import hashes_of, mix, pieces

U64 = np.uint64
LAST = (1 << 63) - 1  # stands for a null id
END = 255  # precedes the first symbol of a string; this and the next are no bytes of UTF-8
MARK = 254  # begins the code of an anchor
ANCHOR_BITS = 48
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass(frozen=True)
class Settings:
    length: int = 50  # bytes of a window
    gram: int = 24  # bytes of an anchor
    block_bytes: int = 1 << 25  # text of a block
    chunk: int = 1 << 19  # bytes hashed at once; longer texts are cut into chunks that overlap by length - 1
    gathered: int = 1 << 20  # segments that a task gathers before it deals them out
    range_anchors: int = 1_500_000  # anchors of a range of the first pass
    range_bytes: int = 4 << 20  # segment bytes of a range of the second pass, before equal ones are joined
    hot: int = 4096  # segments of an anchor from which its windows are dealt one by one
    rows: int = 1 << 20  # rows of the transform read at once
    spool: int = 1 << 26


# ---- windows and anchors ----


def gram_hashes(body: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` bytes, from hashes of runs of powers of two."""
    base, h, width, out, done = 0x9E3779B97F4A7C15, body.astype(U64) + U64(1), 1, None, 0
    while True:
        if size & width:
            out, done = (h, width) if out is None else (out[: len(h) - done] * U64(pow(base, width, 1 << 64)) + h[done:], done + width)
        if 2 * width > size:
            return mix(out[: len(body) - size + 1])
        h = h[:-width] * U64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - size + width], x[size - width :]) if width < size else x


def segments(offsets: np.ndarray, body: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its place, start, windows, text) of the segments of texts, in order of their places; segments keep to chunks of a long text."""
    found = []
    for a in range(0, max(1, len(body) - s.length + 1), s.chunk):
        part = body[a : a + s.chunk + s.length - 1]
        if len(part) < s.length:
            break
        h = gram_hashes(part, s.gram)
        place = U64(int(len(h)).bit_length())
        least = sliding_least((h >> place << place) | np.arange(len(h), dtype=U64), s.length - s.gram + 1)
        at = (least & ((U64(1) << place) - U64(1))).astype(np.int64)
        starts = np.arange(a, a + len(at))
        text = np.searchsorted(offsets, starts[:: max(1, len(starts) - 1)], "right") - 1
        spans = np.arange(text[0], text[-1] + 1)
        size = np.minimum(offsets[spans + 1], a + len(at)) - np.maximum(offsets[spans], a)
        whole = starts + s.length <= np.repeat(offsets[spans + 1], size)
        starts, at, of = starts[whole], at[whole], np.repeat(spans, size)[whole]
        if len(at):
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            found.append((h[at[new]] >> U64(64 - ANCHOR_BITS), a + at[new], starts[new], np.diff(np.append(new, len(at))), of[new]))
    if not found:
        return np.zeros(0, U64), *(np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] each, in one array."""
    total = np.cumsum(size)
    return np.repeat(first - total + size, size) + np.arange(total[-1] if len(total) else 0)


def starts_of_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


# ---- the transform of a collection, column by column ----


class Rows:
    """Two files of one byte a row: the symbol before each suffix, and its common prefix with the row above."""

    def __init__(self, spool: int):
        self.files = [tempfile.SpooledTemporaryFile(max_size=spool) for _ in range(2)]  # noqa: SIM115
        self.n = 0

    def append(self, *columns: np.ndarray) -> None:
        for f, x in zip(self.files, columns, strict=True):
            f.write(x.tobytes())
        self.n += len(columns[0])

    def rewind(self) -> None:
        for f in self.files:
            f.seek(0)

    def read(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(f.read(n), np.uint8) for f in self.files)

    def close(self) -> None:
        for f in self.files:
            f.close()


def _places(old: Rows, new_at: np.ndarray, counts: np.ndarray, k: int, cap: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over the rows: where the symbols of rows new_at (ascending) put their longer suffixes.

    Returns (row, prefix, i) of the new rows, ascending, i counting in new_at, and (row, prefix) of the old rows that follow a new one.
    Row r with symbol c leads to the row of its longer suffix: the k ends come first, then all suffixes by their first symbol, those of c
    in the order of the rows with symbol c.  Two neighbours among these share one symbol more than
    the least common prefix after the upper one's row down to the lower one's.
    """
    base = k + np.append(0, np.cumsum(counts[:END]))
    before, seen_least, seen_new = np.zeros(END + 1, np.int64), np.full(END + 1, 255, np.int64), np.zeros(END + 1, bool)
    out, a = [], 0
    old.rewind()
    while a < old.n:
        symbol, prefix = old.read(min(rows, old.n - a))
        lo, hi = np.searchsorted(new_at, [a, a + len(symbol)])
        width = int(len(symbol)).bit_length() + 1
        # symbol, row and whether the row is new, in one number, so that sorting puts the rows of each symbol in order
        key = symbol.astype(np.uint32) << np.uint32(width)
        key |= np.arange(0, 2 * len(symbol), 2, dtype=np.uint32)
        key[new_at[lo:hi] - a] |= np.uint32(1)
        key.sort()
        here = np.bincount(symbol, minlength=END + 1)
        key = key[: len(key) - here[END]]
        heads = np.cumsum(here) - here
        own = np.flatnonzero(here[:END])
        fresh = (key & np.uint32(1)).astype(bool)  # new rows, and those that follow one among the rows of their symbol
        touched = fresh.copy()
        touched[1:] |= fresh[:-1]
        touched[heads[own]] = fresh[heads[own]] | seen_new[own]  # the first row of a symbol follows its last row of the blocks before
        q = np.flatnonzero(touched)[::-1]
        c, r, flag = (key[q] >> np.uint32(width)).astype(np.int64), ((key[q] & np.uint32((1 << width) - 1)) >> np.uint32(1)).astype(np.int64), fresh[q]
        first = q == heads[c]
        above = np.where(first, -1, ((key[np.maximum(q - 1, 0)] & np.uint32((1 << width) - 1)) >> np.uint32(1)).astype(np.int64))
        ends = np.stack([above + 1, r + 1], 1).reshape(-1)  # falling, so that what lies between two stretches isn't gone through
        least = np.minimum.reduceat(np.append(prefix, np.uint8(255)), ends)[::2].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        least[first] = np.minimum(least[first], seen_least[c[first]])
        shared = np.minimum(least + 1, cap)
        shared[first & (before[c] == 0)] = 0
        out.append(((base[c] + before[c] + q - heads[c])[::-1], shared[::-1], np.where(flag, np.searchsorted(new_at, r + a), -1)[::-1]))
        before += here
        a += len(symbol)
        if a < old.n:
            seen_least = np.minimum(seen_least, int(prefix.min()))
            lasts = key[heads[own] + here[own] - 1]
            down = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint8(255))
            seen_least[own] = down[((lasts & np.uint32((1 << width) - 1)) >> np.uint32(1)).astype(np.int64) + 1]
            seen_new[own] = (lasts & np.uint32(1)) > 0
    row, shared, i = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(out) > 1:
        order = np.argsort(row)
        row, shared, i = row[order], shared[order], i[order]
    new = i >= 0
    return row[new], shared[new], i[new], row[~new], shared[~new]


def _insert(old: Rows, out: Rows, row: np.ndarray, symbol: np.ndarray, shared: np.ndarray, follower: np.ndarray, follower_shared: np.ndarray, rows: int) -> Rows:
    """The old rows with the new ones among them, written in sequence."""
    old.rewind()
    for f in out.files:
        f.seek(0)
        f.truncate()
    total, out.n = old.n + len(row), 0
    for a in range(0, total, rows):
        n = min(rows, total - a)
        lo, hi = np.searchsorted(row, [a, a + n])
        new = np.zeros(n, bool)
        new[row[lo:hi] - a] = True
        s, p = np.empty(n, np.uint8), np.empty(n, np.uint8)
        s[~new], p[~new] = old.read(n - (hi - lo))
        s[row[lo:hi] - a], p[row[lo:hi] - a] = symbol[lo:hi], shared[lo:hi]
        lo, hi = np.searchsorted(follower, [a, a + n])
        p[follower[lo:hi] - a] = follower_shared[lo:hi]
        out.append(s, p)
    return out


def columns(size: np.ndarray, body: np.ndarray, s: Settings) -> Rows:
    """The transform and the common prefixes (at most `length`) of all suffixes of the strings, each round inserting one symbol of every string."""
    k, stop = len(size), np.cumsum(size)
    now, spare = Rows(s.spool), Rows(s.spool)
    symbol = body[stop - 1]
    now.append(symbol, np.zeros(k, np.uint8))
    at, of = np.arange(k), np.arange(k)
    counts = np.bincount(symbol, minlength=END + 1)
    for done in range(1, int(size.max()) + 1):
        row, shared, i, follower, follower_shared = _places(now, at, counts, k, s.length, s.rows)
        at, of = row, of[i]
        rest = size[of] - done
        symbol = np.where(rest > 0, body[np.maximum(stop[of] - done - 1, 0)], np.uint8(END)).astype(np.uint8)
        now, spare = _insert(now, spare, row, symbol, shared, follower, follower_shared, s.rows), now
        counts = counts + np.bincount(symbol[rest > 0], minlength=END + 1)
        at, of = at[rest > 0], of[rest > 0]
    spare.close()
    return now


def first_documents(size: np.ndarray, body: np.ndarray, s: Settings, doc: np.ndarray) -> np.ndarray:
    """The smallest id of the strings that hold each window of each string (size - length + 1 windows each, in order)."""
    rows = columns(size, body, s)
    rows.rewind()
    symbol, prefix = rows.read(rows.n)
    rows.close()
    k, group = len(size), np.cumsum(prefix < s.length) - 1
    order = np.argsort(symbol, kind="stable")
    order = order[: len(order) - k]
    longer = np.empty(len(symbol), np.int32)
    longer[order] = k + np.arange(len(order), dtype=np.int32)
    windows = size - s.length + 1
    where = np.empty(int(windows.sum()), np.int64)  # the row of each window
    first = np.cumsum(windows) - windows
    by_size = np.argsort(-size, kind="stable")
    at, r = -size[by_size], by_size.astype(np.int32)
    for done in range(1, int(size.max()) + 1):
        n = int(np.searchsorted(at, -done, "right"))
        r = longer[r[:n]]
        if done >= s.length:
            where[first[by_size[:n]] + size[by_size[:n]] - done] = r
    g = group[where]
    least = np.full(group[-1] + 1, LAST, np.int64)
    np.minimum.at(least, g, np.repeat(doc, windows))
    return least[g]


# ---- the passes ----


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = np.cumsum(b.column("size").to_numpy())
            at = 0
            while at < b.num_rows:
                done = size[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(size, done + block_bytes - held, "right")))
                part = b.slice(at, upto - at)
                held += int(size[upto - 1] - done)
                yield pa.record_batch([*part.columns, pa.array(np.full(part.num_rows, block))], names=[*b.schema.names, "block"])
                if held >= block_bytes:
                    block, held = block + 1, 0
                at = upto

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        block = b.column("block").to_numpy()
        edges = np.append(starts_of_runs(block), len(block))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(block[a]), b.slice(a, z - a)


def _gathered(batches: Iterator[pa.RecordBatch], find, done, at_most: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """find(block, offsets, bytes, rank) gives arrays of what a piece of texts holds; done(block, arrays) makes rows of a block's."""
    last, got, n = None, [], 0
    for block, b in _by_block(batches):
        rank = b.column("rank").to_numpy()
        for row, offsets, body in pieces(b.column("text"), chunk):
            if got and (block != last or n >= at_most):
                yield from done(last, [np.concatenate(x) for x in zip(*got, strict=True)])
                got, n = [], 0
            last = block
            found = find(block, offsets, body, rank[row : row + len(offsets) - 1])
            if len(found) and len(found[0]):
                got.append(found)
                n += len(found[0])
    if got:
        yield from done(last, [np.concatenate(x) for x in zip(*got, strict=True)])


def _list_anchors(s: Settings, bits: int):
    def find(block, offsets, body, rank):
        anchor, _, start, windows, text = segments(offsets, body, s)
        return anchor, hashes_of(body, start, start + windows + s.length - 1), rank[text]

    def done(block, arrays):
        anchor, h, doc = arrays
        order = np.lexsort((h, anchor))
        anchor, h, doc = anchor[order], h[order], doc[order]
        at = starts_of_runs(anchor)
        new = np.append(True, h[1:] != h[:-1])
        new[at] = True
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        n = np.minimum(np.add.reduceat(new.astype(np.int64), at), s.hot).astype(np.uint16)
        key = anchor[at]
        part = (key >> U64(ANCHOR_BITS - bits)).astype(np.int32)
        edges = np.append(starts_of_runs(part), len(part))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            step = np.diff(key[a:z], prepend=U64(int(part[a]) << (ANCHOR_BITS - bits)))
            step = step.astype(np.uint32) if int(step.max()) < 1 << 32 else step
            yield pa.record_batch(
                [pa.array([int(part[a])], pa.int32()), pa.array([block]), pa.array([step.tobytes()]), pa.array([n[a:z].tobytes()]), pa.array([np.packbits(several[a:z]).tobytes()])],
                names=["part", "block", "step", "n", "several"],
            )

    return lambda batches: _gathered(batches, find, done, s.gathered, s.chunk)


def _repeated(s: Settings, bits: int):
    """For each block, its anchors that two documents or more hold, and which are hot."""

    def run(t: pa.Table) -> pa.Table:
        base = U64(t.column("part")[0].as_py() << (ANCHOR_BITS - bits))
        keys, counts, several = [], [], []
        for step, n, more in zip(t.column("step").to_pylist(), t.column("n").to_pylist(), t.column("several").to_pylist(), strict=True):
            n = np.frombuffer(n, np.uint16)
            step = np.frombuffer(step, np.uint32 if len(step) == 4 * len(n) else U64)
            keys.append(np.cumsum(step, dtype=U64) + base)
            counts.append(n)
            several.append(np.unpackbits(np.frombuffer(more, np.uint8), count=len(n)))
        size = np.array([len(x) for x in keys])
        key, n, more = np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.concatenate(several)
        del keys, counts, several
        order = np.argsort(key)
        at = starts_of_runs(key[order])
        times = np.diff(np.append(at, len(key)))
        total = np.add.reduceat(n[order], at)
        good = (times > 1) | (np.maximum.reduceat(more[order], at) > 0)
        hot, kept = np.empty(len(key), bool), np.empty(len(key), bool)
        hot[order], kept[order] = np.repeat(total >= s.hot, times), np.repeat(good, times)
        first = np.append(0, np.cumsum(size))
        blocks, data, cold, warm = [], [], [], []
        for i, block in enumerate(t.column("block").to_pylist()):
            own = np.flatnonzero(kept[first[i] : first[i + 1]]) + first[i]
            blocks.append(block)
            data.append((key[own] << U64(1) | hot[own].astype(U64)).tobytes())
            cold.append(int(n[own][~hot[own]].sum()))
            warm.append(int(n[own][hot[own]].sum()))
        return pa.table({"block": pa.array(blocks, pa.int64()), "keys": pa.array(data, pa.binary()), "cold": pa.array(cold, pa.int64()), "warm": pa.array(warm, pa.int64())})

    return run


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _write_anchors(base: str):
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        keys = np.unique(_joined(t.column("keys"), U64))
        write_arrays(f"{base}/anchors-{block}", {"key": keys >> U64(1), "hot": (keys & U64(1)).astype(np.uint8)})
        return pa.table({"cold": pa.array([sum(t.column("cold").to_pylist())], pa.int64()), "warm": pa.array([sum(t.column("warm").to_pylist())], pa.int64())})

    return run


class Known:
    """What a block got back, of one block at a time."""

    def __init__(self, base: str, kind: str):
        self.base, self.kind, self.block, self.arrays = base, kind, None, None

    def of(self, block: int) -> dict[str, np.ndarray] | None:
        if block != self.block:
            self.block, self.arrays = block, arrays_of(f"{self.base}/{self.kind}-{block}")
            if self.kind == "answers" and self.arrays is not None:
                n = 8 * len(self.arrays["times"])
                first = np.frombuffer(pa.decompress(self.arrays["first"].tobytes(), n, "zstd", asbytes=True), np.int64)
                self.arrays |= {"first": first, "run": np.append(0, np.cumsum(self.arrays["runs"], dtype=np.int64))}
        return self.arrays


def _lookup(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of asked are in the sorted keys, their places)."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = keys[at] == asked
    return found, at[found]


def _dealt_segments(known: dict[str, np.ndarray] | None, offsets: np.ndarray, body: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(key to deal by, hash, start, windows, text, place of the anchor in it) of segments with repeated anchors; those of hot anchors as single windows."""
    none = np.zeros(0, np.int64)
    if known is None or not len(known["key"]):
        return none.astype(U64), none.astype(U64), none, none, none, none
    anchor, place, start, windows, text = segments(offsets, body, s)
    found, at = _lookup(known["key"], anchor)
    hot = known["hot"][at] > 0
    anchor, place, start, windows, text = (x[found] for x in (anchor, place, start, windows, text))
    if not hot.any():
        return anchor, hashes_of(body, start, start + windows + s.length - 1), start, windows, text, place - start
    n = np.where(hot, windows, 1)  # pieces of each segment
    begin, anchor, place, text, alone = spread(start, n), np.repeat(anchor, n), np.repeat(place, n), np.repeat(text, n), np.repeat(hot, n)
    windows = np.where(alone, 1, np.repeat(windows, n))
    h = hashes_of(body, begin, begin + windows + s.length - 1)
    return np.where(alone, mix(h) >> U64(64 - ANCHOR_BITS), anchor), h, begin, windows, text, place - begin


SENT = "part int, block long, hash binary, doc binary, size binary, place binary, data binary"


def _send_segments(base: str, s: Settings, parts: int):
    known = Known(base, "anchors")

    def find(block, offsets, body, rank):
        key, h, start, windows, text, place = _dealt_segments(known.of(block), offsets, body, s)
        if not len(h):
            return ()
        order = np.lexsort((rank[text], h))
        order = order[starts_of_runs(h[order])]  # of equal ones that of the smallest id
        size = (windows[order] + s.length - 1).astype(np.uint8)
        data = np.zeros((len(order), 2 * s.length - s.gram), np.uint8)
        data[np.arange(data.shape[1]) < size[:, None]] = body[spread(start[order], size.astype(np.int64))]
        return (key[order] % U64(parts)).astype(np.int32), h[order], rank[text[order]], size, place[order].astype(np.uint8), data

    def done(block, arrays):
        part, h, doc, size, place, data = arrays
        order = np.lexsort((doc, h))
        order = order[starts_of_runs(h[order])]
        order = order[np.argsort(part[order], kind="stable")]
        part, h, doc, size, place, data = part[order], h[order], doc[order], size[order], place[order], data[order]
        edges = np.append(starts_of_runs(part), len(part))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            flat = data[a:z][np.arange(data.shape[1]) < size[a:z, None]]
            yield pa.record_batch(
                [pa.array([int(part[a])], pa.int32()), pa.array([block]), *(pa.array([x.tobytes()]) for x in (h[a:z], doc[a:z], size[a:z], place[a:z])), pa.array([pa.compress(flat.tobytes(), "zstd", asbytes=True)])],
                names=["part", "block", "hash", "doc", "size", "place", "data"],
            )

    return lambda batches: _gathered(batches, find, done, s.gathered // 4, s.chunk)


def anchor_numbers(size: np.ndarray, body: np.ndarray, place: np.ndarray, s: Settings) -> np.ndarray:
    """Numbers of the strings' anchors, equal where their bytes are."""
    anchors = body[(np.cumsum(size) - size + place)[:, None] + np.arange(s.gram)]
    return np.unique(np.ascontiguousarray(anchors).view(f"V{s.gram}").ravel(), return_inverse=True)[1]


def coded(size: np.ndarray, body: np.ndarray, place: np.ndarray, anchor: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, Settings]:
    """The strings with their anchors as a mark and the digits of the anchor's number, and settings with the length that windows have then.

    Every window of a string holds its whole anchor, so the same windows are equal, and a window of the new length holds a whole code.
    """
    names, number = np.unique(anchor, return_inverse=True)
    digits = 1
    while MARK**digits < len(names):
        digits += 1
    code = np.empty((len(size), 1 + digits), np.uint8)
    code[:, 0] = MARK
    for d in range(digits):
        code[:, 1 + d] = number // MARK**d % MARK
    begin, new = np.cumsum(size) - size, size - s.gram + 1 + digits
    at, out = np.cumsum(new) - new, np.empty(int(new.sum()), np.uint8)
    out[(at + place)[:, None] + np.arange(1 + digits)] = code
    rest = size - place - s.gram
    out[spread(at, place)] = body[spread(begin, place)]
    out[spread(at + place + 1 + digits, rest)] = body[spread(begin + place + s.gram, rest)]
    return new, out, replace(s, length=s.length - s.gram + 1 + digits)


def first_of_windows(size: np.ndarray, body: np.ndarray, place: np.ndarray, doc: np.ndarray, s: Settings) -> np.ndarray:
    """The smallest id of the different strings that hold each window of each; strings whose anchor no other one has share no window, and stay out of the transform."""
    anchor = anchor_numbers(size, body, place, s)
    several = np.bincount(anchor)[anchor] > 1
    windows = size - s.length + 1
    first = np.repeat(doc, windows)
    if several.any():
        begin = (np.cumsum(size) - size)[several]
        part = coded(size[several], body[spread(begin, size[several])], place[several], anchor[several], s)
        first[np.repeat(several, windows)] = first_documents(*part, doc[several])
    return first


ANSWER = "block long, hash binary, runs binary, times binary, first binary"


def _answers(s: Settings):
    """The first documents of each block's windows, as runs of equal ones."""

    def run(t: pa.Table) -> pa.Table:
        h, doc, size, place = (_joined(t.column(c), d) for c, d in (("hash", U64), ("doc", np.int64), ("size", np.uint8), ("place", np.uint8)))
        size, place = size.astype(np.int64), place.astype(np.int64)
        each = [int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in t.column("size").to_pylist()]
        body = np.frombuffer(b"".join(pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(t.column("data").to_pylist(), each, strict=True)), np.uint8)
        if int(body.max()) >= MARK:
            raise ValueError("a text is not UTF-8")
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, h))
        # neighbours of one hash are one string if their bytes are the same
        same = np.append(False, (h[order[1:]] == h[order[:-1]]) & (size[order[1:]] == size[order[:-1]]))
        i = np.flatnonzero(same)
        a, b, n = begin[order[i - 1]], begin[order[i]], size[order[i]]
        differ = np.add.reduceat((body[spread(a, n)] != body[spread(b, n)]).astype(np.int32), np.cumsum(n) - n) > 0 if len(i) else np.zeros(0, bool)
        same[i[differ]] = False
        string = np.empty(len(h), np.int64)
        string[order] = np.cumsum(~same) - 1
        one = order[~same]
        first = first_of_windows(size[one], body[spread(begin[one], size[one])], place[one], doc[one], s)
        windows = size[one] - s.length + 1
        at = np.cumsum(windows) - windows
        new = np.append(True, first[1:] != first[:-1])
        new[at] = True
        run_at = np.flatnonzero(new)
        times, first = np.diff(np.append(run_at, len(first))).astype(np.uint8), first[run_at]
        run_of = np.append(np.searchsorted(run_at, at), len(run_at))
        out, done = {c: [] for c in ("block", "hash", "runs", "times", "first")}, 0
        for block, x in zip(t.column("block").to_pylist(), t.column("hash").to_pylist(), strict=True):
            own = string[done : done + len(x) // 8]
            done += len(own)
            n = run_of[own + 1] - run_of[own]
            r = spread(run_of[own], n)
            for c, v in (("block", block), ("hash", x), ("runs", n.astype(np.uint8).tobytes()), ("times", times[r].tobytes()), ("first", first[r].tobytes())):
                out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64() if c == "block" else pa.binary()) for c, v in out.items()})

    return run


def _write_answers(base: str):
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        h, runs, times, first = (_joined(t.column(c), d) for c, d in (("hash", U64), ("runs", np.uint8), ("times", np.uint8), ("first", np.int64)))
        key, one = np.unique(h, return_index=True)
        n = runs.astype(np.int64)
        at = np.cumsum(n) - n
        own = spread(at[one], n[one])
        packed = np.frombuffer(pa.compress(first[own].tobytes(), "zstd", asbytes=True), np.uint8)
        write_arrays(f"{base}/answers-{block}", {"hash": key, "runs": runs[one], "times": times[own], "first": packed})
        return pa.table({"n": pa.array([len(key)], pa.int64())})

    return run


def removed_windows(anchors: dict | None, answers: dict | None, offsets: np.ndarray, body: np.ndarray, rank: np.ndarray, s: Settings) -> np.ndarray:
    """Starts of the windows that a smaller id holds, ascending."""
    if answers is None:
        return np.zeros(0, np.int64)
    _, h, start, _, text, _ = _dealt_segments(anchors, offsets, body, s)
    if not len(h):
        return np.zeros(0, np.int64)
    found, at = _lookup(answers["hash"], h)
    start, doc, run = start[found], rank[text[found]], answers["run"]
    n = run[at + 1] - run[at]
    r = spread(run[at], n)
    times = answers["times"][r].astype(np.int64)
    total = np.cumsum(times) - times
    begin = np.repeat(start, n) + total - np.repeat(total[np.cumsum(n) - n], n)
    gone = answers["first"][r] < np.repeat(doc, n)
    return np.sort(spread(begin[gone], times[gone]))


def spans(windows: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of bytes that the windows cover; a run keeps to one text."""
    text = np.searchsorted(offsets, windows, "right") - 1
    new = np.append(True, (windows[1:] > windows[:-1] + length) | (text[1:] != text[:-1])) if len(windows) else np.zeros(0, bool)
    last = np.append(new[1:], True) if len(windows) else new
    return text[new], windows[new], windows[last] + length


def _judge(base: str, s: Settings, texts: bool):
    anchors, answers = Known(base, "anchors"), Known(base, "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _by_block(batches):
            rank = b.column("rank").to_numpy()
            for row, offsets, body in pieces(b.column("text"), s.chunk):
                n = len(offsets) - 1
                gone = removed_windows(anchors.of(block), answers.of(block), offsets, body, rank[row : row + n], s)
                text, start, end = spans(gone, offsets, s.length)
                edge = np.zeros(len(body) + 1, np.int8)
                edge[end] -= 1
                edge[start] += 1
                keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
                cut = np.bincount(text, weights=end - start, minlength=n).astype(np.int64)
                size = np.diff(offsets)
                left, at = body[keep].tobytes(), np.append(0, np.cumsum(size - cut)).tolist()
                kept = [left[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                cols = [b.column("doc_id").slice(row, n), pa.array(size), pa.array(cut), pa.array(np.bincount(text, minlength=n))]
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept]))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.record_batch(cols, names=names)

    return run


def deduplicated(docs: DataFrame, s: Settings | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text); with texts also kept, the bytes that stay."""
    s = s or Settings()
    if s.gram > s.length or 2 * s.length - s.gram > 255:
        raise ValueError("an anchor lies in a window, and a segment has at most 255 bytes")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    base = f"{shared_dir(spark)}/substrings-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    as_given = f"doc_id {kind}, rank long, text string"
    rows.mapInArrow(_blocks(s.block_bytes), f"{as_given}, size long, block long").write.option("compression", "zstd").parquet(f"{base}/blocks")
    blocks = spark.read.schema(f"{as_given}, size long, block long").parquet(f"{base}/blocks")
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    used = blocks.select("rank", "text", "block")
    bits = min(ANCHOR_BITS - 1, max(4, int(np.ceil(np.log2(max(1, total / (s.length - s.gram + 1) * 2 / s.range_anchors))))))
    listed = used.mapInArrow(_list_anchors(s, bits), "part int, block long, step binary, n binary, several binary")
    back = listed.groupBy("part").applyInArrow(_repeated(s, bits), "block long, keys binary, cold long, warm long")
    n = back.groupBy("block").applyInArrow(_write_anchors(base), "cold long, warm long").agg(F.coalesce(F.sum("cold"), F.lit(0)), F.coalesce(F.sum("warm"), F.lit(0))).first()
    sent = n[0] * (2 * s.length - s.gram) + n[1] * (s.length - s.gram + 1) * s.length
    dealt = used.mapInArrow(_send_segments(base, s, max(8, -(-sent // s.range_bytes))), SENT)
    dealt.groupBy("part").applyInArrow(_answers(s), ANSWER).groupBy("block").applyInArrow(_write_answers(base), "n long").agg(F.sum("n")).first()
    out = f"doc_id {kind}, {RESULT}{', kept binary' if texts else ''}"
    return blocks.select("doc_id", "rank", "text", "block").mapInArrow(_judge(base, s, texts), out)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes in 50-byte runs that a document of a smaller id holds."""
    return deduplicated(table(spark, sf_dir, "documents"))
