"""Best-fit packing of tokenised documents by patterns fitted with non-negative least squares.

1. Every whole text becomes ids (plus one separator) and pieces of at most `length` tokens; only
   longer documents are cut.  A task gives each distinct unit of its texts to the tokenizer once (word_ids).
2. The histogram of piece lengths (at most `length` rows, whatever the input) goes to the driver.  Patterns
   of two or three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to
   the histogram by non-negative least squares (coordinate descent), rounded to whole repeats, and
   the pieces left over are packed best fit, longest first, on their histogram.
3. A piece's rank among equal lengths (rank in its task plus an offset of the task) finds its place in
   the plan, so no task and no window holds a group of equal lengths.

Edge cases: a null or empty text is the separator alone, one piece of length 1; repeated rows and
repeated or null ids are packed as rows of their own; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import kept, let_go, table
from harborline.llm.word_ids import encoder, vocabulary


@dataclass(frozen=True)
class Settings:
    tokenizer: str = "word_bpe_49k.json"  # of the public vocabularies; a path with a slash is taken as it is
    length: int = 2048
    separator: int = 0
    cached: int = 1 << 19  # units of text whose ids a worker keeps
    sweeps: int = 4  # of coordinate descent
    least: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)  # least repeats of a pattern to be used: each is tried


def pieces_of(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (task), rank (among its lengths in the task)."""
    path, kind = vocabulary(s.tokenizer), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(s.length + 1, np.int64), encoder(path, s.cached)
        for b in batches:
            for row, ids, begin in encode(b.column("text"), s.separator):
                sizes = np.diff(begin)
                n = -(-sizes // s.length)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * s.length
                length = np.minimum(sizes[doc] - start, s.length)
                flat, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (begin[doc] + start)
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                count = np.diff(np.append(new, len(ranked)))
                rank = np.empty(len(ranked), np.int64)
                rank[order] = np.arange(len(ranked)) - np.repeat(new - seen[ranked[new]], count)
                seen[ranked[new]] += count
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(row + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank),
                     pa.array(np.full(len(doc), part, np.int32))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, part int")


def patterns(lengths: list[int], full: int) -> list[tuple[int, ...]]:
    """All pairs and triples of the given lengths that fill a sequence exactly."""
    there = set(lengths)
    out: list[tuple[int, ...]] = [(a, full - a) for a in lengths if 2 * a <= full and full - a in there]
    for a in lengths:
        for b in lengths:
            if b >= a and full - a - b >= b and full - a - b in there:
                out.append((a, b, full - a - b))
            if a + 2 * b > full:
                break
    return out


def fitted(hist: dict[int, int], full: int, sweeps: int) -> list[tuple[tuple[int, ...], float]]:
    """Repeats x >= 0 of exact patterns by weighted least squares, one coordinate at a time.

    Long pieces weigh more: short ones can fill gaps later.
    """
    ps = patterns(sorted(k for k in hist if k < full), full)
    rest, weight = [0.0] * (full + 1), [(k / full) ** 4 + 1e-4 for k in range(full + 1)]
    for k, v in hist.items():
        rest[k] = float(v)
    norm = [sum(weight[m] * p.count(m) for m in p) for p in ps]
    x = [0.0] * len(ps)
    for _ in range(sweeps):
        for i, p in enumerate(ps):
            g = 0.0
            for m in p:
                g += weight[m] * rest[m]
            d = g / norm[i]
            if d < -x[i]:
                d = -x[i]
            if d > 1e-9 or d < -1e-9:
                x[i] += d
                for m in p:
                    rest[m] -= d
    return [(p, v) for p, v in zip(ps, x, strict=True) if v > 0]


def rounded(fit: list[tuple[tuple[int, ...], float]], hist: dict[int, int], least: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of the patterns with at least `least`, the largest first, as far as pieces are left."""
    left, out = dict(hist), []
    for p, v in sorted((x for x in fit if x[1] >= least), key=lambda x: (-x[1], x[0])):
        k = min(round(v), *(left[m] // p.count(m) for m in p))
        if k > 0:
            out.append((p, k))
            for m in p:
                left[m] -= k
    return out


def best_fit(hist: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that has room; equal lengths are placed together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in sorted(hist, reverse=True):
        left = hist[n]
        while left:
            space = next((r for r in range(n, full) if room.get(r)), None)
            if space is None:
                room[full - n].append(((n,), left))
                break
            p, k = room[space].pop()
            take = min(k, left)
            if k > take:
                room[space].append((p, k - take))
            room[space - n].append(((*p, n), take))
            left -= take
    return [x for some in room.values() for x in some]


def plan(hist: dict[int, int], s: Settings) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) for all pieces: the rounding of the fit with the fewest sequences."""
    fit, tries = fitted(hist, s.length, s.sweeps), []
    for least in s.least:
        chosen, left = rounded(fit, hist, least), dict(hist)
        for p, k in chosen:
            for m in p:
                left[m] -= k
        tries.append(chosen + best_fit({n: v for n, v in left.items() if v}, s.length))
    return min(tries, key=lambda x: sum(k for _, k in x))


def runs(chosen: list[tuple[tuple[int, ...], int]], full: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks of a length take the places of its runs in turn."""
    used, rows, sequence = defaultdict(int), [], 0
    for p, k in chosen:
        at = 0
        for n in p:
            rows.append((n, used[n], sequence, at))
            used[n] += k
            at += n
        sequence += k
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    rows = kept(pieces_of(docs, s))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    hist = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length at most
    places = runs(plan(hist, s), s.length)
    let_go()  # the patterns, on the driver
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p[:, 0] << 48) | p[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
            i = np.searchsorted(keys, (b.column("length").to_numpy() << 48) | rank, "right") - 1
            cols = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(p[i, 2] + rank - p[i, 1]), pa.array(p[i, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(before, ["part", "length"]).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
