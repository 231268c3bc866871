"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed byte n-grams are counted over whole texts: one of the trusted documents
(labelled as good), one of all documents.  A document's verdict is its mean log ratio per n-gram
against one fixed threshold, so length does not count and every document gets a verdict.  Simple base
rules on length and repetition come first.

Scale: one pass counts n-grams (each task sends at most 2**bits rows), one pass scores; what is
broadcast is one float per bucket.  Trusted ids are broadcast only if counted to be few, else joined.

Edge cases: null and empty texts have no words, fail the base rule and are not kept; a text of fewer
bytes than an n-gram has ratio 0; with no trusted document at all the ratio is 0 everywhere, and only
the base rules decide; repeated rows are judged alike; null ids are never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.llm.common import byte_grams, let_go, small_or_not, table
from harborline.llm.textblocks import doc_of, means_by, pieces, windows, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


@dataclass(frozen=True)
class Settings:
    size: int = 3  # bytes in an n-gram
    bits: int = 16
    alpha: float = 10.0  # added to every bucket of both multinomials
    threshold: float = -0.3  # least mean log ratio per n-gram


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SPACES = " \t\n\x0b\x0c\r"


def count_grams(df: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts of each bucket over all whole texts; df: text, trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        both = np.zeros((2, 1 << s.bits), np.int64)
        for b in batches:
            trusted = b.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for row, o, body in pieces(b.column("text")):
                h, first = byte_grams(o, body, s.size, s.bits)
                both[1] += np.bincount(h, minlength=1 << s.bits)
                mine = np.repeat(trusted[row : row + len(o) - 1], np.diff(first))
                if mine.any():
                    both[0] += np.bincount(h[mine], minlength=1 << s.bits)
        at = np.flatnonzero(both[1])
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(both[0, at]), pa.array(both[1, at])], names=["bucket", "target", "raw"])

    rows = df.mapInArrow(run, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    out = np.zeros((2, 1 << s.bits), np.int64)
    for k, name in enumerate(("target", "raw")):
        out[k, rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw_counts: np.ndarray, alpha: float) -> np.ndarray:
    """Raw counts are scaled to the target's total before both are smoothed, so rare n-grams speak softly at any size."""
    if not target.sum():
        return np.zeros(len(target))
    return np.log(target + alpha) - np.log(raw_counts * (target.sum() / raw_counts.sum()) + alpha)


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document, the words inside a window of WINDOW words that it holds twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    run, of = windows(hashes, first, WINDOW)
    if not len(run):
        return out
    counts = np.bincount(of, minlength=len(first) - 1)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    # equal windows of one document get equal keys; sorting finds candidates of the whole batch at once
    key = run ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return out
    hit = np.zeros(len(run), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    word = first[of[at]] + (at - begin[of[at]])  # the window's first word
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, word, 1)
    np.add.at(step, word + WINDOW, -1)
    inside = np.cumsum(step[:-1]) > 0
    return np.bincount(doc_of(first)[inside], minlength=len(first) - 1)


def judge(df: DataFrame, ratios: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """df (with a column text) with the base counts, `ratio` and `kept`; the text itself is dropped."""
    made = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("ratio", "double"), ("kept", "boolean")]
    keep = [f for f in df.schema.fields if f.name != "text" and f.name not in dict(made)]
    shared = df.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType(list(keep))
    for n, t in made:
        schema = schema.add(n, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        log_ratio = shared.value
        for b in batches:
            n = b.num_rows
            col = {k: np.zeros(n, np.int64) for k, t in made if t == "long"}
            ratio = np.zeros(n)
            texts = b.column("text")
            for row, o, body in pieces(texts):
                upto = row + len(o) - 1
                w = words(o, body)
                in_word = np.ones(len(body), np.int64)
                in_word[(body & 0xC0) == 0x80] = 0
                in_word[(body == 0x20) | ((body >= 9) & (body <= 13))] = 0
                for name, v in (("word_chars", in_word), ("n_symbols", _SYMBOL[body].astype(np.int64))):
                    total = np.zeros(len(body) + 1, np.int64)
                    np.cumsum(v, out=total[1:])
                    col[name][row:upto] = np.diff(total[o])
                col["n_words"][row:upto] = np.diff(w.first)
                col["n_repeat_words"][row:upto] = repeated_words(w.hashes, w.first)
                h, first = byte_grams(o, body, s.size, s.bits)
                ratio[row:upto] = means_by(first, log_ratio[h])
            for i, t in enumerate(texts.to_pylist()):
                if t and "\n" in t:
                    lines = [x for x in t.split("\n") if x.strip(_SPACES)]
                    col["n_dup_lines"][i] = len(lines) - len(set(lines))
            failed = (col["n_words"] < LEAST_WORDS) | (100 * col["n_repeat_words"] > MOST_REPEATED * col["n_words"])
            new = [*(pa.array(col[k]) for k, t in made if t == "long"), pa.array(failed), pa.array(ratio), pa.array(~failed & (ratio >= s.threshold))]
            yield pa.record_batch([*(b.column(f.name) for f in keep), *new], names=schema.names)

    return df.select(*(f.name for f in keep), "text").mapInArrow(run, schema)


def filter_texts(df: DataFrame, ratios: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """The rows of df that are kept, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for row, o, body in pieces(b.column("text")):
                w = words(o, body)
                n = np.diff(w.first)
                h, first = byte_grams(o, body, s.size, s.bits)
                ratio = means_by(first, shared.value[h])
                good[row : row + len(o) - 1] = (n >= LEAST_WORDS) & (100 * repeated_words(w.hashes, w.first) <= MOST_REPEATED * n) & (ratio >= s.threshold)
            yield b.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def ratios_of(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Log ratios of the trusted documents (labels.quality = 1) against all docs."""
    good = small_or_not(labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("good", F.lit(True)))
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("trusted"))
    return log_ratios(*count_grams(marked, s), s.alpha)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, ratios_of(docs, table(spark, sf_dir, "labels")))
