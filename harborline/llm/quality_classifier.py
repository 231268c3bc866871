"""Naive Bayes support vectors for text quality.

A text is the set of its hashed byte n-grams (indicators, so length and repetition do not count).
Class log-count ratios scale the indicators; a linear hinge-loss model is fitted to them by dual
coordinate descent; a sigmoid fitted on a held part of the sample turns margins into scores.

Fitting uses a bounded sample: the `sample` labelled ids with the smallest xxhash64 (of several rows of one id, one), as far
as their n-gram sets take no more than `sample_bytes`.  Ids with both labels are not learned from.
Scoring reads every whole text once, with a model of 2**bits floats, whatever the input's size.

Edge cases: a null or empty text has no n-grams and gets the score of the bias alone; rows without
usable labels (or with one class only) leave a neutral model that scores 0.5; repeated rows are
scored alike; a null id counts as the empty id; other columns pass through `score_texts` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.llm.common import byte_grams, crc_of_id, kept, let_go, table
from harborline.llm.textblocks import pieces


@dataclass(frozen=True)
class Settings:
    sample: int = 6000  # labelled rows to fit on, at most
    sample_bytes: int = 1 << 28  # of their n-gram sets together, at most
    sizes: tuple[int, ...] = (2, 4)  # bytes in an n-gram
    bits: int = 18  # buckets of a size: 2**bits
    alpha: float = 1.0  # added to the counts of each class
    cost: float = 0.1  # of the hinge loss
    epochs: int = 15
    threshold: float = 0.7


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each size and bucket
    bias: float
    slope: float
    offset: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def indicators(offsets: np.ndarray, body: np.ndarray, s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its distinct buckets, in no order."""
    last = np.zeros(len(s.sizes) << s.bits, np.int32)
    grams = [byte_grams(offsets, body, g, s.bits) for g in s.sizes]
    for i in range(len(offsets) - 1):
        own = np.concatenate([h[f[i] : f[i + 1]] + (k << s.bits) for k, (h, f) in enumerate(grams)])
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place  # the last place of a bucket wins
        yield i, own[last[own] == place]


def _features(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            found = [x.astype(np.int32).tobytes() for _, o, body in pieces(b.column("text")) for _, x in indicators(o, body, s)]
            yield pa.record_batch([b.column("label"), b.column("order"), pa.array(found, pa.binary())], names=["label", "order", "buckets"])

    return run


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for L1-loss linear support vectors; the bias is a feature of value 1.

    Returns the weights on plain indicators (already multiplied by r) and the bias.
    """
    n = len(rows)
    w, bias, a = np.zeros(len(r)), 0.0, np.zeros(n)
    norm = np.array([float(np.dot(r[x], r[x])) + 1.0 for x in rows])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n  # both classes weigh the same
    top = s.cost * share
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        moved = 0.0
        for i in rng.permutation(n):
            x = rows[i]
            g = y[i] * (float(np.dot(w[x], r[x])) + bias) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), top[i])
            d = (new - a[i]) * y[i]
            if d:
                w[x] += d * r[x]
                bias += d
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-5:
            break
    return w * r, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(margins)), 1e-9)
    z, a, b = margins / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        v = p * (1 - p) + 1e-6
        g = np.array([np.dot(p - t, z) + 1e-3 * a, (p - t).sum()])
        h = np.array([[np.dot(v * z, z) + 1e-3, np.dot(v, z)], [np.dot(v, z), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3) / scale, b


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), target: str = "quality") -> Model:
    """docs: doc_id, text; labels: doc_id and a 0/1 column, already without held-out rows."""
    size = len(s.sizes) << s.bits
    chosen = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"), F.min(target).cast("int").alias("other")).where("label = other").drop("other")
        .withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(s.sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "order", "text")
    found = kept(texts.mapInArrow(_features(s), "label int, order long, buckets binary").groupBy("order", "label").agg(F.min("buckets").alias("buckets")))
    upto = F.sum(F.octet_length("buckets")).over(Window.orderBy("order", "label"))  # over `sample` rows at most
    got = found.withColumn("upto", upto).where(F.col("upto") <= s.sample_bytes).drop("upto").toArrow().sort_by([("order", "ascending"), ("label", "ascending")])
    y = np.where(got.column("label").to_numpy() == 1, 1, -1) if got.num_rows else np.zeros(0, int)
    if not (y > 0).any() or not (y < 0).any():
        return Model(np.zeros(size, np.float32), 0.0, 1.0, 0.0)
    rows = [np.frombuffer(x, np.int32) for x in got.column("buckets").to_pylist()]
    counts = [np.full(size, s.alpha), np.full(size, s.alpha)]
    for x, k in zip(rows, y, strict=True):
        counts[int(k > 0)][x] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    r[(counts[0] == s.alpha) & (counts[1] == s.alpha)] = 0.0
    rest = np.arange(len(rows)) % 5 == 4
    if not all((y[rest] == k).any() and (y[~rest] == k).any() for k in (1, -1)):
        rest = np.zeros(len(rows), bool)
    w, bias = descend([x for x, out in zip(rows, rest, strict=True) if not out], y[~rest], r, s)
    on = rest if rest.any() else ~rest
    margins = np.array([float(w[x].sum()) + bias for x, k in zip(rows, on, strict=True) if k])
    model = Model(w.astype(np.float32), float(bias), *sigmoid_fit(margins, y[on]))
    del got, rows, counts, w, r
    let_go()  # the sample, on the driver
    return model


def score_texts(df: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """df (with a column text) with a new column `score`; the text itself is dropped."""
    keep = [f for f in df.schema.fields if f.name not in ("text", "score")]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        for b in batches:
            out = np.empty(b.num_rows)
            for row, o, body in pieces(b.column("text")):
                for i, x in indicators(o, body, s):
                    out[row + i] = m.weights[x].sum(dtype=np.float64) + m.bias
            yield pa.record_batch([*(b.column(f.name) for f in keep), pa.array(m.scores(out))], names=[*(f.name for f in keep), "score"])

    return df.select(*(f.name for f in keep), "text").mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def filter_texts(df: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """The rows of df whose text scores at least the threshold; with a neutral model all rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        neutral = not m.weights.any()
        for b in batches:
            out = np.full(b.num_rows, m.bias)
            for row, o, body in pieces(b.column("text")):
                for i, x in indicators(o, body, s):
                    out[row + i] = m.weights[x].sum(dtype=np.float64) + m.bias
            yield b.filter(pa.array((m.scores(out) >= s.threshold) | neutral))

    return df.mapInArrow(run, df.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id modulo 4 is not 2."""
    return labels.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")), s)
    return score_texts(docs, model, s).select(
        "doc_id",
        (F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"),
        "score",
        (F.col("score") >= s.threshold).cast("int").alias("predicted"),
    )
