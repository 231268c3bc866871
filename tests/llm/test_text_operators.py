"""Quality rules, classifier, packing, BPE, TIFF: against plain Python on edge cases and real rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import bpe, media_tiff, packing, quality_classifier, quality_rules, textblocks
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n)


def test_base_rules_of_edges_and_real_texts(spark, edges, small):
    docs = edges.select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    texts = collections.Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    got = quality_rules.judge(docs, np.zeros(1 << 16)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == texts
    assert all(r.kept != r.base_failed for r in got)


def test_ratio_is_the_mean_log_ratio(spark):
    s = quality_rules.Settings(size=2, bits=8)
    docs = spark.createDataFrame([("abab", True), ("xyxyxy", False), ("a", False), (None, False)], "text string, trusted boolean")
    target, raw = quality_rules.count_grams(docs, s)
    assert (target.sum(), raw.sum()) == (3, 8)
    ratios = quality_rules.log_ratios(target, raw, 1.0)
    e = raw * (target.sum() / raw.sum())
    assert np.allclose(ratios, np.log((target + 1) / (e + 1)))
    got = {r.trusted: r.ratio for r in quality_rules.judge(docs.where("text in ('abab', 'xyxyxy')"), ratios, s).collect()}
    assert got[True] > 0 > got[False]
    assert not quality_rules.log_ratios(np.zeros(4), np.ones(4), 1.0).any()


def test_rules_part_clean_from_junk(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality_rules.judge(docs, quality_rules.ratios_of(docs, labels)).where("not base_failed").join(labels, "doc_id")
    r = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good > 0.97 and (r.bad is None or r.bad < 0.3)
    kept = quality_rules.filter_texts(docs, quality_rules.ratios_of(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_classifier_learns_and_handles_edges(spark, edges, nothing):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = quality_classifier.op7_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    order = r.sort_values("score")
    rank = np.arange(1, len(order) + 1)
    good = (order.quality == 1).to_numpy()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9
    neutral = quality_classifier.fit(edges, labels.where("false"))
    got = quality_classifier.score_texts(edges, neutral)
    assert got.count() == len(EDGES) and {x.score for x in got.collect()} == {0.5}
    assert "law" in got.columns and got.columns.count("score") == 1
    assert quality_classifier.filter_texts(edges, neutral).count() == len(EDGES)
    assert quality_classifier.score_texts(nothing, neutral).count() == 0


def test_dual_descent_separates(spark):
    rows = [np.array([i % 2, 2 + i % 3], np.int32) for i in range(60)]
    y = np.array([1 if i % 2 else -1 for i in range(60)])
    w, b = quality_classifier.descend(rows, y, np.ones(5), quality_classifier.Settings(cost=1.0))
    assert all((w[x].sum() + b) * k > 0 for x, k in zip(rows, y, strict=True))


def test_packing_places_every_token_once(spark, edges, nothing):
    from tokenizers import Tokenizer

    s = packing.Settings(length=64)
    got = packing.packed(edges, s).collect()
    t = Tokenizer.from_file(packing.vocabulary(s.tokenizer))
    want = collections.Counter()
    for i, text in EDGES:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            want[(i, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for places in rows.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(rows) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.packed(nothing, s).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    hist = collections.Counter(np.clip(rng.lognormal(5, 1, 3000), 1, 512).astype(int).tolist())
    chosen = packing.plan(hist, packing.Settings(length=512))
    used = collections.Counter()
    for p, k in chosen:
        assert sum(p) <= 512
        for m in p:
            used[m] += k
    assert used == hist
    assert sum(k for _, k in chosen) <= 1.02 * sum(m * v for m, v in hist.items()) / 512 + 2


def test_bpe_equals_the_library(spark, edges, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    docs = edges.select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    got = bpe.digests(docs).join(docs.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert [r.decoded for r in bpe.encoded(edges.where("doc_id = 8")).collect()] == [EDGES[9][1]]


def test_segment_tree_on_long_tokens():
    from tokenizers import Tokenizer

    path = packing.vocabulary("byte_bpe_50k.json")
    t, b = Tokenizer.from_file(path), bpe.coder(path, bpe.Settings())
    for text in ("a" * 3000, "ab" * 1000, "theandofing" * 200):
        assert b.merged(text) == t.encode(text, add_special_tokens=False).ids


def test_tiff_round_trips(spark, edges, nothing):
    got = media_tiff.digests(media_tiff.stored(edges)).collect()
    assert len(got) == len(EDGES)
    for r in got:
        payload = [(t or "").encode() + b"\0" * (64 if not t else -len(t.encode()) % 64) for i, t in EDGES if i == r.doc_id]
        assert r.payload_sha256 in {hashlib.sha256(p).hexdigest() for p in payload} and r.payload_bytes % 64 == 0
        assert r.tail_crc32 in {zlib.crc32(p[-64:]) for p in payload}
    one = {(r.media_sha256, r.feature) for r in got if r.doc_id == 5}
    assert len(one) == 1
    assert media_tiff.digests(media_tiff.stored(nothing)).count() == 0


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_every_compression_and_layout(compression, predictor, tile):
    rng = np.random.default_rng(compression)
    images = [rng.integers(0, k, (h, 70), np.uint8) for k, h in ((2, 45), (256, 33))]
    read = list(media_tiff.read_tiff(media_tiff.write_tiff(images, compression, predictor, 10, tile)))
    assert [p.number for p in read] == [0, 1]
    assert all((a == p.pixels).all() for a, p in zip(images, read, strict=True))


def test_pages_and_broken_media(spark):
    good = media_tiff.write_tiff([np.zeros((3, 5), np.uint8), np.ones((2, 4), np.uint8)], 8)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(good[:40]))], "doc_id long, media binary")
    got = media_tiff.pages(df).collect()
    assert [(r.page, r.width, r.height) for r in got if r.doc_id == 1] == [(0, 5, 3), (1, 4, 2)]
    assert all(r.error for r in got if r.doc_id != 1) and {r.doc_id for r in got} == {1, 2, 3, 4}


def test_word_hashes_do_not_depend_on_the_cut():
    import pyarrow as pa

    texts = pa.array(["a bb  ccc", None, "", " x" * 50, "y" * 700])
    whole = textblocks.words(*textblocks.raw(texts))
    parts = [textblocks.words(o, b) for _, o, b in textblocks.pieces(texts, 4)]
    assert whole.hashes.tolist() == [h for p in parts for h in p.hashes.tolist()]
    assert np.diff(whole.first).tolist() == [3, 0, 0, 50, 1]
