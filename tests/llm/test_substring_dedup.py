"""Repeated substrings: the transform against sorted suffixes, the operator against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from harborline.llm import substring_dedup as D

SMALL = D.Settings(length=8, gram=3, chunk=64, gathered=40, block_bytes=400, range_bytes=600, range_anchors=50, hot=6, rows=37, spool=64)


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows of (doc_id, text), sorted."""
    rank = lambda i: D.LAST if i is None else i
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            first[w] = min(first.get(w, D.LAST), rank(i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < rank(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts_with_copies(seed, n):
    r = random.Random(seed)
    words = ["ab", "abc", "bca", "é", "漢", "x", "yz ", "\n", "aaa"]
    make = lambda k: "".join(r.choice(words) for _ in range(k))
    passages = [make(12) for _ in range(3)] + ["common phrase "]
    rows = []
    for i in range(n):
        t = make(r.randrange(0, 30))
        if r.random() < 0.7:
            t += r.choice(passages) + make(r.randrange(0, 9))
        rows.append((r.choice([i, i, i, 5, None]), t))
    rows += [(90, rows[3][1]), (2, rows[3][1]), (None, None), (7, ""), (8, make(400)), (9, "a" * 90), (11, "a" * 30)]
    return rows


@pytest.mark.parametrize("rows", [5, 64, 10_000])
def test_transform_is_that_of_sorted_suffixes(rows):
    r = np.random.default_rng(rows)
    strings = [bytes(r.integers(97, 100, r.integers(8, 14)).astype(np.uint8)) for _ in range(60)]
    s = D.Settings(length=8, gram=3, rows=rows, spool=100)
    size, body = np.array([len(x) for x in strings]), np.frombuffer(b"".join(strings), np.uint8)
    out = D.columns(size, body, s)
    out.rewind()
    symbol, prefix = out.read(out.n)
    # an end is smaller than any byte, ends by their strings
    suffixes = sorted((x[k:] + b"\0" + bytes([i + 1]), x[k - 1] if k else D.END) for i, x in enumerate(strings) for k in range(len(x) + 1))
    assert symbol.tolist() == [c for _, c in suffixes]
    common = lambda a, b: next(k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0)
    want = [0] + [min(8, common(a, b)) for (a, _), (b, _) in zip(suffixes[:-1], suffixes[1:], strict=True)]
    assert prefix.tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_operator_is_brute_force(spark, seed):
    rows = texts_with_copies(seed, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = D.deduplicated(docs, SMALL, texts=True)
    assert got(out.drop("kept")) == brute(rows, 8)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in out.collect())


def test_edges_and_long_texts(spark, edges, nothing):
    want = brute([(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()], 50)
    assert got(D.deduplicated(edges)) == want
    assert D.deduplicated(nothing).collect() == []
    r = random.Random(1)
    body = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, body), (2, body[700_000:900_000]), (3, "z" * 20 + body[-60:]), (4, body[:49])]
    out = {x.doc_id: (x.n_removed, x.n_spans) for x in D.deduplicated(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out == {1: (0, 0), 2: (200_000, 1), 3: (60, 1), 4: (0, 0)}
    with pytest.raises(TypeError):
        D.deduplicated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_query_on_real_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert got(D.op11_substring_dedup(spark, small)) == brute([tuple(r) for r in docs.collect()], 50)
