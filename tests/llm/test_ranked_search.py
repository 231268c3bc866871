"""Ranked search: against plain Python scores, early stops, ties and edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest

from harborline.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(items, docs, k=10):
    """{item_id: [(doc_id, score), ...]} of the k best, in order."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        scored = []
        for i, b in bags:
            n, score = sum(b.values()), 0
            for t in terms(text):
                if t in b:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, R.LAST if i is None else i, i))
        out[item] = [(i, -s) for s, _, i in sorted(scored, key=lambda x: x[:2])[:k]]
    return {i: x for i, x in out.items() if x}


def got(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


def test_terms_are_those_of_the_pattern():
    texts = ["It's 3-4 Ümläut\x00漢字x", "", "\x7f", "a", "b c", "_x_", "😀😀"]
    body = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in body]))
    h, first = R.terms_of(offsets, np.frombuffer(b"".join(body), np.uint8))
    assert np.diff(first).tolist() == [len(terms(t)) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in terms(t)})


@pytest.mark.parametrize("seed", range(4))
def test_search_is_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(words[min(int(r.expovariate(0.15)), 39)] for _ in range(n))
    docs = [(r.choice([i, i, i, None, 7]), make(r.randrange(0, 60))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(25)] + [(900, None), (901, "...")]
    items = [(i, make(r.randrange(1, 12))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, "w0 W0 w39")]
    s = R.Settings(shard_docs=40, item_bytes=r.choice([60, 10_000]), first_depth=2)
    out = R.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), s)
    assert got(out) == brute(items, docs)


def test_lists_are_not_read_to_their_end():
    n = 4000
    r = np.random.default_rng(0)
    tf, size = r.integers(1, 50, 2 * n).astype(np.int32), r.integers(60, 90, n)
    row = {"ids": np.arange(n), "sizes": size, "firsts": np.arange(0, 2 * n + 1, 2), "terms": np.tile(np.array([0, 1], np.int32), n), "tfs": tf}
    x = R.Impacts({k: np.asarray(v).tobytes() for k, v in row.items()}, n, int(size.sum()))
    docs, scores, read = R.best_positions(x, np.array([0, 1]), np.array([3, 2]), 10, 16)
    every = np.zeros(n, np.int64)
    for t, w in ((0, 3), (1, 2)):
        at = slice(x.first[t], x.first[t + 1])
        every[x.doc[at]] += w * x.impact[at]
    want = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert read < n


def test_edges(spark, edges, nothing, small):
    docs = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    items = [("a", "one TWO lorem"), ("b", "漢字 it"), (None, "one")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert got(R.search(asked, edges)) == brute(items, docs)
    assert R.search(asked, nothing).collect() == [] and R.search(asked.where("false"), edges).collect() == []
    with pytest.raises(TypeError):
        R.search(asked, spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_query_on_real_texts(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(R.op12_ranked_search(spark, small)) == brute(items, docs)
