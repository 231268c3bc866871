"""Phrase mining: the index against counting in the text, the operator against plain Python."""

import collections
import random
import re

import numpy as np
import pytest

from harborline.llm import collocations as C

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows of (lang, text), sorted."""
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        drop = set()
        for p, b in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * b >= 80 * f[p[i : i + k]]:
                        drop.add(p[i : i + k])
        found = []
        for p, a in cand.items():
            if p not in drop:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_intervals_hold_all_occurrences(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([[0], *([*r.integers(1, 6, r.integers(1, 9)), 0] for _ in range(60))]).astype(np.int32)
    index = C.Index(*C.Index.of(text, 6), 6)
    want = lambda k: collections.Counter(tuple(text[i : i + k].tolist()) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all())
    told = lambda p: dict(zip(map(tuple, p.ids.tolist()), p.n.tolist(), strict=True))
    p = index.words()
    assert told(p) == want(1)
    for size, side in ((2, 0), (3, 1), (4, 0)):
        p = index.extended(p, side)
        assert told(p) == want(size)
    for side, size in ((1, 2), (0, 3)):  # the other sides in turn
        p = index.words() if size == 2 else index.extended(index.words(), 0)
        assert told(index.extended(p, side)) == want(size)
    pairs = np.array([k for k, v in want(2).items() if v > 12]).reshape(-1, 2)
    some = {tuple(x) for x in pairs.tolist()}
    kept = index.extended(index.words(), 0)
    kept = kept.where(C.among(kept.ids, pairs))
    assert told(C.grown(index, kept, kept.ids)) == {k: v for k, v in want(3).items() if k[:2] in some and k[1:] in some}


@pytest.mark.parametrize("seed", range(3))
def test_operator_is_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["a", "B", "b", "ab", "é", "漢字", "'s", "-", "new", "york", "city", " "]
    make = lambda: "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ". ", "\n"]) for _ in range(r.randrange(0, 40)))
    rows = [(r.choice(["en", "en", "fr", None, "und"]), make() + r.choice(["", "New York city hall ", "in new york"])) for _ in range(120)] + [(None, None), ("xx", ""), ("en", "!?")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for least, top in ((3, 2000), (8, 15)):
        s = C.Settings(least=least, top=top, shard_words=r.choice([150, 10_000]), range_rows=100)
        assert got(C.mined(docs, s)) == brute(rows, least, top)


def test_scores_are_exact():
    big = 4_000_000_000_000_000_000
    for a, left, right in ((big - 1, big, big), (31, big, 31), (1 << 41, (1 << 41) + 1, 1 << 41), (30, 30, 31)):
        assert C.scores(*(np.array([x, 30]) for x in (a, left, right))).tolist() == [2000000 * a // (left + right), 1000000]


def test_edges(spark, edges, nothing):
    rows = [(r.lang, r.text) for r in edges.select("lang", "text").collect()]
    assert got(C.mined(edges)) == brute(rows) != []
    assert C.mined(nothing).collect() == []


def test_query_on_real_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(C.op13_collocations(spark, sf)) == brute(rows)
