"""N-gram join, LM scoring, chat repair, Hilbert sharding, URL filters, pipeline."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import chat_format, hilbert_sharding, lm_scoring, ngram_join, queries, succinct, url_filters
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = tokens(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def near_copies(n, rng):
    """A group of edits of one text, some close to the threshold, and others with a common passage."""
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(46))
    rows += [(n + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 20)))) for i in range(n)]
    return rows


@pytest.mark.parametrize("case", ["edges", "groups"])
def test_join_equals_brute_force(spark, case):
    rows = EDGES if case == "edges" else near_copies(60, random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)).repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_one_of_each_component_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (1, "a b c d e f g"), (2, "other words in this one"), (None, "a b c d e f g"), (5, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "6"]  # the row without an id is a copy too
    assert ngram_join.one_of_each(docs.where("false")).count() == 0


TEXT = " ".join(f"t{i}" for i in range(60))
#: Ids on several texts, whose texts link with those of other ids; copies without an id.
SHARED_IDS = [
    (1, "first text of one id with some words more"), (5, "first text of one id with some words more"), (5, TEXT), (9, TEXT + " tail"), (9, "last text of an id that has two of them"),
    (7, "last text of an id that has two of them"), (None, "copies without any id at all here"), (None, "copies without any id at all here"), (None, TEXT), (5, "one of a kind under this id"),
    (8, None), (8, ""), (8, None), (4, "same row twice with words"), (4, "same row twice with words"),
]


def test_ids_on_several_texts_lose_no_link(spark):
    docs = spark.createDataFrame(SHARED_IDS, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(SHARED_IDS)
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()]
    want = [SHARED_IDS[i] for i in (0, 2, 5, 6, 9, 10, 11, 12, 13)]
    assert collections.Counter(kept) == collections.Counter(want)


def test_frequent_shingles_are_listed_by_their_block(spark):
    rng = random.Random(5)
    rows = near_copies(80, rng) + [(1000 + i, "the same opening words for all texts " + " ".join(f"o{rng.randrange(60)}" for _ in range(12))) for i in range(200)]
    rows += [(5000 + i, rows[3][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for s in (ngram_join.Settings(block=600, often=2), ngram_join.Settings(often=10**6)):
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, s).collect())
        assert got == brute_components(rows)


def test_join_on_real_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], np.sort(rng.integers(0, 1 << 60, 3000)), np.sort(rng.integers(0, 900, 3000))):
        v = np.array(values, np.uint64)
        m = succinct.Monotone(succinct.Monotone.pack(v, "x"), "x")
        assert (m.at(np.arange(len(v))) == v).all()
        asked = np.concatenate([v, v + np.uint64(1), np.array([0, 1 << 61], np.uint64)])
        assert (m.successor(asked) == np.searchsorted(v, asked)).all()
        assert ((m.find(asked) >= 0) == np.isin(asked, v)).all()


def test_lm_equals_plain_counts(spark, edges):
    rows = [*EDGES, *((100 + i, "the cat sat on the mat " * (i % 3 + 1) + f"and {i % 4}") for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0)).repartition(3)
    train = docs.where("doc_id % 7 <> 2")
    s = lm_scoring.Settings(shard_words=8, part_tokens=60, piece=256)  # the most frequent words lie in several files
    got = lm_scoring.score_texts(docs, lm_scoring.fit(train, s), s).collect()
    seqs = [[*tokens(t), "\0"] for i, t in rows if i is not None and i % 7 != 2]
    c1, c2, c3 = (collections.Counter(g for w in seqs for g in zip(*(w[k:] for k in range(n)), strict=False)) for n in (1, 2, 3))
    total, distinct = sum(c1.values()), len(c1)
    a2 = {k: (v - 0.75) / c1[k[:1]] for k, v in c2.items()}
    a3 = {k: (v - 0.75) / c2[k[:2]] for k, v in c3.items()}
    g1, g2 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for k, v in a2.items():
        g1[k[0]] -= v
    for k, v in a3.items():
        g2[k[:2]] -= v
    want = collections.defaultdict(list)
    for i, t in rows:
        w, base, score = [*tokens(t), "\0"], 0.0, 0.0
        for j, x in enumerate(w):
            p = (c1[(x,)] + 1) / (total + distinct + 1)
            base += math.log10(p)
            if j:
                p = a2.get((w[j - 1], x), 0) + g1[w[j - 1]] * p
            if j > 1 and (w[j - 2], w[j - 1]) in a2:
                p = a3.get((w[j - 2], w[j - 1], x), 0) + g2[w[j - 2], w[j - 1]] * p
            score += math.log10(p)
        want[i].append((len(w), sum((x,) in c1 for x in w), base, score))
    assert len(got) == len(rows)
    for r in got:
        assert any(r.n_tokens == n and r.n_known == k and abs(r.base_score - b) < 1e-6 * n and abs(r.score - x) < 0.08 * n for n, k, b, x in want[r.doc_id])


def test_lm_without_training_rows(spark, nothing, edges):
    m = lm_scoring.fit(nothing)
    assert {r.score for r in lm_scoring.score_texts(edges, m).collect()} == {0.0}
    assert lm_scoring.score_texts(nothing, m).count() == 0


def brute_cost(roles, s):
    cost = {chat_format.START: 0}
    for given in roles:
        new = {}
        for state, c in cost.items():
            for role in (1, 2, 3):
                label = 0 if given == role else s.relabel if given else s.relabel_unknown
                ways = [label] * (role in chat_format.NEXT[state]) + [label + s.insert for y in (2, 3) if y in chat_format.NEXT[state] and role in chat_format.NEXT[y]] + [label + s.merge] * (role == state)
                for w in ways:
                    new[role] = min(new.get(role, 10**9), c + w)
        cost = new
    return min(c + {0: 0, 1: 2 * s.insert, 2: s.insert, 3: 0}[k] for k, c in cost.items())


def test_chat_repair_is_cheapest_and_legal(spark):
    rng, s = random.Random(5), chat_format.Settings()
    rows = [(c, k, rng.choice(["user", "assistant", "system", "tool", None, "human"]), f"t{c}.{k}") for c in range(40) for k in range(rng.randrange(1, 7))]
    rows += [(1000, k, rng.choice(["user", "assistant", None]), None if k % 5 == 0 else f"x{k}") for k in range(1500)] + [(None, 0, "user", ""), (None, None, "user", "u")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("action", F.lit("x")).repartition(4)
        got = chat_format.repair(df).orderBy("conv_id", "ord").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    assert len({r.ord >> 40 for r in by[1000]}) > 1
    for c, out in by.items():
        roles = [chat_format.code_of(x[2]) for x in rows if x[0] == c]
        known = lambda r: s.relabel if chat_format.code_of(r.source_role) else s.relabel_unknown
        cost = sum(s.insert * (r.action == "insert") + ("relabel" in r.action and known(r)) + s.merge * ("merge" in r.action) for r in out)
        turns = [k for k, _ in itertools.groupby((r.out_turn, r.role) for r in out)]
        assert [t for t, _ in turns] == list(range(len(turns))) and turns[-1][1] == "assistant"
        assert all(b in {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a] for (_, a), (_, b) in itertools.pairwise(turns))
        assert cost == brute_cost(roles, s) and sum(r.action != "insert" for r in out) == len(roles)
        assert "".join(r.rendered for r in out).count("<|end|>") == len(turns)
    assert chat_format.repair(df.where("false")).count() == 0


def test_hilbert_curve_is_a_path(spark):
    cells = spark.range(512).select(F.array(*[(F.floor(F.col("id") / 8**k) % 8).cast("int") for k in range(3)]).alias("c"))
    path = cells.select("c", hilbert_sharding.hilbert_index(F.col("c"), 3, 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in path] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p.c, q.c, strict=True)) == 1 for p, q in itertools.pairwise(path))


def test_shards_are_even_and_gapless(spark, edges, nothing, small):
    for docs in (edges, spark.read.parquet(f"{small}/documents.parquet")):
        got = hilbert_sharding.assignments(docs).collect()
        texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
        sizes = [len(slots.get(k, [])) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in order)
    assert hilbert_sharding.assignments(nothing).count() == 0


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = []
    for verdict, rule in url_filters.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_method(spark, small):
    urls = ["http://A.Example.COM/en/7x?q", "https://example.com/en/8", "https://com/en/", "https://xcom/en/1", "https://b.net/de/1#f", "https://example.net/de/8", "no scheme", None, "", "x://", "https://spam-farm.example.org/fr/1", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("?"))
    pages = pages.unionByName(spark.read.parquet(f"{small}/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "url"), allowMissingColumns=True)
    s = url_filters.Settings()
    weights, bias = url_filters.fit(url_filters.labelled(spark), s)
    got = {r.page_id: r for r in url_filters.judged(pages, (weights, bias)).collect()}
    for r in pages.collect():
        host, path, rule, verdict = brute_rule(r.url)
        codes = [ord(c) for c in f"^{host}|{path}$"]
        x = set()
        for i in range(len(codes) - 2):
            h = 7
            for c in codes[i : i + 3]:
                h = (h * 1000003 + c) % 2147483647
            x.add(h % 1024)
        margin = sum(weights[b] for b in x) / math.sqrt(len(x)) + bias
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.margin == pytest.approx(margin) and g.verdict == (verdict or ("block" if margin > 0 else "allow"))
    assert got[10].verdict == "block"
    labels = url_filters.judged(url_filters.labelled(spark).withColumn("page_id", F.monotonically_increasing_id()), (weights, bias), rules=[("block", "nowhere/")])
    assert labels.count() == len(url_filters.LABELLED)


def test_pipeline_filters_and_packs(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.select("doc_id").distinct().count() == counts[-1]


def test_all_ten_are_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in queries.queries()} and "pipeline" in queries.queries()
