"""Every pipeline stage against plain Python on small tables with nulls, ties, repeated rows, a long text and a column more."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from harborline.llm import quality_classifier, quality_rules
from harborline.llm.word_ids import vocabulary
from tests.llm.conftest import EDGES
from tests.llm.test_corpus_operators import brute_components, near_copies
from tests.llm.test_models_brute import gram_sets
from tests.llm.test_text_operators import base

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of the smallest scale with the edge cases and near copies, and their labels."""
    small = "/root/testdata/sf0.001"
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [(5000 + i, t) for i, t in near_copies(15, random.Random(4))]
    rows = [(i, t, "en", "src", None, 0.5) for i, t in [*EDGES, *texts, texts[3], texts[4]]]
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 6000").withColumn("score", F.lit(0.1)).withColumn("doc_id", F.col("doc_id") + 1000)  # apart from the ids of EDGES
    docs.select("doc_id", "text", "lang", "source", "n_chars", "score").unionByName(spark.createDataFrame(rows, COLUMNS)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{path}/labels.parquet")
    return path


def keys(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    s = quality_classifier.Settings()
    m = quality_classifier.fit(docs, quality_classifier.training_labels(labels), s)
    margin = lambda t: float(m.weights[gram_sets(t or "", s)].sum(dtype=np.float64)) + m.bias
    seen = {}
    score = lambda t: seen[t] if t in seen else seen.setdefault(t, 1 / (1 + math.exp(-(m.slope * margin(t) + m.offset))))
    some = [r for r in rows if len(r[1] or "") < 1500]
    kept = stages["quality_classifier"](spark, docs, tables)
    assert kept.columns == docs.columns
    got = keys(kept)
    for r in some:
        if abs(score(r[1]) - s.threshold) > 1e-6:
            assert (r in got) == (score(r[1]) >= s.threshold), r
    assert 0 < sum(got.values()) < len(rows)

    ratios = quality_rules.ratios_of(docs, labels)
    q = quality_rules.Settings()

    def fine(t):
        body = np.frombuffer((t or "").encode(), np.uint8)
        h, _ = quality_rules.byte_grams(np.array([0, len(body)]), body, q.size, q.bits)
        return not base(t)[-1] and math.fsum(ratios[h]) / max(1, len(h)) >= q.threshold

    assert keys(stages["quality_rules"](spark, docs, tables)) == collections.Counter(r for r in rows if fine(r[1]))

    one = keys(stages["ngram_jaccard_join"](spark, docs, tables))
    left = collections.Counter(rows)
    assert all(n <= left[r] for r, n in one.items())
    comps = collections.defaultdict(set)
    for i, n, c in brute_components(rows):
        if n and c is not None:
            comps[c].add(i)
    assert {i for (i, t), _ in one.items() if i is not None and (t or "").strip(" \t\n\r\x0b\x0c")} == set(comps)  # the smallest id of each group
    lists = brute_components([(i, t) for (i, t), n in one.items() for _ in range(n)])
    assert max((sum(1 for _, n, c in lists if n and c == k) for k in comps), default=1) == 1  # and nothing that links with it

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    packed = stages["best_fit_packing"](spark, docs, tables).collect()
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert pieces == want
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048


def test_run_is_its_stages_and_takes_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        if "text" in docs.columns:
            docs.write.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
            docs = spark.read.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir())) - 1}")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    count = lambda df: collections.Counter(map(tuple, df.select(cols).collect()))
    assert count(corpus_pipeline.run(spark, tables)) == count(docs)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
