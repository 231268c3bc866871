"""The join's order of frequencies, and ids of other types in the coder."""

import numpy as np

from harborline.llm import bpe, ngram_join


def test_rarity_rises_with_the_frequency():
    df = np.concatenate([np.arange(1, 200_000), 2 ** np.arange(18, 46)])
    r = ngram_join.rarity(df)
    assert (np.diff(r) >= 0).all() and (r[: (1 << 14) - 1] == df[: (1 << 14) - 1]).all() and r.max() < 1 << 15
    assert len(np.unique(r[(df >= 1 << 15)])) > 1000
    keys = ngram_join.order_key(np.array([1 << 63, 5], np.uint64), np.array([40_000, 1 << 40]))
    assert 0 < keys[0] < keys[1]


def test_coder_keeps_the_type_of_ids(spark):
    for kind, ids in (("string", ["a", None]), ("int", [1, 2])):
        docs = spark.createDataFrame([(i, "some text") for i in ids], f"doc_id {kind}, text string")
        got = bpe.digests(docs)
        assert got.schema["doc_id"].dataType.simpleString() == kind and {r.doc_id for r in got.collect()} == set(ids)
        assert {r.decoded for r in bpe.encoded(docs).collect()} == {"some text"}
