"""Cells of whole strings and numbers, and groups of equal texts, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from harborline.llm import hilbert_sharding as H


def brute_cuts(values, cells):
    counts, upto, out = collections.Counter(v or "" for v in values), 0, []
    for v in sorted(counts, key=str.encode):
        before, upto = upto, upto + counts[v]
        if upto < len(values) and upto * cells // len(values) > before * cells // len(values):
            out.append(v)
    return out


@pytest.mark.parametrize("distinct", [1, 3, 40, 400])
def test_string_cells_see_whole_values(spark, distinct):
    rng = random.Random(distinct)
    values = [rng.choice([None, "é"]) if rng.random() < 0.1 else f"https://one.example/common/beginning/{int(rng.paretovariate(0.6)) % distinct:05d}" for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "source string").repartition(5)
    cuts = brute_cuts(values, 8)
    assert H.string_cuts(df, "source", 8) == cuts
    s = H.Settings(bits=3, dimensions=("source",))
    got = df.select("source", F.get(H.cells_of(df, s), F.lit(0)).alias("cell")).distinct().collect()
    assert {(r.source, r.cell) for r in got} == {(v, sum((v or "").encode() > c.encode() for c in cuts)) for v in values}
    assert len({r.cell for r in got}) >= min(distinct, 4)


def test_number_cells_are_even(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("n_chars"))
    got = df.select(F.get(H.cells_of(df, H.Settings(bits=2, dimensions=("n_chars",))), F.lit(0)).alias("cell"), "n_chars").collect()
    assert all(r.cell == 0 for r in got if r.n_chars is None)
    numbers = sorted((-1 if r.n_chars is None else r.n_chars, r.cell) for r in got)
    assert [c for _, c in numbers] == sorted(c for _, c in numbers)
    assert all(abs(n - 250) <= 100 for n in collections.Counter(c for _, c in numbers).values())


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(150)}", rng.choice("abcd"), rng.choice("xyz") * 9, rng.randrange(50)) for i in range(800)]
    rows += [(1000 + i, "a large group", rng.choice("abcd"), "s", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r.doc_id: r for r in H.assignments(df).collect()}
    shards = collections.defaultdict(set)
    for i, text, *_ in rows:
        shards[text].add(got[i].shard)
    spread = {t: s for t, s in shards.items() if len(s) > 1}
    assert all(s == set(range(min(s), max(s) + 1)) for s in spread.values())
    assert sum(len(s) - 1 for s in spread.values()) <= 7  # only where a border has to cut
    size = len(rows) / 8
    assert all(len(s) <= 2 for t, s in spread.items() if t != "a large group") and len(shards["a large group"]) <= 300 / size + 2
