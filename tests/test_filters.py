"""Stored filters against plain Python; sweeps, flip zones and duplicates against counting."""

import collections
import random

from pyspark.sql import functions as F

from harborline.operators import filters as V
from harborline.operators import quality as Q


def test_filters_are_interpreted(spark):
    r = random.Random(3)
    codes = ["11010101", "11020101", "12010101", "13010101", "1101"]
    cells = [(r.choice("DFU"), r.choice("CHX"), c, r.choice([1, 2]), m, r.randrange(100)) for c in codes for m in range(24000, 24030) for _ in range(6)]
    lists = [None, [], ["C"], ["C", "H"], ["Q"]]
    found = []
    for i in range(300):
        prefixes = r.choice([None, ["11"], ["11", "1101", "110101"], ["12", "13"], ["9"], ["11010101"]])
        first = r.randrange(23990, 24030)
        f = (i, r.choice([1, 2]), first, first + r.randrange(0, 14), r.choice(lists), r.choice([None, ["D"], ["D", "U"]]), r.choice([None, None, ["U"]]), prefixes)
        value = sum(
            v for who, partner, code, flow, m, v in cells
            if flow == f[1] and f[2] <= m <= f[3] and (not f[4] or partner in f[4]) and (not f[5] or who in f[5]) and not (f[6] and who in f[6]) and (not f[7] or any(code.startswith(p) for p in f[7]))
        )
        found.append((*f, float(value + (i % 3 == 0))))
    df = spark.createDataFrame(found, "finding_id int, flow int, first_idx int, last_idx int, p array<string>, w array<string>, n array<string>, x array<string>, value_current double")
    rows = spark.createDataFrame(cells, "reporter string, partner string, product_nc string, flow int, month_idx int, value int")
    filters = V.stored(df, partner=F.col("p"), reporter=F.col("w"), not_reporter=F.col("n"), prefix=F.col("x"))
    out = {r.finding_id: (r.replayed, r.matches) for r in V.replayed(df, filters, rows).collect()}
    assert len(out) == 300
    for f in found:
        true = f[-1] - (f[0] % 3 == 0)
        assert out[f[0]] == (true, f[0] % 3 != 0)


def test_sweeps_of_many_thresholds(spark):
    r = random.Random(1)
    rows = [(r.choice([None, r.random(), r.choice([0.25, 0.5])]), r.choice([None, r.gauss(0, 2)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double")
    edges = [i / 50 for i in range(1, 51)]
    got = {(x.measure, x.threshold): (x.n, x.share, x.change) for x in Q.threshold_sweeps(df, {"under": ("a", edges, 0.5, True), "above": ("b", edges, 0.33, False)}).collect()}
    a, b = [x for x, _ in rows if x is not None], [x for _, x in rows if x is not None]
    assert len(got) == 101
    for t in edges:
        assert got["under", t] == (sum(x < t for x in a), sum(x < t for x in a) / len(a), sum(x < t for x in a) - sum(x < 0.5 for x in a))
        assert got["above", t] == (sum(x >= t for x in b), sum(x >= t for x in b) / len(b), sum(x >= t for x in b) - sum(x >= 0.33 for x in b))
    none = Q.threshold_sweep(df.where("false"), "a", [0.1], 0.2).collect()
    assert [(x.threshold, x.n_under, x.share, x.change) for x in sorted(none)] == [(0.1, 0, None, 0), (0.2, 0, None, 0)]


def test_flip_zone_takes_latest_rows(spark):
    rows = [("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 50.0), ("b", 1, 6.0), ("c", 1, 1.0), ("d", 7, 9.9), ("e", 1, None)]
    got = Q.flip_zone(spark.createDataFrame(rows, "k string, month_idx int, v double"), ["k"], "v", 5.0, 10.0, k=2).collect()
    assert sorted((r.k, r.month_idx, r.value, r.n_rows, r.n_keys) for r in got) == [("a", 2, 9.0, 4, 3), ("b", 1, 6.0, 4, 3)]


def test_duplicates_of_wide_keys(spark):
    r = random.Random(2)
    rows = [tuple(r.choice(["x", "y", None]) if c > 2 else str(r.randrange(30)) for c in range(14)) for _ in range(600)]
    rows += rows[:40] + rows[:5]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in Q.RAW_KEY))
    want = {k: n for k, n in collections.Counter(tuple(x or "" for x in row) for row in rows).items() if n > 1}
    out = Q.duplicate_keys(df, Q.RAW_KEY)
    assert {tuple(row)[:-1]: row.n for row in out.collect()} == want
    # the second round sees rows of repeated hashes only
    left = df.withColumn("_h", F.xxhash64(*Q.RAW_KEY)).groupBy("_h").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert left <= sum(want.values())
