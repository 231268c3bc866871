"""Slope selection against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.operators import selection as Z
from harborline.operators import series as S


def plain(y):
    y = np.asarray(y, float)
    i, j = np.triu_indices(len(y), 1)
    return float(np.median((y[j] - y[i]) / (j - i)))


def test_inversions():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        p = r.permutation(n)
        want = {(p[i], p[j]) for i in range(n) for j in range(i + 1, n) if p[i] > p[j]}
        assert Z.inversions(p) == len(want)
        assert set(zip(*(x.tolist() for x in Z.inversions(p, listed=True)), strict=True)) == want


@pytest.mark.parametrize("kind", ["noise", "walk", "line", "integers", "two values", "constant", "spikes", "tiny"])
def test_median_is_that_of_all_pairs(kind):
    for seed in range(6):
        r = np.random.default_rng(seed)
        n = int(r.integers(Z.FEW + 1, 400))
        y = {
            "noise": r.normal(size=n), "walk": np.cumsum(r.normal(size=n)), "line": 0.1 * np.arange(n), "integers": r.integers(-5, 6, n).astype(float), "two values": r.integers(0, 2, n).astype(float),
            "constant": np.full(n, 0.3), "spikes": np.where(r.random(n) < 0.02, 1e9, 0.0) + r.normal(size=n), "tiny": 1e-12 * r.normal(size=n) + 1.0,
        }[kind]
        assert Z.median_slope(y) == plain(y)


def test_short_and_odd_series():
    assert Z.median_slope([]) == 0.0 and Z.median_slope([3.0]) == 0.0 and Z.median_slope([1.0, 3.0]) == 2.0
    assert np.isnan(Z.median_slope([1.0, float("nan"), 2.0]))


def test_five_thousand_points(spark):
    n = 5000
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").cast("int").alias("month_idx"), (F.col("id") * 0.25 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("value"))
    y = np.array([r.value for r in df.orderBy("month_idx").collect()])
    assert S.theil_sen(df, ["key"], "value").first().slope == plain(y)
