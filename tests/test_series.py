import pytest
from pyspark.sql import functions as F

from harborline.operators import families as A
from harborline.operators import series as S


def series(spark, values, start=24000, key="k"):
    return spark.createDataFrame([(key, start + i, float(v)) for i, v in enumerate(values) if v is not None], "key string, month_idx int, value double")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("month_idx").collect()]


def test_gaps_count_as_gaps(spark):
    s = S.rolling_pair(series(spark, [1] * 5 + [None] + [1] * 18), ["key"], ["value"])
    last = rows(s, "value_current", "value_prior", "n_current", "n_prior")[-1]
    assert last == (12.0, 11.0, 12, 11)


def test_missing_and_lags(spark):
    s = series(spark, [10] * 12 + [None] + [20] * 11)
    one = rows(S.two_month(S.single_month(s, ["key"]), ["key"]), "month_idx", "single_yoy", "two_yoy")
    assert one[-1] == (24023, 1.0, 1.0)
    m = s.withColumn("m", S.missing_months(["key"], -23, 0)).orderBy("month_idx").collect()[-1]["m"]
    assert m == [24012]


def test_year_to_date_needs_every_month(spark):
    got = rows(S.ytd_computed(series(spark, [1, 1, None, 1]), ["key"]), "month_idx", "ytd")
    assert got == [(24000, 1.0), (24001, 2.0), (24003, None)]


def test_jan_feb_chunk_counts_once_and_whole(spark):
    monthly = series(spark, [None, None] + [1] * 10 + [1] * 12)
    chunks = spark.createDataFrame([("k", 24000, 5.0), ("k", 24012, 99.0)], "key string, jan_idx int, value double")
    got = {r["month_idx"]: (r["value_current"], r["n_current"], r["value_prior"], r["n_prior"]) for r in S.add_jan_feb(monthly, chunks, ["key"]).collect()}
    assert got[24011] == (15.0, 12, 0.0, 0)  # both months inside
    assert got[24012] == (11.0, 11, 0.0, 0)  # the border cuts the chunk: not counted; a published January wins over the other chunk
    assert got[24023] == (12.0, 12, 15.0, 12)


def test_runs_and_slopes(spark):
    s = series(spark, [1, 2, None, 4, 5, None, 7])
    assert rows(S.longest_run(s, ["key"]), "month_idx") == [(24000,), (24001,)]
    assert S.theil_sen(series(spark, [0, 1, 2, 30, 4]), ["key"], "value").first()["slope"] == 1.0
    assert S.theil_sen(series(spark, [3]), ["key"], "value").count() == 0
    r = S.sign_runs(series(spark, [1, 0, 2, -1, 0, 3]), ["key"], "value").first()
    assert (r["sign_changes"], r["last_sign"], r["first_sign"]) == (2, 1, 1)
    assert rows(S.smooth_centred(series(spark, [1, 4, 7]), ["key"], "value"), "smooth") == [(2.5,), (4.0,), (5.5,)]


def test_zscore_uses_points_not_months(spark):
    z = S.rolling_zscore(series(spark, [1, None, None, 2, 3, None, 10]), ["key"], "value")
    last = z.orderBy("month_idx").collect()[-1]
    assert last["base_n"] == 3 and last["z"] == pytest.approx(8.0)
    assert S.rolling_zscore(series(spark, [5, 5, 5, 5]), ["key"], "value").where("z is not null").count() == 0


def test_seasonal_autocorrelation(spark):
    wave = [1 if i % 12 < 6 else -1 for i in range(48)]
    assert S.seasonal_autocorr(series(spark, wave), ["key"], "value").first()["autocorr"] > 0.5
    assert S.seasonal_autocorr(series(spark, wave[:12]), ["key"], "value").first()["autocorr"] is None


def test_gap_list(spark):
    g = S.series_gaps(series(spark, [1, None, None, 1]), ["key"]).first()
    assert (g["n_missing"], g["missing"]) == (2, [24001, 24002])


SHAPES = {
    "flat": [0.01] * 12,
    "flat_around_zero": [0.01, -0.01] * 6,
    "rising": [0.2] * 12,
    "rising_slowly": [0.03] * 12,  # a steady +3 % is no flat series
    "rising_accelerating": [0.1 + 0.03 * i for i in range(12)],
    "rising_decelerating": [0.5 - 0.03 * i for i in range(12)],
    "falling": [-0.2] * 12,
    "falling_accelerating": [-0.1 - 0.03 * i for i in range(12)],
    "falling_decelerating": [-0.5 + 0.03 * i for i in range(12)],
    "u_recovery": [-0.3] * 6 + [0.3] * 6,
    "u_recovery_small": [-0.3] * 6 + [0.015] * 6,  # only zeros are ignored, not small values
    "inverse_u_peak": [0.3] * 6 + [-0.3] * 6,
    "dip_recovery": [0.3] * 5 + [-0.3] * 5 + [0.3] * 5,
    "failed_recovery": [-0.3] * 5 + [0.3] * 5 + [-0.3] * 5,
    "volatile": ([0.4] * 4 + [-0.4] * 4) * 3,
    "insufficient_data": [0.2] * 4,
}


def test_trajectory_shapes(spark):
    data = [(k, 24000 + i, v, False) for k, vs in SHAPES.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "key string, month_idx int, value_yoy double, low_base boolean")
    rows = {r["key"]: r for r in A.trajectory(df, ["key"]).collect()}
    want = {k: {"flat_around_zero": "flat", "rising_slowly": "rising", "u_recovery_small": "u_recovery"}.get(k, k) for k in SHAPES}
    assert {k: r["shape"] for k, r in rows.items()} == want
    assert all(r["shape_label"] == A.SHAPES[r["shape"]] for r in rows.values())
    assert rows["u_recovery"]["cross_zero_idx"] == 6 and rows["rising"]["cross_zero_idx"] is None
    assert rows["rising_accelerating"]["peak_idx"] == 24011 and abs(rows["rising_accelerating"]["slope"] - 0.03) < 1e-9


def test_seasonality_is_the_correlation_of_both_slices(spark):
    """Each slice has its own mean, as in a Pearson correlation."""
    wave = [(i % 12) * 0.1 + (0.3 if i > 20 else 0.0) for i in range(30)]
    slopes = sorted((wave[j] - wave[i]) / (j - i) for i in range(30) for j in range(i + 1, 30))
    slope = (slopes[len(slopes) // 2] + slopes[(len(slopes) - 1) // 2]) / 2
    rest = [v - slope * i for i, v in enumerate(wave)]
    a, b = rest[:-12], rest[12:]
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    got = S.seasonal_autocorr(series(spark, wave), ["key"], "value").first()["autocorr"]
    assert abs(got - want) < 1e-9


MOVERS = {
    "mover": [10_000] * 12 + [16_000] * 12,
    "floor": [10] * 12 + [16] * 12,
    "small_change": [10_000] * 12 + [11_000] * 12,
    "few_months": [None] * 3 + [10_000] * 9 + [16_000] * 12,
    "one_month": [10_000] * 12 + [10_000] * 11 + [60_000],
}


def test_product_mover_gates(spark):
    data = [(k, 24000 - 2 + i + 2, float(v)) for k, vs in MOVERS.items() for i, v in enumerate(vs) if v is not None]
    data += [(k, 23999 - i, float(next(v for v in vs if v))) for k, vs in MOVERS.items() for i in range(2) if k != "few_months"]
    df = spark.createDataFrame(data, "product_nc string, month_idx int, value double")
    got = {r["product_nc"]: r["verdict"] for r in A.product_mover(df).collect()}
    assert {k: got[k] for k in ("mover", "floor", "small_change", "few_months")} == {k: k for k in ("mover", "floor", "small_change", "few_months")}
    assert got["one_month"] in ("one_month", "unsteady")


def goods(spark, rows):
    """reporter, partner, code, flow, month, value -> facts; UK is the source without total rows."""
    return spark.createDataFrame(
        [(r, p, c, f, m, float(v), 1.0, int(c == "13000001"), f"{r}{p}{c}{f}{m}") for r, p, c, f, m, v in rows],
        "reporter string, partner string, product_nc string, flow int, month_idx int, value_eur double, quantity_kg double, suppression_index int, raw_id string",
    )


#: Detail 7 and 4 beside their total 11, and a source of detail alone with one suppressed row.
BOTH = [("R", "P", c, 1, 24000, v) for c, v in (("11000001", 7), ("11000002", 4), ("000TOTAL", 11))] + [("UK", "P", c, 1, 24000, v) for c, v in (("11000001", 5), ("13000001", 100))]


def test_total_rows_are_never_added_to_detail(spark):
    facts = goods(spark, BOTH)
    patterns = spark.createDataFrame([(1, "g", "11"), (1, "g", "1100")], "group_id int, group_name string, prefix string")
    s = A.group_series(facts, patterns, ("P",), "UK").where(F.col("scope") == "eu_27").collect()
    assert [r["value"] for r in s] == [11.0]
    assert {r.reporter: r.imports for r in A.importer_totals(facts, ("P",), "UK").collect()} == {"R": 11.0, "UK": 5.0}
    total, detail = A.allgoods_from_total_row(facts, "UK", ["flow"]).first(), A.allgoods_from_detail(facts, "UK", ["flow"]).first()
    ids = {r.from_detail: r.ids for r in A.allgoods_lineage(facts, "UK", ["flow"]).collect()}
    assert (total.value, ids[False], detail.value, len(ids[True])) == (11.0, ["RP000TOTAL124000"], 5.0, 1)
    assert A.external_totals(A.all_goods(facts, "UK"), ["X"], ["month_idx"]).first().value == 16.0


def test_balance_takes_total_rows_and_months_of_both_sources(spark):
    flows = [(*r[:3], f, m, r[5]) for r in BOTH for f in (1, 2) for m in range(24000, 24024)]
    flows = [r for r in flows if not (r[0] == "UK" and r[3] == 2 and r[4] == 24005)] + [("R", "P", "000TOTAL", 1, m, 1) for m in range(24000, 24024)]
    s = A.balance_series(goods(spark, flows), ("P",), "P", "UK")
    got = {(r.reporter_scope, r.month_idx): (r.imports, r.exports) for r in s.where("partner_scope = 'envelope'").collect()}
    assert got["eu_27", 24000] == (12.0, 11.0) and got["uk", 24000] == (5.0, 5.0) and got["eu_27_plus_uk", 24000] == (17.0, 16.0)
    assert ("uk", 24005) not in got and ("eu_27_plus_uk", 24005) not in got and ("eu_27", 24005) in got
    alone = A.balance_series(goods(spark, [r for r in flows if r[0] == "R"]), ("P",), "P", "UK")
    assert {r.reporter_scope for r in alone.select("reporter_scope").distinct().collect()} == {"eu_27"}
    b = A.trade_balance(s).where("reporter_scope = 'eu_27' and partner_scope = 'envelope'").orderBy("month_idx").collect()
    assert len(b) == 13 and b[-1].balance_current == 12.0 and b[-1].ytd == 12.0


def test_allgoods_share_reads_total_rows_of_one_source(spark):
    rows = [("R", p, c, 1, m, v) for m in range(24000, 24014) for p, v in (("P", 3), ("Q", 1), ("Z", 6)) for c in ("11000001", "000TOTAL")]
    rows += [("UK", "P", "11000001", 1, m, 100) for m in range(24000, 24014)]
    got = A.allgoods_share(goods(spark, rows), ["Z"], ("P",), "P", "UK", 24000).orderBy("month_idx").collect()
    assert [(r.month_idx, r.value_share, r.single_share, len(r.points)) for r in got] == [(24011, 0.75, 0.75, 1), (24012, 0.75, 0.75, 2), (24013, 0.75, 0.75, 3)]
