import pytest
from pyspark.sql import functions as F

from harborline.functions import expr as X


def one(spark, c, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(c.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("unit", "want"), [("CNY 100 Million", (1e8, "CNY")), ("USD1 Million", (1e6, "USD")), (None, (1.0, None)), ("", (1.0, None)), ("tonnes of coal", None), ("EUR", (1.0, "EUR"))]
)
def test_unit_scale(spark, unit, want):
    got = one(spark, X.unit_scale("u"), u=unit)
    assert (got if want is None else tuple(got)) == want


@pytest.mark.parametrize(("c", "p", "want"), [(12.0, 10.0, 0.2), (5.0, -10.0, 1.5), (1.0, 0.0, None), (1.0, None, None)])
def test_yoy(spark, c, p, want):
    got = one(spark, X.yoy(F.lit(c).cast("double"), F.lit(p).cast("double")))
    assert got == want if want is None else got == pytest.approx(want)


def test_months(spark):
    assert one(spark, X.month_idx(F.lit("2026-02-01").cast("date"))) == 2026 * 12 + 1
    assert str(one(spark, X.month_start(F.lit(2026 * 12 + 1)))) == "2026-02-01"
    assert one(spark, X.days_in_window(F.lit(2024 * 12), F.lit(2024 * 12 + 1))) == 60


@pytest.mark.parametrize(("text", "value", "rejected"), [("1,234.5", 1234.5, False), ("12 345", 12345.0, False), ("-", None, False), ("", None, False), ("n/a", None, True), ("-7", -7.0, False)])
def test_number_cells(spark, text, value, rejected):
    assert one(spark, X.parse_number("t"), t=text) == value
    assert one(spark, X.number_rejected("t"), t=text) is rejected


def test_partner_label(spark):
    assert tuple(one(spark, X.partner_label("t"), t=" \n  of which:  Hong Kong \t")) == ("Hong Kong", 2, True)


def test_predicates(spark):
    codes = spark.createDataFrame([("11000000",), ("000TOTAL",), ("11XXXXXX",), ("13010000",)], "c string")
    got = codes.select(X.starts_with_any("c", ["11%", "00%"]).alias("a"), X.is_detail_code("c").alias("b"), X.starts_with_any("c", []).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False), (True, False, False), (False, True, False)]


def test_price_needs_coverage(spark):
    assert one(spark, X.unit_price(F.lit(10.0), F.lit(4.0), F.lit(0.79))) is None
    assert one(spark, X.unit_price(F.lit(10.0), F.lit(4.0), F.lit(0.80))) == 2.5


def test_texts(spark):
    assert one(spark, X.short_label(F.lit("Pumps; parts (other)"))) == "Pumps"
    assert one(spark, X.slug(F.lit("EV batteries (Li-ion)"))) == "ev-batteries-li-ion"
    assert one(spark, X.format_scaled(F.lit(1.25e9))) == "€1.25B"
    assert one(spark, X.format_pct(F.lit(-0.034))) == "-3.4%"


def test_keys_tell_null_from_empty(spark):
    a, b = (one(spark, X.nk_hash(F.lit("k"), F.lit(v).cast("string"))) for v in (None, ""))
    assert a != b and len(a) == 32
    assert one(spark, X.value_signature("v1", F.lit(0.1 + 0.2))) == one(spark, X.value_signature("v1", F.lit(0.3)))
