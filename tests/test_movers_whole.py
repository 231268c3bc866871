"""Product movers at the latest month of the data, by whole code."""

import pytest

from harborline.plans import section_queries, series_queries

#: Two codes of one heading and their imports in the newest 26 months: a steady rise, and a fall that hides it in the heading.
RISE, FALL = "11010101", "11010102"


@pytest.fixture
def facts(spark, monkeypatch):
    rows = [(c, 1, m, 10_000.0 + step * (m - 23997)) for c, step in ((RISE, 1_000.0), (FALL, -400.0)) for m in range(23997, 24023)]
    rows += [(FALL, 1, m, 200_000.0) for m in range(23950, 23997)] + [(RISE, 2, 24030, 1.0)]
    df = spark.createDataFrame(rows, "product_nc string, flow int, month_idx int, value double").selectExpr("product_nc", "flow", "month_idx", "cast(value as decimal(18,2)) as value_eur")
    patterns = spark.createDataFrame([(6, "alpha_plus", "11")], "group_id int, group_name string, prefix string")
    for module in (series_queries, section_queries):
        monkeypatch.setattr(module, "frame", lambda spark, sf, name: df if name == "facts" else patterns)


def test_b4_is_at_the_latest_month_and_by_whole_code(spark, facts):
    got = {r.product_nc: r for r in series_queries.b4(spark, "").collect()}
    assert set(got) == {RISE, FALL} and got[RISE].verdict == "mover"
    assert got[RISE].current == sum(10_000 + 1_000 * k for k in range(14, 26)) and got[RISE].prior == sum(10_000 + 1_000 * k for k in range(2, 14))


def test_r12_names_the_whole_code(spark, facts):
    (r,) = section_queries.r12(spark, "").collect()
    assert r.product_nc == RISE and r.yoy > 0
