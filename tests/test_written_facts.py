"""Facts and exports are joined once and written; groups and parts shuffle little."""

import re

from pyspark.sql import functions as F

from harborline import fixtures
from harborline.fixtures import ENVELOPE, UK, frame
from harborline.operators import families as A

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_read_not_joined(spark):
    """Before, every use of facts joined five tables again."""
    for name in ("facts", "exports_raw"):
        assert "Join" not in plan_of(frame(spark, SF, name))
        plain = spark.sql(fixtures.SQL[name], **{n: frame(spark, SF, n) for n in fixtures.needs(name)})
        df = frame(spark, SF, name)
        assert df.columns == plain.columns and df.exceptAll(plain).isEmpty() and plain.exceptAll(df).isEmpty()


def test_other_input_is_not_taken_for_the_same(spark, tmp_path):
    for n in fixtures.BASE:
        spark.read.parquet(f"{SF}/{n}.parquet").write.parquet(f"{tmp_path}/{n}.parquet")
    before = frame(spark, str(tmp_path), "facts").count()
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < frame(spark, str(tmp_path), "facts").count() < before


def test_codes_are_not_shuffled_for_group_totals(spark):
    facts, patterns = frame(spark, SF, "facts"), frame(spark, SF, "group_patterns")
    direct = A.group_series(facts, patterns, ENVELOPE, UK)
    by_code = A.series_of_codes(A.code_totals(facts, ENVELOPE, UK), patterns)
    assert direct.exceptAll(by_code.select(direct.columns)).isEmpty() and direct.count() == by_code.count()
    assert not re.search(r"Exchange hashpartitioning\(product_nc", plan_of(direct))


def test_windows_of_parts_are_dealt_by_rows(spark, monkeypatch):
    """One late anchor a group: as many tasks as its rows ask for, and the same sums as with all anchors."""
    facts, patterns = frame(spark, SF, "facts"), frame(spark, SF, "group_patterns")
    yoy = A.group_yoy(A.group_series(facts, patterns, ENVELOPE, UK), most_missing=24)
    late = yoy.where("month_idx = 23980")
    monkeypatch.setattr(A, "PART_ROWS", 50)
    anchors = lambda df: df.select(*A.KEYS, "month_idx")
    some = A.windowed_parts(facts, patterns, anchors(late), "product_nc", ENVELOPE, UK).where("part_current > 0 or part_prior > 0")
    every = A.windowed_parts(facts, patterns, anchors(yoy), "product_nc", ENVELOPE, UK).where("(part_current > 0 or part_prior > 0) and month_idx = 23980")
    assert some.count() > 0 and some.exceptAll(every.select(some.columns)).isEmpty() and some.count() == every.count()
    dealt = re.findall(r"REPARTITION_BY_NUM|hashpartitioning\(group_name[^)]*product_nc[^)]*, (\d+)\)", plan_of(some))
    assert any(d and int(d) > 4 for d in dealt)
