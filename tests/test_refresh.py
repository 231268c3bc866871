"""Incremental refresh: equal to a full run, and what is read grows with the change."""

import random

import pytest
from pyspark.sql import functions as F

from harborline.operators import families as A
from harborline.operators import refresh as I
from harborline.sources import tables
from tests.test_tables import files, rows_read

FACTS = "month_idx int, reporter string, partner string, product_nc string, flow int, value_eur decimal(18,2), quantity_kg decimal(20,3), suppression_index int"
PATTERNS = [(1, "a", "11"), (2, "b", "12"), (3, "ab", "11"), (3, "ab", "1201"), (4, "c", "13"), (5, "d", "14"), (6, "e", "15")]
ENVELOPE, UK = ("CN", "HK"), "UK"


def facts_of(spark, seed=0, months=range(24000, 24060)):
    r = random.Random(seed)
    rows = []
    for m in months:
        for code in ("11010101", "11020101", "12010101", "12020101", "13010101", "14010101", "15010101"):
            for who in ("DE", "FR", UK):
                if r.random() < 0.9:
                    rows.append((m, who, r.choice(["CN", "HK", "US"]), code, r.choice([1, 2]), r.randrange(1, 10**8) / 100, r.choice([None, r.randrange(1, 10**6) / 1000]), int(r.random() < 0.05)))
    return spark.createDataFrame([(m, w, p, c, f, __import__("decimal").Decimal(str(v)), None if k is None else __import__("decimal").Decimal(str(k)), s) for m, w, p, c, f, v, k, s in rows], FACTS)


def same(a, b):
    cols = sorted(b.columns)
    return sorted(map(repr, map(tuple, a.select(cols).collect()))) == sorted(map(repr, map(tuple, b.select(cols).collect())))


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame(PATTERNS, "group_id int, group_name string, prefix string")


def test_refresh_is_a_full_run(spark, patterns, tmp_path):
    raw, state = str(tmp_path / "raw"), str(tmp_path / "state")
    facts_of(spark).write.partitionBy("month_idx").parquet(raw)
    facts = lambda: spark.read.schema(FACTS).parquet(raw)
    full = lambda: A.group_yoy(A.group_series(facts(), patterns, ENVELOPE, UK))
    I.build(spark, state, facts(), patterns, ENVELOPE, UK)
    assert same(tables.read_keyed(spark, f"{state}/yoy"), full())

    def replace(month, df):
        df.select([c for c in facts().columns]).where(F.col("month_idx") == month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_idx").parquet(raw)

    # one code of one month revised
    whole = facts_of(spark)
    replace(24030, whole.withColumn("value_eur", F.when(F.col("product_nc") == "13010101", F.col("value_eur") * 2).otherwise(F.col("value_eur")).cast("decimal(18,2)")))
    then = files(f"{state}/yoy")
    said = I.refresh(spark, state, facts(), [24030], patterns, ENVELOPE, UK, "1")
    assert 1 <= said["cells"] <= 6 and said["anchors"] == 24 * said["cells"] and {k: v for k, v in files(f"{state}/yoy").items() if k in then} == then
    assert said["buckets"] <= said["cells"] and same(tables.read_keyed(spark, f"{state}/yoy"), full())
    assert same(tables.read_keyed(spark, f"{state}/series"), A.group_series(facts(), patterns, ENVELOPE, UK))
    # again: nothing changes; and a refresh without a change
    assert I.refresh(spark, state, facts(), [24030], patterns, ENVELOPE, UK, "2") == {"cells": 0, "anchors": 0, "buckets": 0}
    # one source gone from a month: the combined scope of all groups goes there; a new last month; a code that vanishes
    replace(24040, whole.where("reporter <> 'UK'"))
    replace(24060, facts_of(spark, 5, [24060]))
    replace(24010, whole.where("product_nc <> '14010101'"))
    I.refresh(spark, state, facts(), [24010, 24040, 24060], patterns, ENVELOPE, UK, "3")
    assert same(tables.read_keyed(spark, f"{state}/yoy"), full())


def test_refresh_that_died_is_finished(spark, patterns, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    before, after = facts_of(spark, 1), facts_of(spark, 1).withColumn("value_eur", F.when(F.col("month_idx") == 24025, F.col("value_eur") + 1).otherwise(F.col("value_eur")).cast("decimal(18,2)"))
    I.build(spark, state, before, patterns, ENVELOPE, UK)
    real, calls = I.update_keyed, []

    def dies(spark, path, *rest, **more):
        calls.append(path)
        if path.endswith("/series"):
            raise RuntimeError("lost")
        return real(spark, path, *rest, **more)

    monkeypatch.setattr(I, "update_keyed", dies)
    with pytest.raises(RuntimeError):
        I.refresh(spark, state, after, [24025], patterns, ENVELOPE, UK, "1")
    monkeypatch.setattr(I, "update_keyed", real)
    I.refresh(spark, state, after, [24025], patterns, ENVELOPE, UK, "1")
    assert same(tables.read_keyed(spark, f"{state}/yoy"), A.group_yoy(A.group_series(after, patterns, ENVELOPE, UK)))
    assert same(tables.read_keyed(spark, f"{state}/codes"), A.code_totals(after, ENVELOPE, UK))


def test_rows_read_follow_the_change(spark, patterns, tmp_path):
    raw, state = str(tmp_path / "raw"), str(tmp_path / "state")
    df = facts_of(spark, 2, range(24000, 24120))
    df.write.partitionBy("month_idx").parquet(raw)
    facts = spark.read.schema(FACTS).parquet(raw)
    I.build(spark, state, facts, patterns, ENVELOPE, UK)
    n_facts, n_months = df.count(), 120
    revised = df.where("month_idx = 24060").withColumn("value_eur", F.when(F.col("product_nc").startswith("15"), F.col("value_eur") + 1).otherwise(F.col("value_eur")).cast("decimal(18,2)"))
    revised.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_idx").parquet(raw)
    slice_ = rows_read(spark, lambda: spark.read.schema(FACTS).parquet(raw).where("month_idx = 24060").write.format("noop").mode("overwrite").save())
    assert slice_ <= 2 * n_facts / n_months
    scanned = rows_read(spark, lambda: I.refresh(spark, state, spark.read.schema(FACTS).parquet(raw), [24060], patterns, ENVELOPE, UK, "1"))
    full = rows_read(spark, lambda: I.build(spark, str(tmp_path / "other"), spark.read.schema(FACTS).parquet(raw), patterns, ENVELOPE, UK))
    assert scanned < 0.7 * full
    assert same(tables.read_keyed(spark, f"{state}/yoy"), tables.read_keyed(spark, f"{tmp_path}/other/yoy"))
