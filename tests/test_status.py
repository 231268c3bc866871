"""Status of sources, run histories, published figures, the cycle's digest."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from harborline.operators import quality as Q
from harborline.operators import ranking as K


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rollup_names_gaps_and_strangers(spark):
    log = spark.createDataFrame([("a", 1, "new_data", 1), ("a", 2, "error", 2), ("x", 3, "new_data", 3)], "source string, checked_at int, result string, event_id int")
    releases = spark.createDataFrame([("a", m) for m in (24010, 24011, 24013, 24014)] + [("j", m) for m in (24010, 24011, 24013, 24015)] + [("x", 1)], "source string, month_idx int")
    sources = spark.createDataFrame([("a", False), ("j", True), ("n", False)], "source string, january_with_february boolean")
    got = {r.source: (r.last_result, r.n_checks, r.latest_idx, r.gaps) for r in Q.sources_rollup(log, releases, sources).collect()}
    assert got == {"a": ("error", 2, 24014, [24012]), "j": (None, None, 24015, [24014]), "n": (None, None, None, [])}


def test_histories_and_figures(spark):
    log = spark.createDataFrame([(i, i // 2, "ok", 5, {"a": i, "b": 1} if i % 2 else None) for i in range(6)], "run_id int, at int, result string, duration_ms int, counts map<string,int>")
    got = [(r.log, r["rank"], r.run_id, r.total) for r in Q.run_histories({"one": log, "two": log.where("false")}, 3).orderBy("rank").collect()]
    assert got == [("one", 1, 5, 6), ("one", 2, 4, None), ("one", 3, 3, 4)]
    sums = spark.createDataFrame([(1, 104.0), (2, 106.0)], "year int, value double")
    told = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0), (4, 0.0)], "year int, figure double")
    assert {r.year: r.within for r in Q.against_published(sums, told, ["year"]).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_digest_by_regime(spark):
    pairs = spark.createDataFrame([("g", "eu_27", 1, 0.10, 0.30), ("h", "uk", 2, -0.02, 0.01), ("i", "uk", 1, 0.50, 0.52)], "group_name string, scope string, flow int, old_value double, new_value double")
    shifts = K.significant_shifts(pairs)
    one = lambda regime, new: spark.createDataFrame([(3, 1, 1, 0, new, regime)], "n_pairs int, n_flips int, n_material int, n_same int, n_new int, regime string")
    text = lambda regime, new=2, s=shifts: K.cycle_digest(one(regime, new), s, ["group_name"]).first().digest
    assert text("movement") == "2 findings moved by more than five points, 1 of them to the other side; sharpest: h (uk exports) -2.0% to +1.0%; g (eu_27 imports) +10.0% to +30.0%. 2 findings are new."
    assert text("movement", 1, shifts.where("false")) == "1 findings are new."
    assert text("first_export").startswith("First export") and text("no_change").startswith("No new") and "3 findings" in text("method_bump")


def test_ranks_of_the_sheet(spark):
    sheet = spark.createDataFrame([("a",), ("b",)], "group_name string")
    movers = spark.createDataFrame([("a", "eu_27", 1, 2), ("a", "uk", 2, 1)], "group_name string, scope string, flow int, rank int")
    assert sorted(map(tuple, K.with_ranks(sheet, movers).collect()), key=str) == [("a", 2, None), ("b", None, None)]


def test_empty_lookups_fail(spark):
    full, empty = spark.range(1), spark.range(0)
    Q.require_lookups({"a": full})
    with pytest.raises(ValueError, match="b"):
        Q.require_lookups({"a": full, "b": empty.where(F.lit(True))})
