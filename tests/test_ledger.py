from pyspark.sql import functions as F

from harborline.operators import ledger as L

SCHEMA = "id string, nk string, sig string, subkind string, created_at timestamp, last_confirmed_at timestamp, superseded_at timestamp, superseded_by_id string"


def ts(day):
    return F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")


def batch(spark, *rows):
    return spark.createDataFrame([(k, s, "x") for k, s in rows], "nk string, sig string, subkind string")


def test_insert_confirm_supersede(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = L.merge_findings(empty, batch(spark, ("a", "1"), ("b", "1")), ts(1))
    assert {(r.nk, r.action) for r in one.collect()} == {("a", "inserted_new"), ("b", "inserted_new")}
    two = L.merge_findings(one.drop("action"), batch(spark, ("a", "1"), ("b", "2"), ("c", "1")), ts(2))
    actions = {(r.subkind, r.action): r.n for r in L.emit_counts(two).collect()}
    assert actions == {("x", "confirmed_existing"): 1, ("x", "superseded"): 1, ("x", "inserted_new"): 1}
    assert L.active(two).count() == 3 and L.duplicate_active(two).count() == 0
    old = two.where("nk = 'b' and superseded_at is not null").first()
    new = two.where("nk = 'b' and superseded_at is null").first()
    assert old.superseded_by_id == new.id
    again = L.merge_findings(two.drop("action"), batch(spark, ("a", "1"), ("b", "2"), ("c", "1")), ts(3))
    assert again.count() == two.count() and {r.action for r in L.emit_counts(again).collect()} == {"confirmed_existing"}
    chain = {(r.nk, r.revision): r.previous_id for r in L.revision_chain(two).collect()}
    assert chain[("b", 2)] == old.id


def test_withdraw_points_past_the_bad_run(spark):
    led = spark.createDataFrame([], SCHEMA)
    for day, sig in ((1, "1"), (2, "bad"), (3, "3")):
        led = L.merge_findings(led, batch(spark, ("a", sig)), ts(day)).drop("action")
    fixed = L.withdraw_interval(led, ts(2), ts(3), ["x"])
    rows = {r.sig: r for r in fixed.collect()}
    assert set(rows) == {"1", "3"} and rows["1"].superseded_by_id == rows["3"].id
    gone = L.retire(fixed, batch(spark, ("a", "")), ts(4))
    assert L.active(gone).count() == 0 and gone.where("sig = '3'").first().superseded_by_id is None


def test_observation_versions(spark):
    old = spark.createDataFrame([("k", None, 1.0, 1), ("k", None, 2.0, 2), ("m", "p", 5.0, 1)], "a string, b string, v double, version_seen int")
    new = spark.createDataFrame([("k", None, 2.0), ("m", "p", 6.0), ("n", None, None)], "a string, b string, v double")
    got = {r.a: (r.status, r.version_seen) for r in L.version_observations(old, new, ["a", "b"], ["v"]).collect()}
    assert got == {"k": ("unchanged", 2), "m": ("changed", 2), "n": ("new", 1)}
