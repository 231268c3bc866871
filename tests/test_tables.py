"""Tables that change in part or appear as a whole."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from harborline.operators import ledger as L
from harborline.sources import tables
from harborline.streaming import jobs
from tests.test_ledger import SCHEMA, batch, ts


def rows_read(spark, run):
    """Rows that the scans of run() put out, by Spark's own metrics of the executions that it started."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    deadline, total = time.time() + 10, 0
    executions = store.executionsList()
    for i in range(before, executions.size()):
        number = executions.apply(i).executionId()
        values = store.executionMetrics(number)
        nodes = store.planGraph(number).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if node.name().startswith("Scan parquet"):
                for m in range(node.metrics().size()):
                    if node.metrics().apply(m).name() == "number of output rows":
                        got = values.get(node.metrics().apply(m).accumulatorId())
                        total += int(re.sub(r"\D", "", got.get())) if got.isDefined() else 0
    assert time.time() < deadline
    return total


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_second_arrival_rewrites_only_its_buckets(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = spark.range(400).select(F.format_string("k%03d", "id").alias("key"), F.lit(24000).alias("month_idx"), F.col("id").cast("double").alias("value_eur"))
    first.coalesce(1).write.parquet(src)
    run = lambda: jobs.stream_monthly_totals(spark, src, first.schema, out, ck, ["key"], buckets=16).awaitTermination(120)
    run()
    said, then = tables.pointed(spark, out), files(out)
    assert len(said["at"]) == 16 and len(set(said["at"].values())) == 1
    spark.createDataFrame([("k007", 24000, 1.0), ("new", 24001, 5.0)], first.schema).coalesce(1).write.mode("append").parquet(src)
    run()
    now, after = tables.pointed(spark, out), files(out)
    touched = {k for k in now["at"] if now["at"][k] != said["at"].get(k)}
    assert len(touched) in (1, 2) and {k: v for k, v in after.items() if k in then} == then  # old files as they were
    assert {re.search(r"bucket=(\d+)", f)[1] for f in set(after) - set(then)} == touched
    got = {r.key: (r.value, r.n_rows) for r in tables.read_keyed(spark, out).collect()}
    assert len(got) == 401 and got["k007"] == (8.0, 2) and got["new"] == (5.0, 1) and got["k100"] == (100.0, 1)
    # a batch that comes again after its switch
    again = spark.createDataFrame([("k007", 24000, 99.0, 9)], "key string, month_idx int, value double, n_rows long")
    assert tables.update_keyed(spark, out, again, ["key", "month_idx"], now["last"], lambda old, new: new) == []
    assert files(out) == after and tables.pointed(spark, out) == now
    assert tables.vacuum_keyed(spark, out) == len(touched & set(said["at"]))
    assert {r.key: (r.value, r.n_rows) for r in tables.read_keyed(spark, out).collect()} == got


def test_failed_batch_leaves_the_snapshot(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "k int, v double")
    keep = lambda old, new: tables.upserted(old, new, ["k"])
    tables.update_keyed(spark, out, df, ["k"], "1", keep, 8)

    def fails(old, new):
        return keep(old, new).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))

    with pytest.raises(Exception, match="lost"):
        tables.update_keyed(spark, out, df.withColumn("v", F.col("v") + 1), ["k"], "2", fails)
    assert tables.read_keyed(spark, out).agg(F.sum("v")).first()[0] == sum(range(50))
    tables.update_keyed(spark, out, df.withColumn("v", F.col("v") + 1), ["k"], "2", keep)
    assert tables.read_keyed(spark, out).agg(F.sum("v")).first()[0] == sum(range(50)) + 50
    # an emptied bucket goes, an empty batch changes nothing
    tables.update_keyed(spark, out, df.where("k = 3"), ["k"], "3", lambda old, new: old.where("k <> 3"))
    assert tables.read_keyed(spark, out).where("k = 3").count() == 0 and tables.read_keyed(spark, out).count() == 49
    assert tables.update_keyed(spark, out, df.where("false"), ["k"], "4", keep) == []
    assert tables.read_keyed(spark, str(tmp_path / "none")) is None


def test_ledger_merge_has_no_exchange_on_the_ledger(spark, tmp_path):
    old = L.merge_findings(spark.createDataFrame([], SCHEMA), batch(spark, *((f"k{i}", "1") for i in range(300))), ts(1)).drop("action")
    ledger = spark.table(tables.write_bucketed(old, "nk", 8, str(tmp_path / "one")))
    new = batch(spark, ("k1", "1"), ("k2", "2"), ("k999", "1"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = L.merge_findings(ledger, new, ts(2))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FullOuter") : plan.index("FileScan")]
        # between the join and the ledger's scan there is no exchange; the exchanges are those of the batch
        assert "Exchange" not in side and plan.count("FileScan") == 1 and "Bucketed: true" in plan and plan.index("FileScan") < plan.index("Exchange")
        spark.table(tables.write_bucketed(merged.drop("action"), "nk", 8, str(tmp_path / "two")))
        assert {(r.action): r.n for r in L.emit_counts(merged).collect()} == {"confirmed_existing": 1, "superseded": 1, "inserted_new": 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_two_findings_of_one_key_in_a_batch(spark):
    twice = [("a", "2"), ("a", "1"), ("b", "5"), ("b", "5")]
    for order in (twice, twice[::-1]):
        one = L.merge_findings(spark.createDataFrame([], SCHEMA), batch(spark, *order).repartition(3), ts(1))
        assert sorted((r.nk, r.sig) for r in one.collect()) == [("a", "1"), ("b", "5")]
        again = L.merge_findings(one.drop("action"), batch(spark, *order), ts(2))
        assert {r.action for r in again.collect()} == {"confirmed_existing"}
    # the same batch at the same time once more changes nothing, also what it superseded
    two = L.merge_findings(one.drop("action"), batch(spark, ("a", "9"), ("c", "1")), ts(3)).drop("action")
    assert sorted(map(tuple, L.merge_findings(two, batch(spark, ("a", "9"), ("c", "1")), ts(3)).drop("action").collect())) == sorted(map(tuple, two.collect()))


def test_report_appears_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, path)
    sheet = lambda n: spark.createDataFrame([(n,)], "run int")
    tables.publish_report(spark, {"a": sheet(1), "b": sheet(1)}, path)
    with pytest.raises(Exception, match="spoilt"):
        tables.publish_report(spark, {"a": sheet(2), "b": sheet(2).select(F.raise_error(F.lit("spoilt")).alias("run"))}, path)
    assert [df.first().run for df in tables.read_report(spark, path).values()] == [1, 1]
    tables.publish_report(spark, {"a": sheet(3), "c": sheet(3)}, path)
    assert {n: df.first().run for n, df in tables.read_report(spark, path).items()} == {"a": 3, "c": 3}


def test_clustered_files_are_skipped(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(
        (F.col("id") % 2).cast("int").alias("period"), (F.col("id") % 3 % 2 + 1).cast("int").alias("flow"), F.format_string("N%02d", F.col("id") % 25).alias("partner"),
        F.format_string("%08d", F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("code"), F.col("id").cast("double").alias("value"),
    )
    tables.write_clustered(df, str(tmp_path / "c"), ["period"], ["flow", "partner", "code"], 8, 64 << 10)
    df.write.partitionBy("period").parquet(str(tmp_path / "plain"))
    wanted = lambda path: spark.read.parquet(str(tmp_path / path)).where("period = 1 and flow = 1 and partner = 'N02' and code between '00010000' and '00012000'")
    there = wanted("plain").count()
    read = {p: rows_read(spark, lambda p=p: wanted(p).agg(F.sum("value")).collect()) for p in ("c", "plain")}
    assert wanted("c").count() == there and read["plain"] >= n // 2
    # the group's share of the period is a thousandth; what is read stays near a few pages
    assert there <= read["c"] <= n // 20
