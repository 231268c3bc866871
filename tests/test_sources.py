import json

import pytest
from pyspark.sql import functions as F

from harborline.operators import textcheck as T
from harborline.sources import readers, sinks, tables
from harborline.streaming import jobs


def test_bulk_csv(spark, tmp_path):
    row = ["DE", "CN", "E", "1110000", "", "", "", "", "", "", "1", "1", "", "12.50", "x", "3", ""]
    bad = [*row]
    bad[10] = "?"
    (tmp_path / "a.csv").write_text("\n".join(",".join(r) for r in (readers.BULK_COLUMNS, row, bad)))
    got = readers.read_bulk_trade(spark, str(tmp_path / "a.csv"), 24000).collect()
    assert [(r.product_nc, r.flow, float(r.value_eur), r.value_nac) for r in got] == [("01110000", 1, 12.5, None)]
    df = spark.createDataFrame([("CN", "DE", "11000000"), ("HK", "FR", "12000000")], "partner string, reporter string, product_nc string")
    assert readers.filter_trade(df, ["CN", "HK"], None, ["12%"]).count() == 1


def test_uk_json(spark, tmp_path):
    rows = [{"MonthId": 202601, "CountryId": c, "FlowTypeId": f, "SuppressionIndex": 0, "PortId": 1, "Value": 10, "NetMass": 2, "Commodity": {"Cn8Code": "1110000", "Hs6Code": "011100"}} for c, f in ((1, 1), (1, 4), (1, 9), (7, 1))]
    (tmp_path / "p.json").write_text(json.dumps({"value": rows}))
    countries = spark.createDataFrame([(1, "CN")], "country_id int, partner string")
    rates = spark.createDataFrame([(2026 * 12, 1.2)], "month_idx int, rate double")
    got = readers.read_uk_trade(spark, str(tmp_path / "p.json"), countries, rates).collect()
    assert sorted((r.partner, r.flow, r.product_nc, round(r.value_eur, 6)) for r in got) == [("CN", 1, "01110000", 12.0), ("CN", 2, "01110000", 12.0)]


def test_rate_json(spark, tmp_path):
    doc = {"dataSets": [{"series": {"0:0": {"observations": {"0": [8.0], "1": [0.0], "2": [None]}}}}], "structure": {"dimensions": {"observation": [{"values": [{"id": "2026-01"}, {"id": "2026-02"}, {"id": "2026-03"}]}]}}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    assert [(r.rate_idx, r.rate) for r in readers.read_fx_json(spark, str(tmp_path / "r.json"), "CNY").collect()] == [(2026 * 12, 0.125)]


def test_pages_without_rows_are_errors(spark):
    page = "<title>(4) By country, Jan-Feb, 2026 (CNY)</title><tr><td>Unit: CNY 100 Million</td></tr><tr>" + "".join(f"<td>{c}</td>" for c in ("Total", "1,000", "600", "400", "", "", "")) + "</tr>"
    pages = spark.createDataFrame([("a", page.encode()), ("b", b"<p>nothing</p>"), ("c", b"\xff\xfe")], "url string, html binary")
    obs, errors = readers.parse_release_pages(pages)
    got = {(r.label, r.period_kind, r.flow): (r.month_idx, r.value_amount, r.unit) for r in obs.collect()}
    assert got[("Total", "cumulative_jan_feb", "export")] == (2026 * 12 + 1, 600.0, "CNY 100 Million")
    assert {r.url for r in errors.collect()} == {"b", "c"}


TITLES = [
    ("(4) Total Values by Country/Region, Mar 2026 (in CNY)", (4, 24314, False, "CNY", None)),
    ("(4) Total Values by Country/Region, March 2025 (in CNY)", (4, 24302, False, "CNY", None)),
    ("(4) Total Values by Country/Region, May 2025 (in USD)", (4, 24304, False, "USD", None)),
    ("Total Values by Major Country (Region), Jan. 2018 (in RMB)", (4, 24216, False, "CNY", None)),
    ("(1) Total Values, September 2024 (Only Sept., in CNY)", (1, 24296, False, "CNY", None)),
    ("(4) Total Values by Country/Region, January-February 2025 (in CNY)", (4, 24301, True, "CNY", None)),
    ("(3) Total Values by Country/Region, Jan\u2013Feb 2020 (in CNY)", (4, 24241, True, "CNY", None)),
    ("(4) Total Values by Country/Region, January \u2014 February 2025 (in USD)", (4, 24301, True, "USD", None)),
    ("Total Values by Country/Region (in CNY)", (4, 7, False, "CNY", None)),
    ("(2) Total Values by Trade Mode, Jul 2018", (2, 24222, False, "USD", None)),
    ("Something else", (1, 7, False, "USD", "title not recognised")),
]


def test_release_titles(spark):
    df = spark.createDataFrame([(t,) for t, _ in TITLES], "title string").withColumn("t", readers.title_parts(F.col("title"), F.lit("USD"), F.lit(7)))
    got = {r.title: (r.t.section, r.t.month_idx, r.t.combined, r.t.currency, r.t.reason) for r in df.collect()}
    assert got == dict(TITLES)
    none = spark.createDataFrame([("Total (in CNY)",), ("Total, May 2025",)], "title string").withColumn("t", readers.title_parts(F.col("title"), F.lit(None).cast("string"), F.lit(None).cast("int")))
    assert [r.t.reason for r in none.collect()] == ["no period", "no currency"]


def page(title, rows, unit="<span><b>Unit: CNY 100 Million</b></span>"):
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f'<html><div class="atcl-ttl">{title}</div><div class="atcl-date">08/04/2026</div><div class="atcl-cnt"><table><tr><td>{unit}</td></tr><tr><td colspan="3">Export</td></tr>{body}</table></div></html>'.encode()


def test_release_pages(spark):
    ten = ["\n\u00a0\u00a0of which: Region  A", "1,000", "2,000", "600", "1,200", "400", "-", "1", "2", "3"]
    head = ["Country", "Month", "1 to 3", "Month", "1 to 3", "Month", "1 to 3", "a", "b", "c"]
    pages = [
        ("a", page("(4) Values by Country/Region, Mar 2026 (in CNY)", [head, ten])), ("b", page("(4) Values by Country/Region, January-February 2025 (in RMB)", [ten[:7], ten])),
        ("c", page("(4) Values by Country/Region, Mar 2026 (in CNY)", [ten], "Unit: USD1 Million")), ("d", page("nothing", [ten])), ("e", page("(4) Values by Country/Region, Mar 2026 (in CNY)", [head])),
    ]
    obs, errors = readers.parse_release_pages(spark.createDataFrame(pages, "url string, html binary"))
    got = {(r.url, r.period_kind, r.flow): (r.label, r.indent, r.is_subset, r.month_idx, r.value_amount, r.unit, str(r.published)) for r in obs.collect()}
    assert got["a", "ytd", "export"] == ("Region A", 2, True, 24314, 1200.0, "CNY 100 Million", "2026-04-08") and ("a", "ytd", "import") not in got and len([k for k in got if k[0] == "a"]) == 5
    assert got["b", "cumulative_jan_feb", "import"][3:5] == (24301, 600.0) and len([k for k in got if k[0] == "b"]) == 3
    assert {r.url: r.error for r in errors.collect()} == {"c": "unit contradicts currency", "d": "title not recognised", "e": "no observations"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "period int, v string")
    sinks.append_raw(df, path)
    sinks.replace_period(spark.createDataFrame([("c", 2)], "v string, period int"), path)
    assert sorted((r.period, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        sinks.replace_period(df.where("false"), path)
    old = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    new = spark.createDataFrame([(1, None, "z"), (2, "n", None)], "k int, a string, b string")
    assert sorted(map(tuple, sinks.upsert_coalesce(old, new, ["k"], ["a", "b"]).collect())) == [(1, "x", "z"), (2, "n", None)]
    tables.publish_report(spark, {"s": df}, str(tmp_path / "report"))
    assert tables.read_report(spark, str(tmp_path / "report"))["s"].count() == 2


def test_failed_inputs_come_again(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    log = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "success"), ("b", 1, "success"), ("b", 2, "failed")], "url string, finished_at int, status string")
    assert {r.url for r in readers.unprocessed(inputs, log).collect()} == {"b", "c"}


def test_numbers_in_text():
    got = T.numbers_in("In 2025 imports fell 12.5% to €1.2bn over 12 months; exports rose 3%. EU-27 sold 40 ships of code 85076000.")
    assert ("12.5%", -0.125, "pct") in got and ("€1.2bn", 1.2e9, "currency") in got and ("40", 40.0, "count") in got
    assert not any(v in (2025.0, 12.0, 27.0, 85076000.0) for _, v, _ in got)
    assert T.numbers_in("") == []
    for text, want in (("5 kg", [("5 kg", 5.0, "count")]), ("3 Brussels", [("3", 3.0, "count")]), ("2 Member", [("2", 2.0, "count")]), ("39 months", []), ("24-month", []), ("G7, G-20 and EU-27", []), ("HS-84", [])):
        assert T.numbers_in(text) == want
    for text, want in (("chapters 84-85 (broad)", []), ("HS 84/85", []), ("CN8 85051110", []), ("cut 4.2%", [("4.2%", -0.042, "pct")]), ("losses of 36.8%", [("36.8%", -0.368, "pct")]), ("+3% while falling", [("+3%", 0.03, "pct")])):
        assert T.numbers_in(text) == want
    assert T.numbers_in("fell to €441M") == [("€441M", 441e6, "currency")] and T.numbers_in("1,234.5 thousand") == [("1,234.5 thousand", 1234500.0, "currency")]


def test_verification(spark):
    drafts = spark.createDataFrame([("d", "rose 10.2% to €105M", {"yoy": 0.10, "v": 1e8}), ("e", "rose 50%", {"yoy": 0.1}), ("f", None, {})], "draft_id string, text string, facts map<string,double>")
    v = T.verify_numbers(T.extract_numbers(drafts), T.flatten_facts(drafts))
    assert {(r.draft_id, r.kind): (r.nearest, r.verified) for r in v.collect()} == {("d", "pct"): ("yoy", True), ("d", "currency"): ("v", True), ("e", "pct"): ("yoy", False)}


def test_streams_can_be_run_twice(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("k", 24000, 5.0), ("k", 24000, 6.0)], "key string, month_idx int, value_eur double")
    for want in (11.0, 22.0, 22.0):
        if want == 22.0 and spark.read.parquet(src).count() == 4:
            pass
        else:
            df.coalesce(1).write.mode("append").parquet(src)
        jobs.stream_monthly_totals(spark, src, df.schema, out, str(tmp_path / "ck"), ["key"]).awaitTermination(120)
        assert [r.value for r in tables.read_keyed(spark, out).collect()] == [want]
    findings = str(tmp_path / "findings")
    f = spark.createDataFrame([("a", "1", "x")], "nk string, sig string, subkind string").withColumn("run_ts", F.lit("2026-01-01").cast("timestamp"))
    f.write.parquet(findings)
    for _ in range(2):
        jobs.stream_ledger_merge(spark.readStream.schema(f.schema).parquet(findings), str(tmp_path / "ledger"), str(tmp_path / "ck2")).awaitTermination(120)
        assert tables.read_keyed(spark, str(tmp_path / "ledger")).count() == 1
