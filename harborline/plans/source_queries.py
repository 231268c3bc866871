"""Queries over readers, sinks, streams and text operators: files are written from the given tables to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.fixtures import ENVELOPE, UK, duck, frame
from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import idsets as I
from harborline.operators import quality as Q
from harborline.operators import ranking as K
from harborline.operators import relational as R
from harborline.operators import sections as C
from harborline.operators import series as S
from harborline.operators import textcheck as T
from harborline.plans import report_queries as P
from harborline.plans.series_queries import IN_ENV, KEYS, LIMITS, r6, shapes, shared_yoy, with_series, yoy_of
from harborline.registry import query
from harborline.sources import readers, sinks, tables
from harborline.sources.sinks import kept
from harborline.streaming import jobs

SUM = "round(CAST(SUM({}) AS DOUBLE), 6)"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{sinks.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bulk_file(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """The detail rows of the EU-like source as one month's bulk file of 17 text columns; some flows and numbers are damaged."""
    f = frame(spark, sf, "facts").where(F.col("reporter") != UK)
    text = {
        "REPORTER": F.col("reporter"), "PARTNER": F.col("partner"), "TRADE_TYPE": F.lit("E"), "PRODUCT_NC": F.regexp_replace("product_nc", "^0+", ""), "FLOW": F.when(F.col("month_idx") % 13 == 0, "?").otherwise(F.col("flow").cast("string")),
        "STAT_PROCEDURE": F.col("stat_procedure"), "VALUE_EUR": F.when(F.col("month_idx") % 11 == 0, ":").otherwise(F.col("value_eur").cast("string")), "QUANTITY_KG": F.col("quantity_kg").cast("string"),
    }
    f.select(*(text.get(c, F.lit("")).alias(c) for c in readers.BULK_COLUMNS)).write.csv(path, header=True)
    return f


@query("s1_s2_bulk_trade", duck(f"""SELECT reporter, partner, flow, {SUM.format('CASE WHEN month_idx % 11 <> 0 THEN value_eur END')} AS value, {SUM.format('quantity_kg')} AS kg, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT product_nc) AS BIGINT) AS n_codes
    FROM facts WHERE reporter <> '{UK}' AND month_idx % 13 <> 0 AND {IN_ENV} AND reporter <> 'N01' AND (starts_with(product_nc, '11') OR starts_with(product_nc, '1402')) GROUP BY 1, 2, 3""", "facts"))
def s1(spark, sf):
    path = folder(spark, "bulk")
    reporters = [r.reporter for r in bulk_file(spark, sf, path).select("reporter").distinct().collect() if r.reporter != "N01"]  # a row a reporting country
    rows = readers.filter_trade(readers.read_bulk_trade(spark, path, 24000), list(ENVELOPE), reporters, ["11%", "1402%"])
    return rows.groupBy("reporter", "partner", "flow").agg(r6(F.sum("value_eur"), "value"), r6(F.sum("quantity_kg"), "kg"), F.count("*").alias("n"), F.count_distinct("product_nc").alias("n_codes"))


@query("s3_uk_trade", duck(f"SELECT partner, CASE WHEN t IN (1, 3) THEN 1 ELSE 2 END AS flow, month_idx, CAST(COUNT(*) AS BIGINT) AS n, round(CAST(SUM(value_eur) AS DOUBLE) * 1.25e0, 4) AS value_eur FROM (SELECT *, CAST(stat_procedure AS INT) AS t FROM facts WHERE reporter = '{UK}' AND partner <> 'N03') f WHERE t <= 4 GROUP BY 1, 2, 3", "facts"))
def s3(spark, sf):
    f = frame(spark, sf, "facts").where(F.col("reporter") == UK)
    date = (F.floor(F.col("month_idx") / 12) * 100 + F.col("month_idx") % 12 + 1).cast("int")
    row = F.struct(
        date.alias("MonthId"), F.substring("partner", 2, 2).cast("int").alias("CountryId"), F.col("stat_procedure").cast("int").alias("FlowTypeId"), F.col("suppression_index").alias("SuppressionIndex"), F.lit(1).alias("PortId"),
        F.col("value_eur").alias("Value"), F.col("quantity_kg").alias("NetMass"), F.struct(F.substring("product_nc", 1, 6).alias("Hs6Code"), F.col("product_nc").alias("Cn8Code")).alias("Commodity"),
    )
    path = folder(spark, "uk")
    # a page has at most the rows of one month, partner and procedure
    f.groupBy("month_idx", "partner", "stat_procedure").agg(F.collect_list(row).alias("value")).select(F.to_json(F.struct("value")).alias("value")).write.text(path)
    countries = frame(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("int").alias("country_id"), F.format_string("N%02d", F.col("n_nationkey").cast("int")).alias("partner"))
    rates = f.select("month_idx").distinct().withColumn("rate", F.lit(1.25))
    rows = readers.read_uk_trade(spark, path, countries, rates, one_a_line=True)
    return rows.groupBy("partner", "flow", "month_idx").agg(F.count("*").alias("n"), F.round(F.sum("value_gbp").cast("double") * F.max(F.lit(1.25)), 4).alias("value_eur"))


@query("s7_fx_json", duck("SELECT rate_idx, round(rate, 9) AS rate FROM fx_rates WHERE rate_idx % 12 <> 5", "fx_rates"))
def s7(spark, sf):
    """Rates as units of the currency for one EUR in one document; zero stands for months without a rate."""
    r = frame(spark, sf, "fx_rates").where("rate_idx % 4 <> 3").withColumn("at", F.row_number().over(R.Window.partitionBy("currency_from").orderBy("rate_idx")) - 1)
    month = F.format_string("%04d-%02d", F.floor(F.col("rate_idx") / 12).cast("int"), (F.col("rate_idx") % 12 + 1).cast("int"))
    x = F.when(F.col("rate_idx") % 12 == 5, 0.0).otherwise(1 / F.col("rate"))
    points = r.groupBy("currency_from").agg(F.array_sort(F.collect_list(F.struct("at", month.alias("id"), x.alias("x")))).alias("p"))  # a row a month
    observations = F.map_from_entries(F.transform("p", lambda p: F.struct(p["at"].cast("string"), F.array(p["x"]))))
    doc = F.struct(
        F.array(F.struct(F.create_map(F.lit("0:0"), F.struct(observations.alias("observations"))).alias("series"))).alias("dataSets"),
        F.struct(F.struct(F.array(F.struct(F.transform("p", lambda p: F.struct(p["id"].alias("id"))).alias("values"))).alias("observation")).alias("dimensions")).alias("structure"),
    )
    path = folder(spark, "rates")
    points.select(F.to_json(doc).alias("value")).write.text(path)
    return readers.read_fx_json(spark, path, "CNY").select("rate_idx", F.round("rate", 9).alias("rate"))


@query("s8_q21_dimensions", "SELECT n_nationkey, n_name, r_name, 'no_region' AS missing FROM nation JOIN region ON n_regionkey = r_regionkey")
def s8(spark, sf):
    nation, region = (readers.read_lookup(spark, sf, n) for n in ("nation", "region"))
    Q.require_lookups({"nation": nation, "region": region})
    missing = ",".join(Q.lookups_present({"nation": nation, "region": region, "no_region": region.where("r_regionkey < 0")}))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.lit(missing).alias("missing"))


@query("s9_s10_raw_layers", duck("SELECT CAST(year(period) AS INT) AS period, CAST(COUNT(*) AS BIGINT) AS n, round(CAST(SUM(CASE WHEN year(period) = 1997 THEN value_eur + 1 ELSE value_eur END) AS DOUBLE), 6) AS value FROM facts GROUP BY 1", "facts"))
def s9(spark, sf):
    """Years appended in two writes; then one year is replaced as a whole."""
    f = frame(spark, sf, "facts").select(F.year("period").alias("period"), "value_eur")
    path = folder(spark, "raw")
    sinks.append_raw(f.where("period < 1999"), path)
    sinks.append_raw(f.where("period >= 1999"), path)
    sinks.replace_period(f.where("period = 1997").withColumn("value_eur", (F.col("value_eur") + 1).cast("decimal(18,2)")), path)
    return spark.read.parquet(path).groupBy("period").agg(F.count("*").alias("n"), r6(F.sum("value_eur"), "value"))


@query("s13_release_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS unit FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, 'new', NULL FROM nation WHERE n_nationkey >= 20 AND n_nationkey % 3 = 0")
def s13(spark, sf):
    n = frame(spark, sf, "nation").select("n_nationkey", "n_name")
    old = n.where("n_nationkey < 20").select("n_nationkey", F.lit("old").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("unit"))
    new = n.where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("new").alias("title"), F.lit(None).cast("string").alias("unit"))
    return sinks.upsert_coalesce(old, new, ["n_nationkey"], ["title", "unit"])


@query("s14_report_sheets", with_series("SELECT 'hs_yoy' AS sheet, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT DISTINCT group_name, scope, flow FROM yoy) a UNION ALL SELECT 'stability_index', CAST(COUNT(*) AS BIGINT) FROM badge UNION ALL SELECT 'low_base_review', CAST(COUNT(*) AS BIGINT) FROM (SELECT *, MAX(month_idx) OVER (PARTITION BY group_name, scope, flow) AS t FROM yoy) a WHERE month_idx = t AND low_base", stab=P.STAB, badge=P.BADGE))
def s14(spark, sf):
    path = folder(spark, "report")
    sheets = C.report(frame(spark, sf, "facts"), frame(spark, sf, "group_patterns"), ENVELOPE, UK, LIMITS)
    names = ("hs_yoy", "stability_index", "low_base_review")
    tables.publish_report(spark, {n: sheets[n] for n in names}, path)
    published = tables.read_report(spark, path)
    rows = [published[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("sheet"), "n") for n in names]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("s15_stored_pages", "SELECT sha256('region=' || r_name) AS content_sha256, CAST(octet_length(encode('region=' || r_name)) AS INT) AS n_bytes FROM region")
def s15(spark, sf):
    path = folder(spark, "pages")
    frame(spark, sf, "region").select(F.concat(F.lit("region="), "r_name").alias("value"), "r_regionkey").repartition("r_regionkey").write.partitionBy("r_regionkey").option("lineSep", "\u0000").text(path)
    p = readers.read_pages(spark, f"{path}/*/part-*")
    body = F.rtrim(F.regexp_replace(F.decode("html", "UTF-8"), "\u0000", ""))
    return p.select(F.sha2(body, 256).alias("content_sha256"), F.octet_length(body).alias("n_bytes")).where("n_bytes > 0")


@query("s16_unprocessed", "SELECT CAST(event_id AS BIGINT) AS event_id FROM events WHERE event_id % 5 IN (1, 3)")
def s16(spark, sf):
    """Of five inputs: success, failed, no parser, failed after a success, never run before its last success."""
    e = frame(spark, sf, "events").select(F.col("event_id").cast("long").alias("event_id"))
    k = F.col("event_id") % 5
    runs = F.array(
        F.struct(F.lit(1).alias("finished_at"), F.when(k == 1, "failed").when(k == 2, "no_parser").when(k == 4, "failed").otherwise("success").alias("status")),
        F.struct(F.lit(2).alias("finished_at"), F.when(k == 3, "failed").when(k == 4, "success").alias("status")),
    )
    log = e.select("event_id", F.explode(runs).alias("r")).select("event_id", "r.*").where("status is not null")
    return readers.unprocessed(e, log, "event_id")


PAGE_ERRORS = """SELECT url, error FROM (SELECT month_idx, 'page-' || month_idx AS url, CASE month_idx % 6 WHEN 2 THEN 'unit contradicts currency' WHEN 3 THEN 'title not recognised' WHEN 4 THEN 'no observations' WHEN 5 THEN 'no currency' END AS error
    FROM (SELECT DISTINCT month_idx FROM exports WHERE currency = 'CNY' AND version_seen = 1) m) p WHERE error IS NOT NULL"""


@query("s17_page_errors", duck(PAGE_ERRORS, "exports"))
def s17(spark, sf):
    """Pages spoilt in one way each: the reason of each is reported, and no observation of them."""
    kind = F.col("month_idx") % 6
    pages = P._release_pages(spark, sf).withColumn("month_idx", F.regexp_extract("url", "[0-9]+$", 0).cast("int")).withColumn("h", F.decode("html", "UTF-8"))
    bad = (
        F.when(kind == 2, F.regexp_replace("h", "Unit: CNY 100 Million", "Unit: USD1 Million")).when(kind == 3, F.regexp_replace("h", "Table by country", "")).when(kind == 4, F.regexp_replace("h", "</td><td>", " "))
        .when(kind == 5, F.regexp_replace("h", r"\((?:Only[^)]*)?in (?:CNY|RMB)\)", "")).otherwise(F.col("h"))
    )
    bad = F.when(kind == 3, F.regexp_replace(bad, r"atcl-ttl\">[^<]*<", "atcl-ttl\">untitled<")).otherwise(bad)
    _, errors = readers.parse_release_pages(pages.select("url", F.encode(bad, "UTF-8").alias("html")))
    return errors.select("url", "error")


@query("p1_stream_monthly_totals", duck("SELECT reporter, month_idx, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value, CAST(COUNT(*) AS BIGINT) AS n_rows FROM facts GROUP BY 1, 2", "facts"))
def p1(spark, sf):
    """Two arrivals of files, each taken in by a run of the stream; the second updates totals of the first."""
    f = frame(spark, sf, "facts").select("reporter", "month_idx", "value_eur", "flow")
    src, out, state = (folder(spark, n) for n in ("arrivals", "totals", "state"))
    for flow in (1, 2):
        f.where(F.col("flow") == flow).drop("flow").write.mode("append").parquet(src)
        jobs.stream_monthly_totals(spark, src, f.drop("flow").schema, out, state, ["reporter"]).awaitTermination()
    return tables.read_keyed(spark, out).select("reporter", "month_idx", r6("value"), "n_rows")


@query("p2_stream_ledger_merge", with_series("SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE NOT changed) AS BIGINT) AS n_active_first, CAST(COUNT(*) FILTER (WHERE changed) AS BIGINT) AS n_superseded FROM (SELECT month_idx % 5 = 0 AND round(value_yoy, 6) <> round(value_yoy * 1.1e0, 6) AS changed FROM yoy) a"))
def p2(spark, sf):
    """Two batches of findings, the second with some values revised, through the stream."""
    y = shared_yoy(spark, sf)
    src, out, state = (folder(spark, n) for n in ("findings", "ledger", "state"))
    schema = None
    for k, factor in enumerate((1.0, 1.1), 1):
        batch = P._findings(y, factor).select("nk", "sig", "subkind", F.lit(f"2026-0{k}-01 00:00:00").cast("timestamp").alias("run_ts"))
        batch.write.mode("append").parquet(src)
        schema = batch.schema
        jobs.stream_ledger_merge(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination()
    ledger = tables.read_keyed(spark, out)
    first = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return ledger.agg(F.count_distinct("nk").alias("n"), F.count_if((F.col("created_at") == first) & F.col("superseded_at").isNull()).alias("n_active_first"), F.count("superseded_at").alias("n_superseded"))


# ---- operators that the other queries do not reach ------------------------------------------------

@query("w7_ytd_published", duck("SELECT label, flow, month_idx, round(v, 6) AS ytd, round(CASE WHEN p <> 0 THEN (v - p) / abs(p) END, 6) AS ytd_yoy FROM (SELECT *, value_amount AS v, MAX(value_amount) OVER (PARTITION BY label, flow ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS p FROM exports_ytd) a", "exports_ytd"))
def w7(spark, sf):
    s = S.ytd_published(frame(spark, sf, "exports_ytd").withColumnRenamed("value_amount", "ytd"), ["label", "flow"], "ytd")
    return s.select("label", "flow", "month_idx", r6("ytd"), r6("ytd_yoy"))


BADGES = {"stab": P.STAB, "badge": P.BADGE}


@query("r0d_quotability", with_series(f"""SELECT y.group_name, y.scope, y.flow, y.month_idx, concat_ws(' ', CASE WHEN y.low_base THEN 'low_base' WHEN b.badge = 'red' THEN 'red' WHEN y.fragile THEN 'fragile' ELSE COALESCE(b.badge, 'unscored') END,
    CASE WHEN y.missing > 0 THEN '(' || CAST(y.missing AS INT) || ' of 24 months missing)' END) AS quotability FROM yoy y LEFT JOIN (SELECT group_name, {P.BADGE_OF} AS badge FROM badge) b USING (group_name)""", **BADGES))
def r0d(spark, sf):
    y = shared_yoy(spark, sf)
    rows = y.join(K.stability_badge(K.stability_pairs(y)).select("group_name", "badge"), "group_name", "left")
    return K.quotability(rows).select(*KEYS, "month_idx", "quotability")


@query("r22_arithmetic_lines", with_series("SELECT group_name, scope, flow, month_idx, '(' || format('{:,}', CAST(round_even(value_current, 0) AS BIGINT)) || ' - ' || format('{:,}', CAST(round_even(value_prior, 0) AS BIGINT)) || ') / ' || format('{:,}', CAST(round_even(value_prior, 0) AS BIGINT)) AS workings FROM yoy"))
def r22b(spark, sf):
    y = yoy_of(spark, sf).withColumn("line", K.arithmetic_line())
    return y.select(*KEYS, "month_idx", F.split("line", " = ")[0].alias("workings"))


@query("r25_new_releases", duck("SELECT source, event_id FROM check_log WHERE result = 'new_data' AND checked_at > TIMESTAMP '2024-01-15 00:00:00'", "check_log"))
def r25(spark, sf):
    releases = frame(spark, sf, "check_log").where("result = 'new_data'").withColumnRenamed("checked_at", "first_seen_at")
    return C.new_releases_since(releases, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("source", "event_id")


@query("r26_carry_forward", with_series("SELECT group_name, scope, flow, month_idx, CASE WHEN month_idx % 3 = 0 THEN 'own' WHEN month_idx % 2 = 0 THEN 'earlier' END AS note FROM yoy"))
def r26(spark, sf):
    y = shared_yoy(spark, sf).withColumn("finding_id", X.nk_hash(F.lit("hs_group_yoy"), *KEYS, "month_idx"))
    current = y.select("finding_id", *KEYS, "month_idx", F.when(F.col("month_idx") % 3 == 0, "own").alias("note"))
    earlier = y.where("month_idx % 2 = 0").select("finding_id", "month_idx", F.lit("earlier").alias("note"))
    moved = y.where("month_idx % 2 = 1").select("finding_id", (F.col("month_idx") + 1).alias("month_idx"), F.lit("of another period").alias("note"))
    return K.carry_forward(current, earlier.unionByName(moved)).select(*KEYS, "month_idx", "note")


@query("r34_movers_with_drafts", with_series("SELECT group_name, month_idx, 'draft-' || group_name || '-' || month_idx AS draft_id FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY month_idx DESC) AS rk FROM (SELECT DISTINCT group_name, month_idx FROM yoy WHERE month_idx % 4 <> 0) a) b WHERE rk = 1"))
def r34(spark, sf):
    """Several drafts of a group, not all active: each group's newest active one, at its first mover only."""
    y = shared_yoy(spark, sf)
    drafts = y.select("group_name", "month_idx").distinct().select("group_name", F.concat_ws("-", F.lit("draft"), "group_name", "month_idx").alias("draft_id"), F.col("month_idx").alias("created_at"), (F.col("month_idx") % 4 != 0).alias("active"))
    movers = y.withColumn("score", K.mover_score("value_yoy", "value_current")).select(*KEYS, "score")
    j = K.movers_with_drafts(movers, drafts)
    return j.select("group_name", F.element_at(F.split("draft_id", "-"), -1).cast("int").alias("month_idx"), "draft_id")


@query("t5_corroboration_steps", with_series("SELECT group_name, scope, flow, month_idx, CASE WHEN month_idx % 2 = 0 THEN 'check customs notes|ask the trade body|look at prices' ELSE 'check customs notes|ask the trade body' END AS steps FROM yoy"))
def t5(spark, sf):
    y = yoy_of(spark, sf)
    ids = F.when(F.col("month_idx") % 2 == 0, F.array(F.lit("h2"), F.lit("h1"))).otherwise(F.array(F.lit("h1"), F.lit("h1"), F.lit("unknown")))
    drafts = y.select(*KEYS, "month_idx", F.concat_ws("|", *KEYS, "month_idx").alias("draft_id"), ids.alias("hypothesis_ids"))
    catalogue = spark.createDataFrame([("h1", 1, ["check customs notes", "ask the trade body"]), ("h2", 2, ["ask the trade body", "look at prices"])], "hypothesis_id string, ord int, steps array<string>")
    steps = T.corroboration_steps(drafts, catalogue).withColumn("d", F.split("draft_id", r"\|"))
    return steps.select(F.col("d")[0].alias("group_name"), F.col("d")[1].alias("scope"), F.col("d")[2].cast("int").alias("flow"), F.col("d")[3].cast("int").alias("month_idx"), F.array_join("steps", "|").alias("steps"))


@query("t6_rejection_rates", duck("SELECT stage, reason, model, n, round(n / SUM(n) OVER (PARTITION BY stage), 6) AS share FROM (SELECT source AS stage, result AS reason, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, CAST(COUNT(*) AS BIGINT) AS n FROM check_log GROUP BY 1, 2, 3) x", "check_log"))
def t6(spark, sf):
    log = frame(spark, sf, "check_log").select(F.col("source").alias("stage"), F.col("result").alias("reason"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("model"))
    return T.rejection_rates(log).select("stage", "reason", "model", "n", r6("share"))


@query("t9_formats", "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN printf('€%.0f', n_nationkey * 100.0) WHEN n_nationkey < 20 THEN printf('€%.1fk', n_nationkey * 1.5) ELSE printf('€%.1fM', n_nationkey * 2.5) END AS eur, printf('%+.1f%%', (n_nationkey - 12) * 4.0) AS pct FROM nation")
def t9(spark, sf):
    k = F.col("n_nationkey").cast("double")
    v = F.when(k < 10, k * 100).when(k < 20, k * 1500).otherwise(k * 2.5e6)
    return frame(spark, sf, "nation").select("n_nationkey", X.format_scaled(v).alias("eur"), X.format_pct((k - 12) / 25).alias("pct"))


@query("q8_already_present", duck("SELECT month_idx, reporter, partner, CAST(COUNT(*) AS BIGINT) AS n FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.flow = 1 AND g.month_idx = f.month_idx AND g.reporter = f.reporter AND g.partner = f.partner) GROUP BY 1, 2, 3", "facts"))
def q8(spark, sf):
    f = frame(spark, sf, "facts")
    fresh = Q.not_present(f, f.where("flow = 1"), ["month_idx", "reporter", "partner"])
    return fresh.groupBy("month_idx", "reporter", "partner").agg(F.count("*").alias("n"))


@query("j1_j12_lineage", duck(f"SELECT reporter, partner, flow, month_idx, CAST(COUNT(*) AS BIGINT) AS n, {SUM.format('value_eur')} AS value FROM facts WHERE reporter IN ('N01', 'N02') AND month_idx % 2 = 0 GROUP BY 1, 2, 3, 4", "facts"))
def j12(spark, sf):
    """Cells of two reporters, their release (of even months only), and the raw rows behind each."""
    f = frame(spark, sf, "facts")
    cells = I.id_sets(f.where("reporter in ('N01', 'N02')"), ["month_idx", "reporter", "partner", "flow"], "raw_id").withColumnRenamed("ids", "observation_ids")
    releases = f.select("month_idx").distinct().where("month_idx % 2 = 0").select(F.col("month_idx").alias("release_id"))
    released = R.with_release(cells.withColumn("release_id", F.col("month_idx")), releases)
    behind = R.lineage(released.select("month_idx", "reporter", "partner", "flow", "observation_ids"), f.select(F.col("raw_id").alias("id"), "value_eur"))
    return behind.groupBy("reporter", "partner", "flow", "month_idx").agg(F.count("*").alias("n"), r6(F.sum("value_eur"), "value"))


@query("f11_j13_groups", duck("SELECT g.group_name, CAST(COUNT(*) AS BIGINT) AS n_codes FROM (SELECT DISTINCT group_id, group_name FROM group_patterns WHERE group_name IN ('alpha', 'alpha_plus', 'gamma')) g JOIN (SELECT product_nc, list(DISTINCT group_id) AS ids FROM code_groups GROUP BY 1) c ON list_contains(c.ids, g.group_id) GROUP BY 1", "facts", "group_patterns", code_groups="SELECT DISTINCT c.product_nc, g.group_id FROM (SELECT DISTINCT product_nc FROM facts) c JOIN group_patterns g ON starts_with(c.product_nc, g.prefix)"))
def f11(spark, sf):
    """Codes with the array of their groups; for each selected group, the codes whose array has it."""
    codes = R.group_codes(frame(spark, sf, "facts"), frame(spark, sf, "group_patterns"))
    findings = kept(codes.groupBy("product_nc").agg(F.collect_set("group_id").alias("hs_group_ids")))
    chosen = R.select_groups(frame(spark, sf, "group_list"), ["alpha", "alpha_plus", "gamma"]).collect()  # the names that were asked for
    parts = [R.of_group(findings, g.group_id).agg(F.count("*").alias("n_codes")).select(F.lit(g.group_name).alias("group_name"), "n_codes") for g in chosen]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
