"""Queries over status, run histories, published figures, ranks and the cycle's digest, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.fixtures import SINGLE_PARTNER, UK, duck, frame
from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import ledger as L
from harborline.operators import quality as Q
from harborline.operators import ranking as K
from harborline.operators import relational as R
from harborline.operators import sections as C
from harborline.plans import report_queries as P
from harborline.plans.series_queries import CODE_GROUPS, CODES, KEYS, LIMITS, MOVERS, r6, shared_yoy, with_series, yoy_of
from harborline.registry import query

YEARS = f"SELECT CAST(month_idx // 12 AS INT) AS year, product_nc, value_eur FROM facts_full WHERE reporter <> '{UK}' AND partner = '{SINGLE_PARTNER}' AND flow = 1"


@query("q5_published_figures", duck("""SELECT year, round(figure, 6) AS figure, round(value, 6) AS value, round(abs(value - figure) / abs(figure), 6) AS difference, COALESCE(abs(value - figure) / abs(figure) < 0.05, FALSE) AS within FROM (
    SELECT year, CAST(SUM(value_eur) FILTER (WHERE product_nc = '000TOTAL') AS DOUBLE) * (1 + (year % 3) * 0.04e0) AS figure, CAST(SUM(value_eur) FILTER (WHERE product_nc <> '000TOTAL') AS DOUBLE) AS value FROM rows GROUP BY year) a WHERE figure IS NOT NULL""", "facts_full", rows=YEARS))
def published(spark, sf):
    """A year's detail rows against the figure published for it; two years of three are published otherwise."""
    rows = frame(spark, sf, "facts_full").where((F.col("reporter") != UK) & (F.col("partner") == SINGLE_PARTNER) & (F.col("flow") == 1)).withColumn("year", F.floor(F.col("month_idx") / 12).cast("int"))
    told = rows.where(F.col("product_nc") == X.TOTAL_CODE).groupBy("year").agg((F.sum("value_eur").cast("double") * (1 + (F.col("year") % 3) * 0.04)).alias("figure"))
    sums = rows.where(F.col("product_nc") != X.TOTAL_CODE).groupBy("year").agg(F.sum("value_eur").cast("double").alias("value"))
    return Q.against_published(sums, told, ["year"]).select("year", r6("figure"), r6("value"), r6("difference"), "within")


RELEASES = """SELECT DISTINCT 'view' AS source, month_idx FROM facts WHERE month_idx % 9 <> 0 UNION ALL SELECT DISTINCT 'click', month_idx FROM facts WHERE month_idx % 7 <> 1
    UNION ALL SELECT DISTINCT 'gacc', month_idx FROM facts WHERE month_idx % 12 > 1 UNION ALL SELECT DISTINCT 'unexpected', month_idx FROM facts"""


@query("q11_sources_rollup", duck("""SELECT s.source, last_checked, last_result, last_new_data, CAST(n_checks AS BIGINT) AS n_checks, CAST(n_errors AS BIGINT) AS n_errors, latest_idx,
      COALESCE((SELECT string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) FROM range(r.first_idx, r.latest_idx) t(g) WHERE NOT list_contains(r.there, CAST(g AS INT)) AND NOT (s.january AND g % 12 = 0)), '') AS gaps
    FROM (VALUES ('view', FALSE), ('click', FALSE), ('signup', FALSE), ('gacc', TRUE), ('never', FALSE)) AS s(source, january)
    LEFT JOIN (SELECT source, MAX(checked_at) AS last_checked, arg_max(result, (checked_at, event_id)) AS last_result, MAX(checked_at) FILTER (WHERE result = 'new_data') AS last_new_data, COUNT(*) AS n_checks, COUNT(*) FILTER (WHERE result = 'error') AS n_errors FROM check_log GROUP BY 1) l USING (source)
    LEFT JOIN (SELECT source, MIN(month_idx) AS first_idx, MAX(month_idx) AS latest_idx, list(month_idx) AS there FROM releases GROUP BY 1) r USING (source)""", "check_log", "facts", releases=RELEASES))
def rollup(spark, sf):
    """Expected sources: two with gaps, one that was checked and has nothing, one without Januaries, one that was never seen."""
    releases = spark.sql(RELEASES.replace("FROM facts", "FROM {facts}"), facts=frame(spark, sf, "facts"))
    sources = spark.createDataFrame([("view", False), ("click", False), ("signup", False), ("gacc", True), ("never", False)], "source string, january_with_february boolean")
    s = Q.sources_rollup(frame(spark, sf, "check_log"), releases, sources)
    return s.select("source", "last_checked", "last_result", "last_new_data", "n_checks", "n_errors", "latest_idx", F.array_join("gaps", ",").alias("gaps"))


@query("q20_run_histories", duck("""SELECT log, CAST(rank AS INT) AS rank, run_id, result, duration_ms, total FROM (SELECT *, row_number() OVER (PARTITION BY log ORDER BY checked_at DESC, run_id DESC) AS rank FROM (
      SELECT CASE event_id % 3 WHEN 0 THEN 'checks' WHEN 1 THEN 'cycles' ELSE 'drafts' END AS log, CAST(event_id AS BIGINT) AS run_id, checked_at, result, CAST(event_id % 977 AS BIGINT) AS duration_ms,
        CASE WHEN event_id % 3 <> 2 THEN CAST(event_id % 7 + event_id % 5 AS BIGINT) END AS total FROM check_log) a) b WHERE rank <= 20""", "check_log"))
def histories(spark, sf):
    """Three logs: checks and cycles with counts, drafts without."""
    log = frame(spark, sf, "check_log").withColumn("run_id", F.col("event_id").cast("long")).withColumnRenamed("checked_at", "at").withColumn("duration_ms", F.col("run_id") % 977)
    counts = F.create_map(F.lit("inserted"), F.col("run_id") % 7, F.lit("confirmed"), F.col("run_id") % 5)
    of = lambda k: log.where(F.col("run_id") % 3 == k).withColumn("counts", counts if k < 2 else F.lit(None).cast("map<string,bigint>"))
    return Q.run_histories({"checks": of(0), "cycles": of(1), "drafts": of(2)}).select("log", "rank", "run_id", "result", "duration_ms", "total")


@query("r1_summary_ranks", with_series("""SELECT g.group_name, CAST(MAX(rk) FILTER (WHERE flow = 1) AS INT) AS top_movers_rank_imp, CAST(MAX(rk) FILTER (WHERE flow = 2) AS INT) AS top_movers_rank_exp FROM (SELECT DISTINCT group_name FROM group_patterns) g LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY abs(value_yoy) DESC, group_name) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx DESC) AS late FROM yoy) a WHERE late = 1 AND scope = 'eu_27') b WHERE rk <= 3) c USING (group_name) GROUP BY 1"""))
def ranks(spark, sf):
    """The summary sheet's last two columns: ranks among the three largest movers of each flow."""
    y = shared_yoy(spark, sf)
    sheet = K.summary_sheet(y, A.trajectory(y, limits=LIMITS), K.stability_badge(K.stability_pairs(y)), frame(spark, sf, "group_list"))
    return K.with_ranks(sheet, K.movers_section(y, 3)).select("group_name", "top_movers_rank_imp", "top_movers_rank_exp")


OLD = "month_idx < 24000 AND month_idx % 5 = 0 AND round(value_yoy, 6) <> round(value_yoy * 1.1e0, 6)"


@query("r35_cycle_digest", with_series(f"""SELECT 'movement' AS regime, n_shifts, n_turned, n_new, concat_ws(' ', CASE WHEN n_shifts > 0 THEN printf('%d findings moved by more than five points, %d of them to the other side; sharpest: %s.', n_shifts, n_turned, sharpest) END, CASE WHEN n_new > 0 THEN printf('%d findings are new.', n_new) END) AS digest FROM (
    SELECT CAST((SELECT COUNT(*) FROM shifts) AS BIGINT) AS n_shifts, CAST(0 AS BIGINT) AS n_turned, CAST((SELECT COUNT(*) FROM yoy WHERE month_idx >= 24000) AS BIGINT) AS n_new,
      (SELECT string_agg(phrase, '; ' ORDER BY rk) FROM (SELECT *, row_number() OVER (ORDER BY abs(value_yoy * 1.1e0 - value_yoy) DESC, group_name, scope, flow, month_idx) AS rk,
        printf('%s (%s %s) %+.1f%% to %+.1f%%', group_name, scope, CASE WHEN flow = 1 THEN 'imports' ELSE 'exports' END, value_yoy * 100, value_yoy * 1.1e0 * 100) AS phrase FROM shifts) a WHERE rk <= 3) AS sharpest) b""",
    shifts=f"SELECT * FROM yoy WHERE {OLD} AND abs(value_yoy * 1.1e0 - value_yoy) > 0.05"))
def digest(spark, sf):
    """The digest of the ledger's second run."""
    two, ts, every = P._ledger(spark, sf)
    named = [P._findings(every, f).join(every.select(*KEYS, "month_idx", X.nk_hash(F.lit("hs_group_yoy"), *KEYS, "month_idx").alias("nk")), ["nk", "month_idx"]).select("nk", "sig", "value_yoy", *KEYS, "month_idx") for f in (1.0, 1.1)]
    valued = two.join(named[0].unionByName(named[1]).dropDuplicates(["nk", "sig"]), ["nk", "sig"])
    pairs = L.revision_pairs(valued, "value_yoy")
    regime = L.revision_regime(pairs, L.new_since(two, ts(2)))
    return K.cycle_digest(regime, K.significant_shifts(pairs), [*KEYS, "month_idx"])


@query("r10_low_base_wide", with_series("SELECT group_name, scope, flow, month_idx, round(least(value_current, value_prior), 6) AS smaller_window FROM (SELECT *, MAX(month_idx) OVER (PARTITION BY group_name, scope, flow) AS t FROM yoy) a WHERE month_idx = t AND least(value_current, value_prior) < 3e7"))
def low_base_wide(spark, sf):
    """The review sheet under a floor of 30 M."""
    y = yoy_of(spark, sf).withColumn("low_base", X.low_base("value_current", "value_prior", 3e7))
    return K.low_base_review(y).select(*KEYS, "month_idx", r6("smaller_window"))


@query("q4_unexpected_codes", duck("SELECT DISTINCT substr(product_nc, 1, 6) AS code FROM facts WHERE month_idx >= 23942 AND substr(product_nc, 1, 6) NOT IN (SELECT substr(product_nc, 1, 6) FROM facts WHERE month_idx < 23942)", "facts"))
def unexpected_codes(spark, sf):
    """Six-digit codes that come up after the first months."""
    f = frame(spark, sf, "facts").withColumn("code", F.substring("product_nc", 1, 6))
    return Q.unexpected(f.where("month_idx >= 23942"), f.where("month_idx < 23942"), "code")


HEADINGS = {"code_groups": CODE_GROUPS, "codes": CODES.replace("product_nc, month_idx", "substr(product_nc, 1, 4) AS product_nc, month_idx", 1), "movers": MOVERS, "parents": "SELECT DISTINCT substr(product_nc, 1, 4) AS product_nc, group_name FROM code_groups"}


@query("r12_biggest_heading_mover", duck("""SELECT product_nc, round(y0, 6) AS yoy, surfaced, round(score, 6) AS score FROM (
    SELECT m.product_nc, y0, bool_or(g.group_name = 'alpha') AS surfaced, abs(y0) * log10(greatest(c0, 1)) AS score FROM movers m JOIN parents g USING (product_nc) WHERE verdict = 'mover'
    GROUP BY m.product_nc, y0, c0 HAVING bool_or(g.group_name NOT IN ('beta', 'epsilon'))) a ORDER BY surfaced, score DESC, product_nc LIMIT 1""", "facts", "group_patterns", **HEADINGS))
def heading_mover(spark, sf):
    """The card of the biggest mover over headings of four digits, which have rows in most months."""
    facts = frame(spark, sf, "facts")
    codes = facts.where("flow = 1").groupBy(F.substring("product_nc", 1, 4).alias("product_nc"), "month_idx").agg(F.sum("value_eur").cast("double").alias("value"))
    parents = R.group_codes(facts, frame(spark, sf, "group_patterns")).select(F.substring("product_nc", 1, 4).alias("product_nc"), "group_name").distinct()
    return C.biggest_product_mover(A.product_mover(codes, LIMITS), parents, ["beta", "epsilon"], ["alpha"]).select("product_nc", r6("yoy0", "yoy"), "surfaced", r6("score"))
