"""Queries over series building blocks and group YoY, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.fixtures import ENVELOPE, SINGLE_PARTNER, UK, duck, frame
from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import idsets as I
from harborline.operators import relational as R
from harborline.operators import series as S
from harborline.registry import query
from harborline.sources.sinks import kept

LIMITS = A.Limits()
KEYS = A.KEYS
IN_ENV = "partner IN ('N02', 'N07', 'N12', 'N17', 'N22')"
r6 = lambda c, name=None: F.round(X.col(c).cast("double"), 6).alias(name or c)

#: The group series in SQL: scopes, alignment of the combined scope, groups by prefix.
SCOPED = f"""SELECT f.*, s.scope FROM facts f JOIN (VALUES ('uk', 1), ('eu_27', 0), ('eu_27_plus_uk', 1), ('eu_27_plus_uk', 0)) AS s(scope, uk)
    ON s.uk = CASE WHEN f.reporter = '{UK}' THEN 1 ELSE 0 END
  WHERE {IN_ENV} AND product_nc <> '000TOTAL' AND (f.reporter <> '{UK}' OR suppression_index = 0)
    AND (s.scope <> 'eu_27_plus_uk' OR EXISTS (SELECT 1 FROM aligned a WHERE a.flow = f.flow AND a.month_idx = f.month_idx))"""
ALIGNED = f"SELECT flow, month_idx FROM facts GROUP BY flow, month_idx HAVING COUNT(DISTINCT CASE WHEN reporter = '{UK}' THEN 1 ELSE 0 END) = 2"
CODE_GROUPS = "SELECT DISTINCT c.product_nc, g.group_id, g.group_name FROM (SELECT DISTINCT product_nc FROM facts) c JOIN group_patterns g ON starts_with(c.product_nc, g.prefix)"
SERIES = """SELECT group_name, scope, flow, month_idx, CAST(SUM(value_eur) AS DOUBLE) AS value, CAST(COALESCE(SUM(quantity_kg), 0) AS DOUBLE) AS kg,
    CAST(COALESCE(SUM(CASE WHEN quantity_kg > 0 THEN value_eur END), 0) AS DOUBLE) AS value_with_kg, CAST(COUNT(*) AS BIGINT) AS n_rows
  FROM scoped JOIN code_groups USING (product_nc) GROUP BY group_name, scope, flow, month_idx"""
W = "PARTITION BY group_name, scope, flow ORDER BY month_idx RANGE BETWEEN"
PAIRS = f"""SELECT *, SUM(value) OVER ({W} 11 PRECEDING AND CURRENT ROW) AS value_current, COALESCE(SUM(value) OVER ({W} 23 PRECEDING AND 12 PRECEDING), 0) AS value_prior,
    SUM(kg) OVER ({W} 11 PRECEDING AND CURRENT ROW) AS kg_current, COALESCE(SUM(kg) OVER ({W} 23 PRECEDING AND 12 PRECEDING), 0) AS kg_prior,
    SUM(value_with_kg) OVER ({W} 11 PRECEDING AND CURRENT ROW) AS wk_current, COALESCE(SUM(value_with_kg) OVER ({W} 23 PRECEDING AND 12 PRECEDING), 0) AS wk_prior,
    COUNT(*) OVER ({W} 11 PRECEDING AND CURRENT ROW) AS n_current, COUNT(*) OVER ({W} 23 PRECEDING AND 12 PRECEDING) AS n_prior,
    MAX(value) OVER ({W} 12 PRECEDING AND 12 PRECEDING) AS single_prior, SUM(value) OVER ({W} 1 PRECEDING AND CURRENT ROW) AS two_current,
    COALESCE(SUM(value) OVER ({W} 13 PRECEDING AND 12 PRECEDING), 0) AS two_prior FROM series"""
YOY = f"""SELECT *, 24 - n_current - n_prior AS missing, (value_current - value_prior) / abs(value_prior) AS value_yoy,
    CASE WHEN kg_prior <> 0 THEN (kg_current - kg_prior) / abs(kg_prior) END AS kg_yoy,
    least(CASE WHEN value_current = 0 THEN 0 ELSE wk_current / value_current END, wk_prior / value_prior) AS kg_cov,
    least(value_current, value_prior) < {LIMITS.low_base} AS low_base,
    least(value_current, value_prior) > {LIMITS.low_base} / 1.5e0 AND least(value_current, value_prior) < {LIMITS.low_base} * 1.5e0 AS fragile
  FROM pairs WHERE 24 - n_current - n_prior <= 1 AND value_prior <> 0"""
CTES = {"aligned": ALIGNED, "scoped": SCOPED, "code_groups": CODE_GROUPS, "series": SERIES, "pairs": PAIRS, "yoy": YOY}


def with_series(body: str, **more: str) -> str:
    return duck(body, "facts", "group_patterns", **CTES, **more)


def series_of(spark, sf):
    return A.group_series(frame(spark, sf, "facts"), frame(spark, sf, "group_patterns"), ENVELOPE, UK)


def yoy_of(spark, sf):
    return A.group_yoy(series_of(spark, sf), LIMITS)


def shared_yoy(spark, sf):
    """The group changes written once, for queries that read them in several branches."""
    return kept(yoy_of(spark, sf))


@query("a1_monthly_totals", with_series("SELECT group_name, scope, flow, month_idx, round(value, 6) AS value, round(kg, 6) AS kg, round(value_with_kg, 6) AS value_with_kg, n_rows FROM series"))
def a1(spark, sf):
    return series_of(spark, sf).select(*KEYS, "month_idx", r6("value"), r6("kg"), r6("value_with_kg"), "n_rows")


@query(
    "b3_group_yoy",
    with_series("""SELECT group_name, scope, flow, month_idx, round(value_current, 6) AS value_current, round(value_prior, 6) AS value_prior, round(value_yoy, 6) AS value_yoy,
        round(kg_yoy, 6) AS kg_yoy, round(kg_cov, 6) AS kg_cov, low_base, fragile, CAST(missing AS BIGINT) AS missing, missing > 0 AS partial_window,
        round(CASE WHEN single_prior <> 0 THEN (value - single_prior) / abs(single_prior) END, 6) AS single_yoy, round(CASE WHEN two_prior <> 0 THEN (two_current - two_prior) / abs(two_prior) END, 6) AS two_yoy,
        round(CASE WHEN kg_cov >= 0.8 AND kg_current > 0 THEN wk_current / kg_current END, 6) AS price_current, round(CASE WHEN kg_cov >= 0.8 AND kg_prior > 0 THEN wk_prior / kg_prior END, 6) AS price_prior,
        CASE WHEN kg_yoy IS NULL OR value_yoy = 0 THEN NULL WHEN abs(kg_yoy / value_yoy) > 0.5 THEN 'volume' ELSE 'price' END AS driver,
        concat_ws(',', CASE WHEN scope = 'eu_27_plus_uk' THEN 'cross_source_sum' END, CASE WHEN low_base THEN 'low_base_effect' END, CASE WHEN kg_cov < 0.8 THEN 'low_kg_coverage' END, CASE WHEN missing > 0 THEN 'partial_window' END) AS caveats
      FROM yoy"""),
)
def b3(spark, sf):
    y = yoy_of(spark, sf)
    return y.select(
        *KEYS, "month_idx", *(r6(c) for c in ("value_current", "value_prior", "value_yoy", "kg_yoy", "kg_cov")), "low_base", "fragile", F.col("missing").cast("long").alias("missing"), "partial_window",
        *(r6(c) for c in ("single_yoy", "two_yoy", "price_current", "price_prior")), "driver", F.array_join(A.yoy_caveats(y, LIMITS), ",").alias("caveats"),
    )


@query("w3_missing_months", with_series("""SELECT s.group_name, s.scope, s.flow, s.month_idx, CAST(COUNT(*) FILTER (WHERE t.month_idx IS NULL) AS BIGINT) AS n_missing
    FROM series s CROSS JOIN range(0, 24) r(k) LEFT JOIN series t ON t.group_name = s.group_name AND t.scope = s.scope AND t.flow = s.flow AND t.month_idx = s.month_idx - r.k
    GROUP BY s.group_name, s.scope, s.flow, s.month_idx"""))
def w3(spark, sf):
    return series_of(spark, sf).select(*KEYS, "month_idx", F.size(S.missing_months(KEYS, -23, 0)).cast("long").alias("n_missing"))


@query("w8_ytd_computed", with_series("""SELECT group_name, scope, flow, month_idx, round(ytd, 6) AS ytd, round(CASE WHEN p <> 0 THEN (ytd - p) / abs(p) END, 6) AS ytd_yoy FROM (
    SELECT *, MAX(ytd) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS p FROM (
      SELECT *, CASE WHEN COUNT(*) OVER w = month_idx % 12 + 1 THEN SUM(value) OVER w END AS ytd FROM series
      WINDOW w AS (PARTITION BY group_name, scope, flow, month_idx // 12 ORDER BY month_idx)) a) b"""))
def w8(spark, sf):
    return S.ytd_computed(series_of(spark, sf), KEYS).select(*KEYS, "month_idx", r6("ytd"), r6("ytd_yoy"))


@query("w16_series_gaps", with_series("""SELECT group_name, scope, flow, MIN(month_idx) AS first, MAX(month_idx) AS last, CAST(MAX(month_idx) - MIN(month_idx) + 1 - COUNT(*) AS BIGINT) AS n_missing FROM series GROUP BY group_name, scope, flow"""))
def w16(spark, sf):
    return S.series_gaps(series_of(spark, sf), KEYS).select(*KEYS, "first", "last", F.col("n_missing").cast("long").alias("n_missing"))


RUN = """SELECT * EXCLUDE (island, n, f, best) FROM (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY n DESC, f, month_idx) AS best,
      FIRST_VALUE(island) OVER (PARTITION BY group_name, scope, flow ORDER BY n DESC, f) AS top FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY group_name, scope, flow, island) AS n, MIN(month_idx) OVER (PARTITION BY group_name, scope, flow, island) AS f FROM (
      SELECT *, month_idx - row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx) AS island FROM yoy) a) b) c WHERE island = top"""


@query("w17_longest_run", with_series("SELECT group_name, scope, flow, MIN(month_idx) AS first_idx, CAST(COUNT(*) AS BIGINT) AS n FROM run GROUP BY group_name, scope, flow", run=RUN))
def w17(spark, sf):
    return S.longest_run(yoy_of(spark, sf), KEYS).groupBy(*KEYS).agg(F.min("month_idx").alias("first_idx"), F.count("*").alias("n"))


@query("w18_smooth_centred", with_series("SELECT group_name, scope, flow, month_idx, round(AVG(value_yoy) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM yoy"))
def w18(spark, sf):
    return S.smooth_centred(yoy_of(spark, sf), KEYS, "value_yoy").select(*KEYS, "month_idx", r6("smooth"))


@query("w19_sign_runs", with_series("""SELECT group_name, scope, flow, CAST(COALESCE(SUM(turn), 0) AS BIGINT) AS sign_changes, CAST(arg_max(s, month_idx) AS INT) AS last_sign, CAST(arg_min(s, month_idx) AS INT) AS first_sign FROM (
    SELECT *, CASE WHEN lag(s) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx) <> s THEN 1 WHEN lag(s) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx) = s THEN 0 END AS turn
      FROM (SELECT *, sign(value_yoy) AS s FROM yoy WHERE value_yoy <> 0) a) b GROUP BY group_name, scope, flow"""))
def w19(spark, sf):
    return S.sign_runs(yoy_of(spark, sf), KEYS, "value_yoy").select(*KEYS, F.col("sign_changes").cast("long").alias("sign_changes"), "last_sign", "first_sign")


@query("w20_theil_sen", with_series("""SELECT group_name, scope, flow, round(median((b_v - a_v) / (b_i - a_i)), 6) AS slope FROM (
    SELECT a.group_name, a.scope, a.flow, a.value_yoy AS a_v, b.value_yoy AS b_v, a.i AS a_i, b.i AS b_i
      FROM (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx) AS i FROM yoy) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx) AS i FROM yoy) b
        ON a.group_name = b.group_name AND a.scope = b.scope AND a.flow = b.flow AND b.i > a.i) p GROUP BY group_name, scope, flow"""))
def w20(spark, sf):
    return S.theil_sen(yoy_of(spark, sf), KEYS, "value_yoy").select(*KEYS, r6("slope"))


#: The points of each longest run with their place, the run's length and the centred mean of three; slopes of any column of them.
PTS = """SELECT group_name, scope, flow, month_idx, value_yoy AS v, low_base, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx) AS i, COUNT(*) OVER (PARTITION BY group_name, scope, flow) AS n,
    AVG(value_yoy) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM {source}"""
SLOPE = "SELECT a.group_name, a.scope, a.flow, median((b.{c} - a.{c}) / (b.i - a.i)) AS slope FROM {pts} a JOIN {pts} b ON a.group_name = b.group_name AND a.scope = b.scope AND a.flow = b.flow AND b.i > a.i {where} GROUP BY 1, 2, 3"
AUTO = {
    "lines": SLOPE.format(c="v", pts="pts", where=""),
    "rest": "SELECT p.*, p.v - COALESCE(l.slope, 0) * (p.i - 1) AS r FROM pts p LEFT JOIN lines l USING (group_name, scope, flow)",
    "auto": """SELECT a.group_name, a.scope, a.flow, CASE WHEN var_pop(a.r) > 1e-14 AND var_pop(b.r) > 1e-14 THEN corr(a.r, b.r) END AS autocorr FROM rest a JOIN rest b
      ON a.group_name = b.group_name AND a.scope = b.scope AND a.flow = b.flow AND b.i = a.i + 12 WHERE a.n >= 14 GROUP BY 1, 2, 3""",
}


@query("w21_seasonal_autocorr", with_series("SELECT k.group_name, k.scope, k.flow, round(a.autocorr, 6) AS autocorr FROM (SELECT DISTINCT group_name, scope, flow FROM pts) k LEFT JOIN auto a USING (group_name, scope, flow)", pts=PTS.format(source="yoy"), **AUTO))
def w21(spark, sf):
    return S.seasonal_autocorr(yoy_of(spark, sf), KEYS, "value_yoy").select(*KEYS, r6("autocorr"))


@query("w23_series_as_of", with_series("SELECT group_name, scope, flow, month_idx, CAST(COUNT(*) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_points, round(FIRST_VALUE(value) OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS oldest FROM series"))
def w23(spark, sf):
    s = series_of(spark, sf).withColumn("p", S.series_as_of(KEYS, "value"))
    return s.select(*KEYS, "month_idx", F.size("p").cast("long").alias("n_points"), r6(F.get("p", F.lit(0))["value"], "oldest"))


@query("b3r_reporter_breakdown", with_series(f"""SELECT group_name, scope, flow, month_idx, reporter, round(c, 6) AS part_current, round(p, 6) AS part_prior, round(c - p, 6) AS delta, round(CASE WHEN p <> 0 THEN (c - p) / abs(p) END, 6) AS part_yoy,
      round(CASE WHEN gd <> 0 THEN (c - p) / gd END, 6) AS share, p < {LIMITS.reporter_low_base} AS low_base, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow, month_idx ORDER BY abs(c - p) DESC, reporter) AS rank FROM (
      SELECT y.group_name, y.scope, y.flow, y.month_idx, m.reporter, y.value_current - y.value_prior AS gd,
             CAST(COALESCE(SUM(CASE WHEN y.month_idx - m.month_idx < 12 THEN m.v END), 0) AS DOUBLE) AS c, CAST(COALESCE(SUM(CASE WHEN y.month_idx - m.month_idx >= 12 THEN m.v END), 0) AS DOUBLE) AS p
        FROM yoy y JOIN parts m ON m.group_name = y.group_name AND m.scope = y.scope AND m.flow = y.flow AND m.month_idx BETWEEN y.month_idx - 23 AND y.month_idx
       GROUP BY y.group_name, y.scope, y.flow, y.month_idx, m.reporter, y.value_current - y.value_prior) a) b WHERE rank <= 10""",
    parts="SELECT group_name, scope, flow, reporter, month_idx, SUM(value_eur) AS v FROM scoped JOIN code_groups USING (product_nc) GROUP BY group_name, scope, flow, reporter, month_idx"))
def b3r(spark, sf):
    facts, patterns = frame(spark, sf, "facts"), frame(spark, sf, "group_patterns")
    b = A.reporter_breakdown(yoy_of(spark, sf), facts, patterns, ENVELOPE, UK, limits=LIMITS)
    return b.select(*KEYS, "month_idx", "reporter", *(r6(c) for c in ("part_current", "part_prior", "delta", "part_yoy", "share")), "low_base", "rank")


@query("b3c_top_products", with_series("""SELECT group_name, scope, flow, month_idx, product_nc, round(c, 6) AS part_current, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow, month_idx ORDER BY c DESC, product_nc) AS rank FROM (
      SELECT y.group_name, y.scope, y.flow, y.month_idx, m.product_nc, CAST(SUM(m.v) AS DOUBLE) AS c
        FROM yoy y JOIN parts m ON m.group_name = y.group_name AND m.scope = y.scope AND m.flow = y.flow AND m.month_idx BETWEEN y.month_idx - 11 AND y.month_idx
       GROUP BY y.group_name, y.scope, y.flow, y.month_idx, m.product_nc) a WHERE c > 0) b WHERE rank <= 10""",
    parts="SELECT group_name, scope, flow, product_nc, month_idx, SUM(value_eur) AS v FROM scoped JOIN code_groups USING (product_nc) GROUP BY group_name, scope, flow, product_nc, month_idx"))
def b3c(spark, sf):
    p = A.top_products(yoy_of(spark, sf), frame(spark, sf, "facts"), frame(spark, sf, "group_patterns"), ENVELOPE, UK)
    return p.select(*KEYS, "month_idx", "product_nc", r6("part_current"), "rank")


@query("b5_trajectory", with_series("""SELECT group_name, scope, flow, CAST(COUNT(*) AS BIGINT) AS n_windows, round(arg_min(value_yoy, month_idx), 6) AS first_yoy, round(arg_max(value_yoy, month_idx), 6) AS last_yoy,
      round(MAX(value_yoy), 6) AS max_yoy, round(MIN(value_yoy), 6) AS min_yoy, round(AVG(value_yoy), 6) AS mean_yoy, round(stddev_pop(value_yoy), 6) AS std_yoy, 2 * SUM(CASE WHEN low_base THEN 1 ELSE 0 END) >= COUNT(*) AS low_base_majority
    FROM run GROUP BY group_name, scope, flow""", run=RUN))
def b5(spark, sf):
    t = A.trajectory(yoy_of(spark, sf), limits=LIMITS)
    return t.select(*KEYS, "n_windows", *(r6(c) for c in ("first_yoy", "last_yoy", "max_yoy", "min_yoy", "mean_yoy", "std_yoy")), "low_base_majority")


SHAPED = {
    "pts": PTS.format(source="run"), **AUTO, "slope_all": SLOPE.format(c="s", pts="pts", where=""), "slope_early": SLOPE.format(c="s", pts="pts", where="AND b.i <= a.n // 2"),
    "slope_late": SLOPE.format(c="s", pts="pts", where="AND a.i > a.n // 2"),
    "turns": """SELECT group_name, scope, flow, CAST(SUM(CASE WHEN g <> b THEN 1 ELSE 0 END) AS INT) AS sign_changes, arg_max(g, i) AS last_sign FROM (
      SELECT *, lag(g) OVER (PARTITION BY group_name, scope, flow ORDER BY i) AS b FROM (SELECT *, sign(s) AS g FROM pts WHERE s <> 0) a) b GROUP BY 1, 2, 3""",
    "crossed": "SELECT group_name, scope, flow, MIN(i) - 1 AS at FROM (SELECT *, sign(s) * lag(sign(s)) OVER (PARTITION BY group_name, scope, flow ORDER BY i) AS g FROM pts) a WHERE g = -1 GROUP BY 1, 2, 3",
    "shaped": """SELECT f.group_name, f.scope, f.flow, f.n, COALESCE(t.sign_changes, 0) AS sign_changes, COALESCE(a.slope, 0) AS slope, COALESCE(e.slope, 0) AS early_slope, COALESCE(l.slope, 0) AS late_slope, f.peak_idx, f.trough_idx,
        CASE WHEN COALESCE(t.sign_changes, 0) = 1 THEN c.at END AS cross_zero_idx, u.autocorr, COALESCE(u.autocorr >= 0.5, FALSE) AS seasonal,
        CASE WHEN f.n < 6 THEN 'insufficient_data' WHEN f.mean_abs < 0.02 AND f.std < 0.05 THEN 'flat'
          WHEN t.sign_changes = 2 THEN CASE WHEN t.last_sign > 0 THEN 'dip_recovery' ELSE 'failed_recovery' END WHEN t.sign_changes >= 3 THEN 'volatile'
          WHEN t.sign_changes = 1 THEN CASE WHEN f.last_s > 0 THEN 'u_recovery' ELSE 'inverse_u_peak' END
          WHEN f.last_s > 0 THEN CASE WHEN COALESCE(a.slope, 0) > 0.005 THEN 'rising_accelerating' WHEN COALESCE(a.slope, 0) < -0.005 THEN 'rising_decelerating' ELSE 'rising' END
          WHEN COALESCE(a.slope, 0) < -0.005 THEN 'falling_accelerating' WHEN COALESCE(a.slope, 0) > 0.005 THEN 'falling_decelerating' ELSE 'falling' END AS shape
      FROM (SELECT group_name, scope, flow, COUNT(*) AS n, AVG(abs(v)) AS mean_abs, stddev_pop(v) AS std, arg_max(s, i) AS last_s, arg_max(month_idx, (v, -month_idx)) AS peak_idx, arg_min(month_idx, (v, month_idx)) AS trough_idx FROM pts GROUP BY 1, 2, 3) f
      LEFT JOIN turns t USING (group_name, scope, flow) LEFT JOIN slope_all a USING (group_name, scope, flow) LEFT JOIN slope_early e USING (group_name, scope, flow)
      LEFT JOIN slope_late l USING (group_name, scope, flow) LEFT JOIN crossed c USING (group_name, scope, flow) LEFT JOIN auto u USING (group_name, scope, flow)""",
}


def shapes(body: str, **more: str) -> str:
    return with_series(body, run=RUN, **SHAPED, **more)


@query("b5_shapes", shapes("""SELECT group_name, scope, flow, shape, sign_changes, round(slope, 6) AS slope, round(early_slope, 6) AS early_slope, round(late_slope, 6) AS late_slope, peak_idx, trough_idx,
    CAST(cross_zero_idx AS INT) AS cross_zero_idx, round(autocorr, 6) AS seasonal_strength, seasonal FROM shaped"""))
def b5_shapes(spark, sf):
    t = A.trajectory(yoy_of(spark, sf), limits=LIMITS)
    return t.select(*KEYS, "shape", "sign_changes", r6("slope"), r6("early_slope"), r6("late_slope"), "peak_idx", "trough_idx", "cross_zero_idx", r6("seasonal_strength"), "seasonal")


@query("u2_aligned_months", duck("SELECT flow, month_idx FROM aligned", "facts", aligned=ALIGNED))
def u2(spark, sf):
    f = frame(spark, sf, "facts")
    return R.aligned_months(f.where(F.col("reporter") != UK), f.where(F.col("reporter") == UK))


@query("f2_assign_groups", duck("SELECT group_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT product_nc) AS BIGINT) AS n_codes, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value FROM facts JOIN code_groups USING (product_nc) GROUP BY group_name", "facts", "group_patterns", code_groups=CODE_GROUPS))
def f2(spark, sf):
    g = R.assign_groups(frame(spark, sf, "facts"), frame(spark, sf, "group_patterns"))
    return g.groupBy("group_name").agg(F.count("*").alias("n_rows"), F.count_distinct("product_nc").alias("n_codes"), r6(F.sum("value_eur"), "value"))


@query("f_predicates", duck(f"""SELECT CAST(COUNT(*) FILTER (WHERE starts_with(product_nc, '11') OR starts_with(product_nc, '1301')) AS BIGINT) AS f1, CAST(COUNT(*) FILTER (WHERE {IN_ENV}) AS BIGINT) AS f3,
    CAST(COUNT(*) FILTER (WHERE reporter NOT IN ('{UK}')) AS BIGINT) AS f4, CAST(COUNT(*) FILTER (WHERE suppression_index = 0) AS BIGINT) AS f5, CAST(COUNT(*) FILTER (WHERE regexp_full_match(product_nc, '[0-9]{{8}}')) AS BIGINT) AS f6,
    CAST(COUNT(*) FILTER (WHERE month_idx BETWEEN 23950 AND 23970 AND flow = 1) AS BIGINT) AS f8 FROM facts""", "facts"))
def f_predicates(spark, sf):
    n = lambda c: F.count_if(c)
    return frame(spark, sf, "facts").agg(
        n(X.starts_with_any("product_nc", ["11%", "1301%"])).alias("f1"), n(X.in_envelope("partner", ENVELOPE)).alias("f3"), n(~F.col("reporter").isin(UK)).alias("f4"),
        n(F.col("suppression_index") == 0).alias("f5"), n(X.is_detail_code("product_nc")).alias("f6"), n(F.col("month_idx").between(23950, 23970) & (F.col("flow") == 1)).alias("f8"),
    )


@query("w1_w9_months", duck("SELECT DISTINCT month_idx, period AS start, CAST(datediff('day', period, last_day(period)) + 1 AS INT) AS days, CAST(datediff('day', CAST(period - INTERVAL 11 MONTH AS DATE), last_day(period)) + 1 AS INT) AS days12 FROM facts", "facts"))
def w1(spark, sf):
    m = frame(spark, sf, "facts").select(X.month_idx("period").alias("month_idx")).distinct()
    return m.select("month_idx", X.month_start("month_idx").alias("start"), X.days_in_window("month_idx", "month_idx").alias("days"), X.days_in_window(F.col("month_idx") - 11, "month_idx").alias("days12"))


MOVERS = f"""SELECT *, CASE
      WHEN p0 <= 0 OR least(c0, p0) < {LIMITS.mover_floor} THEN 'floor' WHEN abs(y0) < 0.25 THEN 'small_change' WHEN nc < 10 OR np < 10 THEN 'few_months'
      WHEN NOT (COALESCE(abs(y0) >= 0.1, FALSE) AND COALESCE(sign(y1) = sign(y0) AND abs(y1) >= 0.1, FALSE) AND COALESCE(sign(y2) = sign(y0) AND abs(y2) >= 0.1, FALSE)) THEN 'unsteady'
      WHEN NOT COALESCE(sign(lo) = sign(y0) AND abs(lo) >= 0.15, FALSE) THEN 'one_month' ELSE 'mover' END AS verdict FROM (SELECT *, CASE WHEN p0 > 0 THEN (c0 - p0) / p0 END AS y0, CASE WHEN p1 > 0 THEN (c1 - p1) / p1 END AS y1, CASE WHEN p2 > 0 THEN (c2 - p2) / p2 END AS y2,
        CASE WHEN p0 > 0 AND (c0 - p0) / p0 > 0 THEN (c0 - pc - p0) / p0 WHEN p0 - pp > 0 THEN (c0 - (p0 - pp)) / (p0 - pp) END AS lo FROM (
        SELECT product_nc, {", ".join(f"COALESCE(SUM(value) FILTER (WHERE back BETWEEN {a} AND {a + 11}), 0) AS c{a}, COALESCE(SUM(value) FILTER (WHERE back BETWEEN {a + 12} AND {a + 23}), 0) AS p{a}" for a in range(3))},
          COUNT(*) FILTER (WHERE back BETWEEN 0 AND 11) AS nc, COUNT(*) FILTER (WHERE back BETWEEN 12 AND 23) AS np, COALESCE(MAX(value) FILTER (WHERE back BETWEEN 0 AND 11), 0) AS pc, COALESCE(MAX(value) FILTER (WHERE back BETWEEN 12 AND 23), 0) AS pp
        FROM (SELECT *, (SELECT MAX(month_idx) FROM codes) - month_idx AS back FROM codes) a WHERE back < 26 GROUP BY product_nc) b) c"""
CODES = "SELECT product_nc, month_idx, CAST(SUM(value_eur) AS DOUBLE) AS value FROM facts WHERE flow = 1 GROUP BY 1, 2"
MOVER_CTES = {"code_groups": CODE_GROUPS, "codes": CODES, "movers": MOVERS}


@query("b4_product_mover", duck("""SELECT m.product_nc, round(c0, 6) AS current, round(p0, 6) AS prior, round(y0, 6) AS yoy, verdict, COALESCE(g.parents, '') AS parents FROM movers m
    LEFT JOIN (SELECT product_nc, string_agg(group_name, ',' ORDER BY group_name) AS parents FROM code_groups GROUP BY 1) g USING (product_nc)""", "facts", "group_patterns", **MOVER_CTES))
def b4(spark, sf):
    movers = movers_of(spark, sf)
    parents = R.group_codes(movers, frame(spark, sf, "group_patterns")).groupBy("product_nc").agg(F.array_join(F.array_sort(F.collect_set("group_name")), ",").alias("parents"))
    named = movers.join(parents, "product_nc", "left")
    return named.select("product_nc", r6("c0", "current"), r6("p0", "prior"), r6("yoy0", "yoy"), "verdict", F.coalesce("parents", F.lit("")).alias("parents"))


def movers_of(spark, sf):
    codes = frame(spark, sf, "facts").where("flow = 1").groupBy("product_nc", "month_idx").agg(F.sum("value_eur").cast("double").alias("value"))
    return A.product_mover(codes, LIMITS)


ALL_GOODS = f"CASE WHEN reporter = '{UK}' THEN product_nc <> '000TOTAL' AND suppression_index = 0 ELSE product_nc = '000TOTAL' END"


B_KEYS = "PARTITION BY reporter_scope, partner_scope ORDER BY month_idx RANGE BETWEEN"
BAL = f"""SELECT r.reporter_scope, p.partner_scope, month_idx, CAST(SUM(value_eur) FILTER (WHERE flow = 1) AS DOUBLE) AS i, CAST(SUM(value_eur) FILTER (WHERE flow = 2) AS DOUBLE) AS e
      FROM facts_full f JOIN (VALUES ('uk', 1), ('eu_27', 0), ('eu_27_plus_uk', 1), ('eu_27_plus_uk', 0)) AS r(reporter_scope, uk) ON r.uk = CASE WHEN f.reporter = '{UK}' THEN 1 ELSE 0 END
      JOIN (VALUES ('envelope', 0), ('single', 1)) AS p(partner_scope, one) ON p.one = 0 OR f.partner = '{SINGLE_PARTNER}'
     WHERE {IN_ENV} AND {ALL_GOODS} GROUP BY 1, 2, 3
    HAVING COUNT(DISTINCT r.uk) FILTER (WHERE flow = 1) >= CASE r.reporter_scope WHEN 'eu_27_plus_uk' THEN 2 ELSE 1 END AND COUNT(DISTINCT r.uk) FILTER (WHERE flow = 2) >= CASE r.reporter_scope WHEN 'eu_27_plus_uk' THEN 2 ELSE 1 END"""
B7 = """SELECT reporter_scope, partner_scope, month_idx, round(c, 6) AS balance_current, round(CASE WHEN np = 12 AND p <> 0 THEN (c - p) / abs(p) END, 6) AS balance_yoy, round(ci, 6) AS imports_current, round(i - e, 6) AS balance,
      round(ytd, 6) AS ytd, round(CASE WHEN yp <> 0 THEN (ytd - yp) / abs(yp) END, 6) AS ytd_yoy,
      round(c / (datediff('day', make_date(CAST((month_idx - 11) // 12 AS INT), CAST((month_idx - 11) % 12 + 1 AS INT), 1), last_day(make_date(CAST(month_idx // 12 AS INT), CAST(month_idx % 12 + 1 AS INT), 1))) + 1), 6) AS per_day FROM (
    SELECT *, MAX(ytd) OVER (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS yp FROM (
      SELECT *, SUM(i - e) OVER w AS c, SUM(i) OVER w AS ci, COUNT(*) OVER w AS nc, SUM(i - e) OVER w2 AS p, COUNT(*) OVER w2 AS np, CASE WHEN COUNT(*) OVER wy = month_idx % 12 + 1 THEN SUM(i - e) OVER wy END AS ytd FROM bal
      WINDOW w AS (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx RANGE BETWEEN 23 PRECEDING AND 12 PRECEDING),
        wy AS (PARTITION BY reporter_scope, partner_scope, month_idx // 12 ORDER BY month_idx)) a) b WHERE nc = 12"""


@query("b7_trade_balance", duck(B7, "facts_full", bal=BAL))
def b7(spark, sf):
    return balance_of(spark, sf).select("reporter_scope", "partner_scope", "month_idx", *(r6(c) for c in ("balance_current", "balance_yoy", "imports_current", "balance", "ytd", "ytd_yoy", "per_day")))


def balance_of(spark, sf):
    return A.trade_balance(A.balance_series(frame(spark, sf, "facts_full"), ENVELOPE, SINGLE_PARTNER, UK))


MEMBERS = [f"N{n:02d}" for r in (0, 1) for n in range(r, 25, 5)]


IN_MEMBERS = f"partner IN ({', '.join(repr(m) for m in MEMBERS)})"


@query("a4_external_totals", duck(f"SELECT reporter, product_nc, flow, month_idx, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value, CAST(COUNT(DISTINCT partner) AS BIGINT) AS n_partners, CAST(COUNT(*) AS BIGINT) AS n_rows FROM facts_full WHERE NOT {IN_MEMBERS} GROUP BY 1, 2, 3, 4", "facts_full"))
def a4(spark, sf):
    return A.external_totals(frame(spark, sf, "facts_full"), MEMBERS, ["reporter", "product_nc", "flow", "month_idx"]).select("reporter", "product_nc", "flow", "month_idx", r6("value"), "n_partners", "n_rows")


@query("a5_a6_allgoods", duck(f"SELECT reporter = '{UK}' AS from_detail, flow, month_idx, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value, CAST(COUNT(*) AS BIGINT) AS n_ids, MIN(raw_id) AS first_id FROM facts_full WHERE {IN_ENV} AND {ALL_GOODS} GROUP BY 1, 2, 3", "facts_full"))
def a5(spark, sf):
    f = frame(spark, sf, "facts_full").where(X.in_envelope("partner", ENVELOPE))
    both = A.allgoods_from_total_row(f, UK, ["flow"]).withColumn("from_detail", F.lit(False)).unionByName(A.allgoods_from_detail(f, UK, ["flow"]).withColumn("from_detail", F.lit(True)))
    at = ["from_detail", "flow", "month_idx"]
    behind = I.set_sizes(A.allgoods_lineage(f, UK, ["flow"]), at)
    return both.join(behind, at).select(*at, r6("value"), "n_ids", "first_id")


@query("a7_allgoods_external", duck(f"SELECT flow, month_idx, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value FROM facts_full WHERE NOT {IN_MEMBERS} AND reporter <> '{UK}' AND product_nc = '000TOTAL' GROUP BY 1, 2", "facts_full"))
def a7(spark, sf):
    rows = A.all_goods(frame(spark, sf, "facts_full").where(F.col("reporter") != UK), UK)
    return A.external_totals(rows, MEMBERS, ["flow", "month_idx"]).select("flow", "month_idx", r6("value"))


#: The first month of the all-goods shares.
FIRST_SHARE = 1996 * 12


@query("b8_allgoods_share", duck(f"""SELECT flow, month_idx, round(s, 6) AS value_share, round(o, 6) AS single_share, CAST(COUNT(*) OVER (PARTITION BY flow ORDER BY month_idx) AS BIGINT) AS n_points FROM (
    SELECT flow, month_idx, env, CASE WHEN COUNT(env) OVER w = 12 AND COUNT(den) OVER w = 12 AND SUM(den) OVER w > 0 THEN SUM(env) OVER w / SUM(den) OVER w END AS s, CASE WHEN COUNT(one) OVER w = 12 THEN SUM(one) OVER w / SUM(den) OVER w END AS o FROM sums
    WINDOW w AS (PARTITION BY flow ORDER BY month_idx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) a WHERE s IS NOT NULL AND env IS NOT NULL AND month_idx >= {FIRST_SHARE}""", "facts_full",
    sums=f"SELECT flow, month_idx, CAST(SUM(value_eur) FILTER (WHERE {IN_ENV}) AS DOUBLE) AS env, CAST(SUM(value_eur) FILTER (WHERE partner = '{SINGLE_PARTNER}') AS DOUBLE) AS one, CAST(SUM(value_eur) FILTER (WHERE NOT {IN_MEMBERS}) AS DOUBLE) AS den FROM facts_full WHERE reporter <> '{UK}' AND product_nc = '000TOTAL' GROUP BY 1, 2"))
def b8(spark, sf):
    s = allgoods_of(spark, sf)
    return s.select("flow", "month_idx", r6("value_share"), r6("single_share"), F.size("points").cast("long").alias("n_points"))


def allgoods_of(spark, sf):
    return A.allgoods_share(frame(spark, sf, "facts_full"), MEMBERS, ENVELOPE, SINGLE_PARTNER, UK, FIRST_SHARE)


def shares_of(spark, sf):
    """Each group's imports of the sources with total rows: the envelope's part in those from outside the bloc."""
    rows = frame(spark, sf, "facts").where((F.col("flow") == 1) & (F.col("reporter") != UK))
    codes = rows.groupBy("product_nc", "partner", "month_idx").agg(F.sum("value_eur").alias("value_eur"), F.sum("quantity_kg").alias("quantity_kg"))
    grouped = R.assign_groups(codes, frame(spark, sf, "group_patterns"))
    num = S.monthly_totals(grouped.where(X.in_envelope("partner", ENVELOPE)), ["group_name"])
    den = S.monthly_totals(grouped.where(~F.col("partner").isin(*MEMBERS)), ["group_name"])
    return A.share_of(num, den, ["group_name"], ["group_name"])


SHARE = """SELECT group_name, month_idx, round(v / dv, 6) AS value_share, round(k / dk, 6) AS kg_share, round((k / dk - v / dv) * 100, 6) AS difference_pp, round(abs((k / dk - v / dv) * 100) + 100 * (v / dv), 6) AS score FROM (
    SELECT group_name, n.month_idx, SUM(n.value) OVER w AS v, SUM(d.value) OVER w AS dv, SUM(n.kg) OVER w AS k, SUM(d.kg) OVER w AS dk, COUNT(*) OVER w AS c FROM num n JOIN den d USING (group_name, month_idx)
    WINDOW w AS (PARTITION BY group_name ORDER BY n.month_idx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) a WHERE c = 12 AND dv <> 0 AND dk <> 0"""
SIDE = "SELECT group_name, month_idx, CAST(SUM(value_eur) AS DOUBLE) AS value, CAST(COALESCE(SUM(quantity_kg), 0) AS DOUBLE) AS kg FROM facts JOIN code_groups USING (product_nc) WHERE flow = 1 AND reporter <> '" + UK + "' AND {} GROUP BY group_name, month_idx"


@query("b9_group_share", duck(SHARE, "facts", "group_patterns", code_groups=CODE_GROUPS, num=SIDE.format(IN_ENV), den=SIDE.format(f"NOT {IN_MEMBERS}")))
def b9(spark, sf):
    return shares_of(spark, sf).select("group_name", "month_idx", *(r6(c) for c in ("value_share", "kg_share", "difference_pp", "score")))


@query("b14_trade_map", duck("""SELECT COALESCE(d.division, 'unclassified') AS division, round(CAST(SUM(c.v) AS DOUBLE), 6) AS value, round(CAST(SUM(c.v) AS DOUBLE) / (SELECT CAST(SUM(value_eur) AS DOUBLE) FROM facts WHERE flow = 1), 6) AS share,
    round(CAST(COALESCE(SUM(c.v) FILTER (WHERE c.product_nc IN (SELECT product_nc FROM code_groups)), 0) AS DOUBLE) / CAST(SUM(c.v) AS DOUBLE), 6) AS covered_share, CAST(COUNT(*) AS BIGINT) AS n_codes
  FROM (SELECT product_nc, SUM(value_eur) AS v FROM facts WHERE flow = 1 GROUP BY product_nc) c LEFT JOIN divs d USING (product_nc) GROUP BY 1""", "facts", "group_patterns", code_groups=CODE_GROUPS,
    divs="SELECT DISTINCT product_nc, 'div' || substr(product_nc, 2, 1) AS division FROM facts WHERE substr(product_nc, 4, 1) <> '9'"))
def b14(spark, sf):
    facts = frame(spark, sf, "facts").where("flow = 1")
    codes = facts.groupBy("product_nc").agg(F.sum("value_eur").cast("double").alias("value"))
    divisions = codes.where(F.substring("product_nc", 4, 1) != "9").select("product_nc", F.concat(F.lit("div"), F.substring("product_nc", 2, 1)).alias("division"))
    grouped = R.group_codes(codes, frame(spark, sf, "group_patterns")).select("product_nc")
    m = A.trade_map(codes, divisions, grouped)
    return m.select("division", r6("value"), r6("share"), r6("covered_share"), "n_codes")


@query("b16_theme_rollup", duck("SELECT theme, round(CAST(SUM(v) AS DOUBLE), 6) AS value FROM (SELECT product_nc, SUM(value_eur) AS v FROM facts GROUP BY product_nc) c JOIN (SELECT DISTINCT p.product_nc, t.theme FROM (SELECT DISTINCT product_nc FROM facts) p JOIN (VALUES ('metal', '11'), ('metal', '12'), ('green', '12'), ('green', '1402')) AS t(theme, prefix) ON starts_with(p.product_nc, t.prefix)) x USING (product_nc) GROUP BY theme", "facts"))
def b16(spark, sf):
    themes = spark.createDataFrame([("metal", "11"), ("metal", "12"), ("green", "12"), ("green", "1402")], "theme string, prefix string")
    codes = frame(spark, sf, "facts").groupBy("product_nc").agg(F.sum("value_eur").alias("value"))
    return A.theme_rollup(codes, themes).select("theme", r6("value"))


@query("b17_chart_series", with_series("""SELECT a.group_name, a.scope, a.flow, a.anchor - r.k AS month_idx, round(s.value, 6) AS value, CASE WHEN r.k < 12 THEN 'current' ELSE 'prior' END AS half
    FROM (SELECT group_name, scope, flow, MAX(month_idx) AS anchor FROM series GROUP BY 1, 2, 3) a CROSS JOIN (SELECT CAST(k AS INT) AS k FROM range(0, 24) t(k)) r
    LEFT JOIN series s ON s.group_name = a.group_name AND s.scope = a.scope AND s.flow = a.flow AND s.month_idx = a.anchor - r.k"""))
def b17(spark, sf):
    s = series_of(spark, sf)
    c = A.chart_series(s, KEYS, s.groupBy(*KEYS).agg(F.max("month_idx").alias("anchor")))
    return c.select(*KEYS, "month_idx", r6("value"), "half")
