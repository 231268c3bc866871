"""Queries over mirror gaps, blocs, the ledger, report tables, quality checks, texts and sources, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from harborline.fixtures import ENVELOPE, UK, duck, frame, frames
from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import ledger as L
from harborline.operators import quality as Q
from harborline.operators import ranking as K
from harborline.operators import relational as R
from harborline.operators import series as S
from harborline.operators import textcheck as T
from harborline.plans.series_queries import (
    ALL_GOODS, CTES, IN_ENV, IN_MEMBERS, KEYS, LIMITS, RUN, SHAPED, SHARE, SIDE, r6, series_of, shapes, shared_yoy, shares_of, with_series, yoy_of,
)
from harborline.registry import query
from harborline.sources import readers, sinks, tables
from harborline.sources.sinks import kept
from harborline.streaming import jobs

# ---- mirror gap -----------------------------------------------------------------------------

EXPORTER = """SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY label, month_idx ORDER BY version_seen DESC) AS rk FROM exports
    WHERE currency = 'CNY' AND flow = 'export') a WHERE rk = 1"""
RATED = "SELECT e.*, (SELECT arg_max(r.rate, r.rate_idx) FROM fx_rates r WHERE r.rate_idx <= e.month_idx) AS rate FROM exporter e"
EUR = "SELECT *, value_amount * 1e8 * rate AS eur FROM rated"
IMPORTS = f"SELECT reporter, month_idx, CAST(SUM(value_eur) AS DOUBLE) AS imports FROM facts_full WHERE flow = 1 AND {IN_ENV} AND {ALL_GOODS} GROUP BY reporter, month_idx"
GAPS = """SELECT partner, month_idx, eur, rate, imports, n_members, imports - eur AS gap, CASE WHEN greatest(abs(imports), abs(eur)) > 0 THEN (imports - eur) / greatest(abs(imports), abs(eur)) END AS gap_pct,
      CASE WHEN partner = 'N03' THEN 0.05e0 ELSE 0.075e0 END AS baseline, partner IN ('N03', 'N08') AS is_hub,
      CASE WHEN rate IS NULL THEN 'no_rate' WHEN imports IS NULL THEN 'no_counterpart_data' END AS skip FROM (
    SELECT COALESCE(a.iso, 'BLOC:' || a.aggregate_kind) AS partner, e.month_idx, e.eur, e.rate, SUM(i.imports) AS imports, COUNT(i.imports) AS n_members
      FROM eur e JOIN aliases a ON a.label = e.label
      LEFT JOIN members m ON a.aggregate_kind = m.aggregate_kind AND e.month_idx >= COALESCE(m.valid_from, -1) AND e.month_idx <= COALESCE(m.valid_to, 1000000)
      LEFT JOIN imports i ON i.reporter = COALESCE(a.iso, m.iso) AND i.month_idx = e.month_idx
     WHERE (a.aggregate_kind IS NULL OR a.aggregate_kind = 'eu_bloc') AND (a.iso IS NOT NULL OR m.iso IS NOT NULL) GROUP BY ALL) g"""
MIRROR = {"exporter": EXPORTER, "rated": RATED, "eur": EUR, "imports": IMPORTS, "gaps": GAPS}
MIRROR_TABLES = ("facts_full", "exports", "fx_rates", "aliases", "members")


def gaps_of(spark, sf):
    t = frames(spark, sf, "exports", "facts_full", "fx_rates", "aliases", "members", "baselines", "hubs")
    return A.mirror_gap(t["exports"], t["facts_full"], t["fx_rates"], t["aliases"], t["members"], t["baselines"], t["hubs"], ENVELOPE, UK)


@query("b1_mirror_gap", duck("""SELECT partner, month_idx, round(eur, 2) AS eur, round(imports, 2) AS imports, CAST(n_members AS BIGINT) AS n_members, round(gap_pct, 6) AS gap_pct, round(CASE WHEN gap_pct > 0 THEN gap_pct - baseline END, 6) AS excess, is_hub, skip,
    concat_ws(',', CASE WHEN starts_with(partner, 'BLOC:') THEN 'aggregate_composition' END, CASE WHEN is_hub THEN 'transshipment_hub' END) AS caveats FROM gaps""", *MIRROR_TABLES, **MIRROR))
def b1(spark, sf):
    g = gaps_of(spark, sf)
    return g.select("partner", "month_idx", F.round("eur", 2).alias("eur"), F.round("imports", 2).alias("imports"), "n_members", r6("gap_pct"), r6("excess"), "is_hub", "skip", F.array_join("caveats", ",").alias("caveats"))


Z = """SELECT partner, month_idx, gap_pct, base_n, CASE WHEN base_n >= 3 AND sd > 1e-12 THEN (gap_pct - mean) / sd END AS z FROM (
    SELECT *, COUNT(gap_pct) OVER w AS base_n, AVG(gap_pct) OVER w AS mean, stddev_samp(gap_pct) OVER w AS sd FROM gaps WHERE skip IS NULL WINDOW w AS (PARTITION BY partner ORDER BY month_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) a"""


@query("b2_mirror_zscore", duck("SELECT partner, month_idx, round(z, 4) AS z, base_n < 6 AS low_baseline_n FROM z WHERE abs(z) >= 1.5", *MIRROR_TABLES, **MIRROR, z=Z))
def b2(spark, sf):
    return A.mirror_zscore(gaps_of(spark, sf)).select("partner", "month_idx", F.round("z", 4).alias("z"), "low_baseline_n")


@query("b2b_staleness", duck("SELECT MAX(month_idx) AS analysed, (SELECT MAX(month_idx) FROM exports) AS upstream, (SELECT MAX(month_idx) FROM exports) - MAX(month_idx) AS months_behind FROM gaps WHERE skip IS NULL", *MIRROR_TABLES, **MIRROR))
def b2b(spark, sf):
    return A.staleness(gaps_of(spark, sf).where("skip is null"), frame(spark, sf, "exports"))


@query("q18_skip_reasons", duck("SELECT COALESCE(skip, 'kept') AS reason, CAST(COUNT(*) AS BIGINT) AS n FROM gaps GROUP BY 1", *MIRROR_TABLES, **MIRROR))
def q18(spark, sf):
    return A.skip_reasons(gaps_of(spark, sf))


@query("r8_mirror_gaps_sheet", duck("SELECT partner, month_idx, round(gap_pct, 6) AS gap_pct, round((gap_pct - baseline) * 100, 4) AS excess_pp FROM (SELECT *, row_number() OVER (PARTITION BY partner ORDER BY month_idx DESC) AS rk FROM gaps WHERE skip IS NULL) a WHERE rk = 1", *MIRROR_TABLES, **MIRROR))
def r8(spark, sf):
    g = gaps_of(spark, sf).where("skip is null").withColumn("excess_pp", F.round((F.col("gap_pct") - F.col("baseline")) * 100, 4)).withColumn("gap_pct", F.round("gap_pct", 6))
    return K.latest_sheet(g, ["partner"], ["gap_pct", "excess_pp"])


@query("r9_mirror_gap_movers", duck("SELECT partner, month_idx, round(z, 4) AS z FROM z WHERE abs(z) >= 1.5 ORDER BY abs(z) DESC, partner, month_idx LIMIT 50", *MIRROR_TABLES, **MIRROR, z=Z))
def r9(spark, sf):
    return A.mirror_zscore(gaps_of(spark, sf)).orderBy(F.desc(F.abs("z")), "partner", "month_idx").limit(50).select("partner", "month_idx", F.round("z", 4).alias("z"))


@query("j4_asof_fx", duck("SELECT m.month_idx, (SELECT arg_max(rate, rate_idx) FROM fx_rates r WHERE r.rate_idx <= m.month_idx) AS rate, (SELECT MAX(rate_idx) FROM fx_rates r WHERE r.rate_idx <= m.month_idx) AS rate_idx FROM (SELECT DISTINCT month_idx FROM facts) m", "facts", "fx_rates"))
def j4(spark, sf):
    m = frame(spark, sf, "facts").select("month_idx").distinct().withColumn("c", F.lit("CNY"))
    return R.asof_rate(m, frame(spark, sf, "fx_rates"), "c").select("month_idx", "rate", "rate_idx")


@query("j2_j6_lookups", duck("""SELECT e.label, a.iso, a.aggregate_kind, CASE WHEN a.iso = 'N03' THEN 0.05e0 ELSE 0.075e0 END AS baseline, CASE WHEN a.iso = 'N03' THEN 'per_partner' ELSE 'global' END AS baseline_scope, COALESCE(a.iso IN ('N03', 'N08'), FALSE) AS is_hub
    FROM (SELECT DISTINCT label FROM exports) e LEFT JOIN aliases a USING (label)""", "exports", "aliases"))
def j2(spark, sf):
    e = R.resolve_country(frame(spark, sf, "exports").select("label").distinct(), frame(spark, sf, "aliases"))
    return R.hub_flag(R.baseline_for(e, frame(spark, sf, "baselines"), "iso"), frame(spark, sf, "hubs"), "iso").select("label", "iso", "aggregate_kind", "baseline", "baseline_scope", "is_hub")


@query("j3_members_at", duck("SELECT e.month_idx, m.iso AS member FROM (SELECT DISTINCT month_idx FROM facts) e JOIN members m ON e.month_idx <= COALESCE(m.valid_to, 1000000)", "facts", "members"))
def j3(spark, sf):
    m = frame(spark, sf, "facts").select("month_idx", F.lit("eu_bloc").alias("aggregate_kind")).distinct()
    return R.members_at(m, frame(spark, sf, "members")).select("month_idx", "member")


# ---- blocs and bilateral ---------------------------------------------------------------------

MONTHLY = """SELECT label, flow, month_idx, value_amount * 1e8 * (SELECT arg_max(r.rate, r.rate_idx) FROM fx_rates r WHERE r.rate_idx <= p.month_idx) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY label, flow, month_idx ORDER BY version_seen DESC) AS rk FROM exports WHERE currency = 'CNY') p WHERE rk = 1"""
KEPT = "SELECT * FROM monthly WHERE value IS NOT NULL AND NOT ((month_idx // 12) % 3 = 0 AND month_idx % 12 < 2)"
CHUNKS = "SELECT label, flow, month_idx - month_idx % 12 AS jan_idx, SUM(value) AS value FROM monthly WHERE (month_idx // 12) % 3 = 0 AND month_idx % 12 < 2 GROUP BY 1, 2, 3 HAVING COUNT(*) = 2"
WINDOWS = """SELECT x.*, (SELECT k.value FROM kept k WHERE k.label = x.label AND k.flow = x.flow AND k.month_idx = x.month_idx) AS v, (SELECT k.value FROM kept k WHERE k.label = x.label AND k.flow = x.flow AND k.month_idx = x.month_idx - 12) AS vp,
    (SELECT y.value FROM ytd_eur y WHERE y.label = x.label AND y.flow = x.flow AND y.month_idx = x.month_idx) AS y, (SELECT y.value FROM ytd_eur y WHERE y.label = x.label AND y.flow = x.flow AND y.month_idx = x.month_idx - 12) AS yp FROM (
    SELECT a.label, a.flow, a.month_idx, COALESCE(SUM(b.value) FILTER (WHERE b.month_idx > a.month_idx - 12), 0) + COALESCE(MAX(cc.v), 0) AS c, COALESCE(SUM(b.value) FILTER (WHERE b.month_idx <= a.month_idx - 12), 0) + COALESCE(MAX(cp.v), 0) AS p,
           COUNT(*) FILTER (WHERE b.month_idx > a.month_idx - 12) + 2 * COALESCE(MAX(cc.n), 0) AS nc, COUNT(*) FILTER (WHERE b.month_idx <= a.month_idx - 12) + 2 * COALESCE(MAX(cp.n), 0) AS np, COALESCE(MAX(cc.n), 0) AS kc, COALESCE(MAX(cp.n), 0) AS kp
      FROM kept a JOIN kept b ON b.label = a.label AND b.flow = a.flow AND b.month_idx BETWEEN a.month_idx - 23 AND a.month_idx
      LEFT JOIN LATERAL (SELECT SUM(value) AS v, COUNT(*) AS n FROM chunks k WHERE k.label = a.label AND k.flow = a.flow AND k.jan_idx BETWEEN a.month_idx - 11 AND a.month_idx - 1) cc ON TRUE
      LEFT JOIN LATERAL (SELECT SUM(value) AS v, COUNT(*) AS n FROM chunks k WHERE k.label = a.label AND k.flow = a.flow AND k.jan_idx BETWEEN a.month_idx - 23 AND a.month_idx - 13) cp ON TRUE
     GROUP BY a.label, a.flow, a.month_idx) x WHERE nc >= 8 AND np >= 8 AND p <> 0"""
YTD_EUR = "SELECT label, flow, month_idx, value_amount * 1e8 * (SELECT arg_max(r.rate, r.rate_idx) FROM fx_rates r WHERE r.rate_idx <= p.month_idx) AS value FROM exports_ytd p"
BLOC = """SELECT label, flow, month_idx, round((c - p) / abs(p), 6) AS value_yoy, round(CASE WHEN vp <> 0 THEN (v - vp) / abs(vp) END, 6) AS single_yoy, round(CASE WHEN yp <> 0 THEN (y - yp) / abs(yp) END, 6) AS ytd_yoy,
    CAST(nc AS BIGINT) AS n_current, CAST(np AS BIGINT) AS n_prior, nc < 12 OR np < 12 AS partial_window, kc + kp > 0 AS jan_feb_combined, concat_ws(',', CASE WHEN kc + kp > 0 THEN 'jan_feb_combined' END, CASE WHEN nc < 12 OR np < 12 THEN 'partial_window' END) AS caveats FROM windows"""
BLOCS = {"monthly": MONTHLY, "kept": KEPT, "chunks": CHUNKS, "ytd_eur": YTD_EUR, "windows": WINDOWS, "bloc": BLOC}


def bloc_yoy(spark, sf, where: str):
    """Values in EUR of labels of some kind; January and February of every third year come as one chunk."""
    monthly, ytd, aliases = monthly_eur(spark, sf), ytd_eur(spark, sf), frame(spark, sf, "aliases")
    v = R.resolve_country(monthly, aliases).where(where).select("label", "flow", "month_idx", "value")
    early = (F.floor(F.col("month_idx") / 12) % 3 == 0) & (F.col("month_idx") % 12 < 2)
    chunks = v.where(early).groupBy("label", "flow", (F.col("month_idx") - F.col("month_idx") % 12).alias("jan_idx")).agg(F.sum("value").alias("value"), F.count("*").alias("n")).where("n = 2").drop("n")
    return A.partner_yoy(v.where(~early), chunks, ["label", "flow"], ytd)


def monthly_eur(spark, sf):
    """label, flow, month_idx, value in EUR of the pinned edition's latest versions: ranked and rated once for all queries."""

    def rated():
        t = frames(spark, sf, "exports", "fx_rates")
        e = R.latest_by(t["exports"].where("currency = 'CNY'"), ["label", "flow", "month_idx"], F.desc("version_seen"))
        return A.to_eur(e, t["fx_rates"]).where("eur is not null").select("label", "flow", "month_idx", F.col("eur").alias("value"))

    return sinks.once(spark, f"rated {sf}", rated)


def ytd_eur(spark, sf):
    """label, flow, month_idx, ytd in EUR of the published cumulative rows."""

    def rated():
        t = frames(spark, sf, "exports_ytd", "fx_rates")
        return A.to_eur(t["exports_ytd"], t["fx_rates"]).where("eur is not null").select("label", "flow", "month_idx", F.col("eur").alias("ytd"))

    return sinks.once(spark, f"rated ytd {sf}", rated)


def bloc_sheet(rows):
    return rows.select("label", "flow", "month_idx", "n_current", "n_prior", "partial_window", "jan_feb_combined", r6("value_yoy"), r6("single_yoy"), r6("ytd_yoy"), F.array_join("caveats", ",").alias("caveats"))


@query("b6a_bloc_yoy", duck("SELECT b.* FROM bloc b JOIN aliases a USING (label) WHERE a.aggregate_kind IN ('region', 'world')", "exports", "exports_ytd", "fx_rates", "aliases", **BLOCS))
def b6a(spark, sf):
    return bloc_sheet(bloc_yoy(spark, sf, "aggregate_kind in ('region', 'world')"))


@query("b6b_bilateral_yoy", duck("SELECT b.* FROM bloc b JOIN aliases a USING (label) WHERE a.aggregate_kind IS NULL OR a.aggregate_kind = 'eu_bloc'", "exports", "exports_ytd", "fx_rates", "aliases", **BLOCS))
def b6b(spark, sf):
    return bloc_sheet(bloc_yoy(spark, sf, "aggregate_kind is null or aggregate_kind = 'eu_bloc'"))


NET = """round(b{0}, 2) AS {1}, round(CASE WHEN b{0} IS NOT NULL AND COALESCE(q{0}, 0) <> 0 AND sign(b{0}) = sign(q{0}) AND abs((abs(b{0}) - abs(q{0})) / abs(q{0})) < 5 THEN (abs(b{0}) - abs(q{0})) / abs(q{0}) END, 6) AS {2}"""


@query("b12_partner_balance", duck(f"SELECT label AS partner, month_idx, {NET.format(1, 'balance', 'balance_yoy')}, {NET.format(2, 'ytd_balance', 'ytd_balance_yoy')} FROM net WHERE b1 IS NOT NULL", "exports", "exports_ytd", "fx_rates", "aliases", **BLOCS,
    net="SELECT w.label, month_idx, " + ", ".join(f"MAX({c}) FILTER (WHERE flow = 'export') - MAX({c}) FILTER (WHERE flow = 'import') AS {n}" for c, n in (("c", "b1"), ("p", "q1"), ("y", "b2"), ("yp", "q2"))) + " FROM windows w JOIN aliases a USING (label) WHERE a.aggregate_kind IS NULL GROUP BY 1, 2"))
def b12(spark, sf):
    b = kept(bloc_yoy(spark, sf, "aggregate_kind is null").withColumn("flow", F.when(F.col("flow") == "import", 1).otherwise(2)).withColumnRenamed("label", "partner"))
    rolling = A.partner_balance(b).select("partner", "month_idx", F.round("balance", 2).alias("balance"), r6("balance_yoy"))
    ytd = A.partner_balance(b, "ytd", "ytd_prior").select("partner", "month_idx", F.round("balance", 2).alias("ytd_balance"), r6("balance_yoy", "ytd_balance_yoy"))
    return rolling.join(ytd, ["partner", "month_idx"], "left")


@query("w24_annual_from_ytd", duck("SELECT label, flow, CAST(month_idx // 12 AS INT) AS year, round(SUM(value), 2) AS annual, MAX(month_idx) % 12 <> 11 AS partial FROM monthly WHERE value IS NOT NULL GROUP BY 1, 2, 3", "exports", "fx_rates", monthly=MONTHLY))
def w24(spark, sf):
    return annual(spark, sf).select("label", "flow", "year", F.round("annual", 2).alias("annual"), "partial")


def annual(spark, sf):
    """The year's value of each label and flow, read from its cumulative series."""
    v = monthly_eur(spark, sf)
    w = Window.partitionBy("label", "flow", F.floor(F.col("month_idx") / 12)).orderBy("month_idx")
    return S.annual_from_ytd(v.withColumn("ytd", F.sum("value").over(w)), ["label", "flow"], "ytd")


# ---- ledger -----------------------------------------------------------------------------------

def _findings(every, factor: float):
    y = every.withColumn("value_yoy", F.when(F.col("month_idx") % 5 == 0, F.col("value_yoy") * factor).otherwise(F.col("value_yoy")))
    return L.keyed(y, "hs_group_yoy", F.lit("hs_group_yoy"), ["value_yoy"], "v1").select("nk", "sig", "subkind", "month_idx", "value_yoy")


#: Buckets of the ledger's tables by natural key.
LEDGER_BUCKETS = 16


def _ledger(spark, sf):
    """Two runs: the first without the newest months, the second with some values revised; built once, in tables bucketed by key."""
    ts = lambda d: F.lit(f"2026-0{d}-01 00:00:00").cast("timestamp")
    every = sinks.once(spark, f"yoy {sf}", lambda: yoy_of(spark, sf))

    def bucketed(df):
        return spark.table(tables.write_bucketed(df, "nk", LEDGER_BUCKETS, f"{sinks.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))

    def two():
        first = bucketed(L.merge_findings(spark.createDataFrame([], jobs.LEDGER), _findings(every, 1.0).where("month_idx < 24000"), ts(1)).drop("action"))
        return L.merge_findings(first, _findings(every, 1.1), ts(2))

    return sinks.once(spark, f"ledger {sf}", two), ts, every


LEDGER_COUNTS = """SELECT CASE WHEN month_idx >= 24000 THEN 'inserted_new' WHEN month_idx % 5 = 0 AND round(value_yoy, 6) <> round(value_yoy * 1.1e0, 6) THEN 'superseded' ELSE 'confirmed_existing' END AS action, 'hs_group_yoy' AS subkind, CAST(COUNT(*) AS BIGINT) AS n FROM yoy GROUP BY 1"""


@query("l3_merge_findings", with_series(LEDGER_COUNTS))
def l3(spark, sf):
    return L.emit_counts(_ledger(spark, sf)[0])


YOY_KEY = "substr(sha256(concat_ws(chr(31), 'hs_group_yoy', group_name, scope, CAST(flow AS VARCHAR), CAST(month_idx AS VARCHAR))), 1, 32)"


@query("l6_duplicate_active", with_series(f"SELECT nk, CAST(2 AS BIGINT) AS n FROM (SELECT {YOY_KEY} AS nk FROM yoy) a WHERE nk < '2'"))
def l6(spark, sf):
    """A ledger in which some keys were written twice: these alone break the rule."""
    ledger = _ledger(spark, sf)[0]
    return L.duplicate_active(ledger.unionByName(ledger.where("nk < '2' and superseded_at is null")))


@query("l7_revision_chain", with_series("SELECT CAST(n AS INT) AS revisions, CAST(COUNT(*) AS BIGINT) AS keys FROM (SELECT CASE WHEN month_idx < 24000 AND month_idx % 5 = 0 AND round(value_yoy, 6) <> round(value_yoy * 1.1e0, 6) THEN 2 ELSE 1 END AS n FROM yoy) a GROUP BY n"))
def l7(spark, sf):
    chain = L.revision_chain(_ledger(spark, sf)[0]).groupBy("nk").agg(F.max("revision").alias("revisions"))
    return chain.groupBy("revisions").agg(F.count("*").alias("keys"))


@query("l10_l11_withdraw_retire", with_series("SELECT CAST(COUNT(*) FILTER (WHERE month_idx < 24000) AS BIGINT) AS n_left, CAST(COUNT(*) FILTER (WHERE month_idx < 24000 AND NOT (month_idx % 5 = 0 AND round(value_yoy, 6) <> round(value_yoy * 1.1e0, 6))) AS BIGINT) AS n_retired FROM yoy"))
def l10(spark, sf):
    two, ts, _ = _ledger(spark, sf)
    left = L.withdraw_interval(two.drop("action"), ts(2), ts(3), ["hs_group_yoy"])
    ended = L.retire(left, left.select("nk"), ts(4))
    return ended.agg(F.count("*").alias("n_left"), F.count_if(F.col("superseded_at") == ts(4)).alias("n_retired"))


@query("r0e_revision_diff", with_series("""SELECT *, CASE WHEN n_same >= 0.95 * n_pairs THEN 'method_bump' ELSE 'movement' END AS regime FROM (SELECT CAST(COUNT(*) FILTER (WHERE old) AS BIGINT) AS n_pairs, CAST(0 AS BIGINT) AS n_flips,
    CAST(COUNT(*) FILTER (WHERE old AND abs(value_yoy * 1.1e0 - value_yoy) > 0.05) AS BIGINT) AS n_material, CAST(COUNT(*) FILTER (WHERE old AND abs(value_yoy * 1.1e0 - value_yoy) < 1e-4) AS BIGINT) AS n_same, CAST(COUNT(*) FILTER (WHERE month_idx >= 24000) AS BIGINT) AS n_new
    FROM (SELECT *, month_idx < 24000 AND month_idx % 5 = 0 AND round(value_yoy, 6) <> round(value_yoy * 1.1e0, 6) AS old FROM yoy) a) b"""))
def r0e(spark, sf):
    two, ts, every = _ledger(spark, sf)
    values = _findings(every, 1.0).select("nk", "sig", "value_yoy").unionByName(_findings(every, 1.1).select("nk", "sig", "value_yoy")).dropDuplicates(["nk", "sig"])
    valued = two.join(values, ["nk", "sig"])
    return L.revision_regime(L.revision_pairs(valued, "value_yoy"), L.new_since(two, ts(2)))


@query("l5_version_observations", duck("SELECT status, version_seen, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN month_idx >= 23980 THEN 'new' WHEN month_idx % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN month_idx < 23980 AND month_idx % 7 = 0 THEN 2 ELSE 1 END AS version_seen FROM (SELECT DISTINCT month_idx, reporter, partner, flow FROM facts) c) a GROUP BY 1, 2", "facts"))
def l5(spark, sf):
    cells = frame(spark, sf, "facts").groupBy("month_idx", "reporter", "partner", "flow").agg(F.sum("value_eur").alias("value"))
    old = cells.where("month_idx < 23980").withColumn("version_seen", F.lit(1))
    new = cells.withColumn("value", F.when(F.col("month_idx") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return L.version_observations(old, new, ["month_idx", "reporter", "partner", "flow"], ["value"]).groupBy("status", "version_seen").agg(F.count("*").alias("n"))


# ---- ranking and reports ------------------------------------------------------------------------

STAB = """SELECT group_name, scope, flow, MAX(value_yoy) FILTER (WHERE month_idx = t) AS now, MAX(value_yoy) FILTER (WHERE month_idx = t - 6) AS "then" FROM (SELECT *, MAX(month_idx) OVER () AS t FROM yoy) a GROUP BY 1, 2, 3
    HAVING MAX(value_yoy) FILTER (WHERE month_idx = t) IS NOT NULL AND MAX(value_yoy) FILTER (WHERE month_idx = t - 6) IS NOT NULL"""
BADGE = """SELECT group_name, COUNT(*) AS n_pairs, AVG(CASE WHEN sign(now) = sign("then") AND abs(now - "then") < 0.05 THEN 1.0 ELSE 0.0 END) AS s FROM stab GROUP BY 1"""
BADGE_OF = "CASE WHEN n_pairs < 3 THEN 'unscored' WHEN s >= 0.67 THEN 'green' WHEN s >= 0.33 THEN 'yellow' ELSE 'red' END"


@query("r0_stability_badge", with_series(f"SELECT group_name, CAST(n_pairs AS BIGINT) AS n_pairs, round(s, 6) AS persistent_share, {BADGE_OF} AS badge FROM badge", stab=STAB, badge=BADGE))
def r0(spark, sf):
    return K.stability_badge(K.stability_pairs(shared_yoy(spark, sf))).select("group_name", "n_pairs", r6("persistent_share"), "badge")


@query("q16_stability_backtest", with_series("""SELECT CAST(COUNT(*) AS BIGINT) AS n_pairs, CAST(COUNT(*) FILTER (WHERE sign(now) = sign("then") AND abs(now - "then") < 0.05) AS BIGINT) AS n_persistent, CAST(COUNT(*) FILTER (WHERE sign(now) <> sign("then")) AS BIGINT) AS n_flips FROM stab""", stab=STAB))
def q16(spark, sf):
    return K.backtest(K.stability_pairs(shared_yoy(spark, sf))).select("n_pairs", "n_persistent", "n_flips")


@query("r0b_top_movers", with_series(f"""SELECT group_name, flow, round(value_yoy, 6) AS value_yoy, round(abs(value_yoy) * log10(value_current), 6) AS score FROM yoy WHERE scope = 'eu_27' AND month_idx = (SELECT MAX(month_idx) FROM yoy WHERE scope = 'eu_27')
    AND NOT low_base AND value_current >= {LIMITS.top_floor} AND abs(value_yoy) >= 0.1 AND group_name NOT IN (SELECT group_name FROM badge WHERE {BADGE_OF} = 'red') AND group_name NOT IN ('beta', 'epsilon') ORDER BY score DESC, group_name, flow LIMIT 5""", stab=STAB, badge=BADGE))
def r0b(spark, sf):
    y = shared_yoy(spark, sf)
    held = L.held_groups(frame(spark, sf, "group_list")).select("group_name")
    return K.top_movers(y, K.stability_badge(K.stability_pairs(y)), held, LIMITS.top_floor).select("group_name", "flow", r6("value_yoy"), r6("score"))


@query("l9_held_groups", duck("SELECT DISTINCT group_name FROM part_groups WHERE starts_with(created_by, 'hidden:') OR starts_with(created_by, 'draft:')", "part_groups"))
def l9(spark, sf):
    return L.held_groups(frame(spark, sf, "part_groups").select("group_name", "created_by").distinct()).select("group_name")


@query("r1_summary_sheet", shapes(f"""SELECT g.group_name, COALESCE(g.display_name, g.group_name) AS name, b.badge, t.shape, {", ".join(f"round(MAX(value_yoy) FILTER (WHERE y.scope = '{s}' AND y.flow = {f}), 6) AS {s}_{n}" for s in ("eu_27", "uk", "eu_27_plus_uk") for f, n in ((1, "import"), (2, "export")))}
    FROM (SELECT DISTINCT group_name, display_name FROM group_patterns) g LEFT JOIN (SELECT *, MAX(month_idx) OVER (PARTITION BY group_name, scope, flow) AS t FROM yoy) y ON y.group_name = g.group_name AND y.month_idx = y.t
    LEFT JOIN (SELECT group_name, {BADGE_OF} AS badge FROM badge) b ON b.group_name = g.group_name LEFT JOIN (SELECT group_name, shape FROM shaped WHERE scope = 'eu_27' AND flow = 1) t ON t.group_name = g.group_name GROUP BY 1, 2, 3, 4""", stab=STAB, badge=BADGE))
def r1(spark, sf):
    y = shared_yoy(spark, sf)
    s = K.summary_sheet(y, A.trajectory(y, limits=LIMITS), K.stability_badge(K.stability_pairs(y)), frame(spark, sf, "group_list"))
    names = [f"{sc}_{f}" for sc in ("eu_27", "uk", "eu_27_plus_uk") for f in ("import", "export")]
    return s.select("group_name", "name", "badge", "shape", *(r6(n) for n in names))


@query("r3_r4_yoy_sheets", with_series("SELECT group_name, scope, flow, month_idx, round(value_yoy, 6) AS value_yoy, fragile, round(abs(value_yoy) * log10(greatest(value_current, 1)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx DESC) AS rk FROM yoy) a WHERE rk = 1"))
def r3(spark, sf):
    y = yoy_of(spark, sf).withColumn("score", F.round(K.mover_score("value_yoy", "value_current"), 6)).withColumn("value_yoy", F.round("value_yoy", 6))
    return K.latest_sheet(y, KEYS, ["value_yoy", "fragile", "score"])


@query("r10_low_base_review", with_series("SELECT group_name, scope, flow, month_idx, round(least(value_current, value_prior), 6) AS smaller_window FROM (SELECT *, MAX(month_idx) OVER (PARTITION BY group_name, scope, flow) AS t FROM yoy) a WHERE month_idx = t AND low_base"))
def r10(spark, sf):
    return K.low_base_review(shared_yoy(spark, sf)).select(*KEYS, "month_idx", r6("smaller_window"))


@query("r18_movers_section", with_series("SELECT group_name, scope, flow, month_idx, round(value_yoy, 6) AS value_yoy, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope, flow ORDER BY abs(value_yoy) DESC, group_name) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY month_idx DESC) AS rk FROM yoy) a WHERE rk = 1) b WHERE rank <= 3"))
def r18(spark, sf):
    return K.movers_section(yoy_of(spark, sf), 3).select(*KEYS, "month_idx", r6("value_yoy"), "rank")


@query("r22_r35_texts", with_series("""SELECT group_name, scope, flow, month_idx, concat(CASE WHEN flow = 1 THEN 'Imports' ELSE 'Exports' END, ' of ', group_name, CASE WHEN value_yoy >= 0 THEN ' rose ' ELSE ' fell ' END, printf('%.1f%%', abs(value_yoy) * 100), ' to €',
      CASE WHEN abs(value_current) >= 1e9 THEN printf('%.2fB', value_current / 1e9) WHEN abs(value_current) >= 1e6 THEN printf('%.1fM', value_current / 1e6) WHEN abs(value_current) >= 1e3 THEN printf('%.1fk', value_current / 1e3) ELSE printf('%.0f', value_current) END) AS sentence,
    concat_ws('; ', CASE WHEN abs((value - single_prior) / abs(single_prior)) >= 3 THEN 'extreme' END, CASE WHEN missing > 0 THEN CASE WHEN n_current < 12 THEN 'current window incomplete' ELSE 'prior window incomplete' END END) AS warning FROM yoy"""))
def r22(spark, sf):
    y = K.mover_sentence(K.warnings(yoy_of(spark, sf)))
    return y.select(*KEYS, "month_idx", "sentence", F.regexp_replace("warning", r"single month [+-][0-9,]+%", "extreme").alias("warning"))


@query("r20_coverage_manifest", duck("SELECT flow AS source, MIN(month_idx) AS first_idx, MAX(month_idx) AS last_idx, CAST(COUNT(*) AS BIGINT) AS n_releases FROM (SELECT DISTINCT flow, month_idx FROM exports) r GROUP BY flow", "exports"))
def r20(spark, sf):
    return K.coverage_manifest(frame(spark, sf, "exports").select(F.col("flow").alias("source"), "month_idx").distinct())[0]


@query("r20_last_releases", duck("SELECT flow AS source, month_idx, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY month_idx DESC) AS rank FROM (SELECT DISTINCT flow, month_idx FROM exports) r) a WHERE rank <= 12", "exports"))
def r20b(spark, sf):
    return K.coverage_manifest(frame(spark, sf, "exports").select(F.col("flow").alias("source"), "month_idx").distinct())[1].select("source", "month_idx", "rank")


LIST = """SELECT subject, n_kinds, round(strength, 6) AS strength, kinds FROM (
    SELECT subject, CAST(COUNT(DISTINCT kind) AS BIGINT) AS n_kinds, MAX(strength) AS strength, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM picked WHERE subject <> 'alpha' GROUP BY 1) a ORDER BY n_kinds DESC, strength DESC, subject LIMIT 8"""
PICKS = {
    "size": "SELECT group_name, MAX(abs(value_yoy)) AS size FROM yoy WHERE scope = 'eu_27' AND month_idx = (SELECT MAX(month_idx) FROM yoy WHERE scope = 'eu_27') GROUP BY 1",
    "share": "SELECT group_name, arg_max(value_share, month_idx) AS share FROM (" + SHARE.replace("round(v / dv, 6)", "v / dv") + ") s GROUP BY 1",
    "flips": "SELECT DISTINCT group_name, TRUE AS flip FROM shaped WHERE shape IN ('inverse_u_peak', 'failed_recovery')",
    "subjects": "SELECT group_name AS subject, size, share, flip, COALESCE(size, 0) + COALESCE(share, 0) AS strength FROM size FULL JOIN share USING (group_name) FULL JOIN flips USING (group_name)",
    "far": "SELECT partner AS subject, MAX(abs(z)) / 2 AS strength FROM z WHERE abs(z) >= 1.5 AND NOT starts_with(partner, 'BLOC:') GROUP BY 1",
    "picked": """SELECT * FROM (SELECT subject, strength, 'mover' AS kind FROM subjects WHERE size IS NOT NULL ORDER BY size DESC, subject LIMIT 3) UNION ALL SELECT * FROM (SELECT subject, strength, 'dependency' FROM subjects WHERE share >= 0.85 ORDER BY share DESC, subject LIMIT 3)
      UNION ALL SELECT * FROM (SELECT subject, strength, 'flip' FROM subjects WHERE flip ORDER BY COALESCE(size, 0) DESC, subject LIMIT 2) UNION ALL SELECT * FROM (SELECT subject, strength, 'mirror' FROM far ORDER BY strength DESC, subject LIMIT 2)""",
}


@query("r23_interest_shortlist", duck(LIST, "facts", "group_patterns", *MIRROR_TABLES, **CTES, run=RUN, **SHAPED, **MIRROR, z=Z, num=SIDE.format(IN_ENV), den=SIDE.format(f"NOT {IN_MEMBERS}"), **PICKS))
def r23(spark, sf):
    every = shared_yoy(spark, sf)
    y = R.at_latest_anchor(every.where("scope = 'eu_27'"), [])
    shares = R.latest_by(shares_of(spark, sf), ["group_name"], F.desc("month_idx"))
    branches = K.shortlist_branches(y, shares, A.trajectory(every, limits=LIMITS), A.mirror_zscore(gaps_of(spark, sf)))
    out = K.interest_shortlist(branches, y.where("group_name = 'alpha'").select(F.col("group_name").alias("subject")).distinct())
    return out.select("subject", "n_kinds", r6("strength"), "kinds")


PRICE = "CASE WHEN kg_cov >= 0.8 AND kg_{0} > 0 THEN wk_{0} / kg_{0} END"
FACTS = {"value_current": "value_current", "value_prior": "value_prior", "value_yoy": "value_yoy", "kg_yoy": "kg_yoy", "price_yoy": "CASE WHEN pp <> 0 THEN (pc - pp) / abs(pp) END"}


@query("r24_fact_sheet", shapes("SELECT f.group_name, path, round(value, 6) AS value, s.shape FROM (" + " UNION ALL ".join(f"SELECT group_name, scope || CASE flow WHEN 1 THEN '.import.' ELSE '.export.' END || '{n}' AS path, {e} AS value FROM last" for n, e in FACTS.items())
    + ") f LEFT JOIN (SELECT group_name, shape FROM shaped WHERE scope = 'eu_27' AND flow = 1) s USING (group_name) WHERE value IS NOT NULL",
    last=f"SELECT *, {PRICE.format('current')} AS pc, {PRICE.format('prior')} AS pp FROM (SELECT *, MAX(month_idx) OVER (PARTITION BY group_name, scope, flow) AS t FROM yoy) a WHERE month_idx = t AND (scope = 'eu_27' OR NOT low_base)"))
def r24(spark, sf):
    y = shared_yoy(spark, sf)
    return K.fact_sheet(y, A.trajectory(y, limits=LIMITS)).select("group_name", F.explode("facts").alias("path", "value"), "shape").select("group_name", "path", r6("value"), "shape")


@query("r21_source_trail", with_series("""SELECT y.group_name, y.scope, y.flow, y.month_idx, CAST(COUNT(DISTINCT r.month_idx) AS BIGINT) AS n_releases FROM yoy y JOIN (SELECT DISTINCT month_idx FROM facts) r ON r.month_idx BETWEEN y.month_idx - 23 AND y.month_idx GROUP BY 1, 2, 3, 4"""))
def r21(spark, sf):
    f = yoy_of(spark, sf).select(*KEYS, "month_idx").withColumn("at", F.explode(F.sequence(F.col("month_idx") - 23, F.col("month_idx"))))
    releases = frame(spark, sf, "facts").select(F.col("month_idx").alias("at")).distinct()
    return f.join(releases, "at").groupBy(*KEYS, "month_idx").agg(F.count("*").alias("n_releases"))


@query("a9_histogram", with_series("SELECT CAST(bucket AS INT) AS bucket, CAST(COUNT(*) AS BIGINT) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM yoy), 6) AS share FROM (SELECT CASE WHEN value_yoy >= 0.5 THEN 3 WHEN value_yoy >= 0 THEN 2 WHEN value_yoy >= -0.2 THEN 1 ELSE 0 END AS bucket FROM yoy) a GROUP BY 1"))
def a9(spark, sf):
    return R.histogram(yoy_of(spark, sf), "value_yoy", [-0.2, 0.0, 0.5]).select("bucket", "n", r6("share"))


@query("a13_mode_lowest", duck("SELECT reporter, partner FROM (SELECT reporter, partner, row_number() OVER (PARTITION BY reporter ORDER BY COUNT(*) DESC, partner) AS rk FROM facts GROUP BY 1, 2) a WHERE rk = 1", "facts"))
def a13(spark, sf):
    return R.mode_lowest(frame(spark, sf, "facts"), ["reporter"], "partner")


@query("a14_sibling_groups", duck("""SELECT group_id, sibling_id, shared, CAST(rank AS INT) AS rank FROM (SELECT a.group_name AS group_id, b.group_name AS sibling_id, CAST(COUNT(*) AS BIGINT) AS shared, row_number() OVER (PARTITION BY a.group_name ORDER BY b.group_name) AS rank
    FROM heads a JOIN heads b ON a.h = b.h AND a.group_name <> b.group_name GROUP BY 1, 2) x WHERE rank <= 6""", "part_groups", heads="SELECT DISTINCT group_name, substr(prefix, 1, 4) AS h FROM part_groups"))
def a14(spark, sf):
    return R.sibling_groups(frame(spark, sf, "part_groups").withColumnRenamed("group_name", "group_id"))


@query("o1_o3_latest_topk", duck("SELECT reporter, partner, CAST(rank AS INT) AS rank FROM (SELECT reporter, partner, row_number() OVER (PARTITION BY reporter ORDER BY SUM(value_eur) DESC NULLS LAST, partner) AS rank FROM facts GROUP BY 1, 2) a WHERE rank <= 3", "facts"))
def o3(spark, sf):
    s = frame(spark, sf, "facts").groupBy("reporter", "partner").agg(F.sum("value_eur").alias("v"))
    return R.top_k(s, ["reporter"], 3, F.desc_nulls_last("v"), F.asc("partner")).select("reporter", "partner", "rank")


@query("a8_suppressed_counts", duck(f"SELECT CAST(COUNT(*) FILTER (WHERE month_idx > t - 12) AS BIGINT) AS now, CAST(COUNT(*) FILTER (WHERE month_idx BETWEEN t - 23 AND t - 12) AS BIGINT) AS before FROM (SELECT *, (SELECT MAX(month_idx) FROM facts) AS t FROM facts) a WHERE reporter = '{UK}' AND suppression_index <> 0", "facts"))
def a8(spark, sf):
    f = frame(spark, sf, "facts")
    j = f.where((F.col("reporter") == UK) & (F.col("suppression_index") != 0)).join(F.broadcast(f.agg(F.max("month_idx").alias("t"))))
    back = F.col("t") - F.col("month_idx")
    return j.agg(F.count_if(back < 12).alias("now"), F.count_if(back.between(12, 23)).alias("before"))


# ---- quality ------------------------------------------------------------------------------------

@query("q1_q2_coverage_gaps", duck("SELECT reporter, partner, month_idx FROM (SELECT DISTINCT reporter, partner FROM facts) k CROSS JOIN (SELECT DISTINCT month_idx FROM facts) m WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.reporter = k.reporter AND f.partner = k.partner AND f.month_idx = m.month_idx)", "facts"))
def q1(spark, sf):
    return Q.coverage_gaps(frame(spark, sf, "facts"), ["reporter", "partner"])


@query("q3_duplicate_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def q3(spark, sf):
    return Q.duplicate_keys(frame(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q4_unexpected", duck(f"SELECT DISTINCT reporter FROM facts WHERE reporter NOT IN (SELECT DISTINCT reporter FROM facts WHERE {IN_ENV} AND month_idx < 23942)", "facts"))
def q4(spark, sf):
    f = frame(spark, sf, "facts")
    return Q.unexpected(f, f.where(X.in_envelope("partner", ENVELOPE) & (F.col("month_idx") < 23942)), "reporter")


@query("q5_reconcile", duck(f"SELECT reporter, round(t, 6) AS total, round(d, 6) AS detail, round(abs(d - t) / abs(t), 6) AS difference, abs(d - t) / abs(t) <= 0.15 AS within FROM (SELECT reporter, CAST(SUM(value_eur) FILTER (WHERE product_nc = '000TOTAL') AS DOUBLE) AS t, CAST(SUM(value_eur) FILTER (WHERE product_nc <> '000TOTAL' AND (substr(product_nc, 1, 2) <> '16' OR reporter = 'N03')) AS DOUBLE) AS d FROM facts_full WHERE reporter <> '{UK}' GROUP BY 1) a", "facts_full"))
def q5(spark, sf):
    """Detail without one chapter (but for one reporter) against the published totals."""
    f = frame(spark, sf, "facts_full").where((F.col("reporter") != UK) & ((F.substring("product_nc", 1, 2) != "16") | (F.col("reporter") == "N03")))
    return Q.reconcile(f, "reporter").select("reporter", r6("total"), r6("detail"), r6("difference"), "within")


@query("q6_w25_units", duck("SELECT currency, unit, CASE WHEN unit = 'CNY 100 Million' THEN 1e8 ELSE 1e6 END AS multiplier, TRUE AS consistent, CAST(COUNT(*) AS BIGINT) AS n FROM exports GROUP BY 1, 2", "exports"))
def q6(spark, sf):
    e = frame(spark, sf, "exports").groupBy("currency", "unit").agg(F.count("*").alias("n"))
    return e.select("currency", "unit", X.unit_scale("unit")["multiplier"].alias("multiplier"), Q.currency_unit_consistent("currency", "unit").alias("consistent"), "n")


@query("q7_valid_patterns", duck("SELECT group_name, bool_and(regexp_full_match(p, '[0-9]{2,8}%') AND NOT starts_with('000TOTAL', replace(p, '%', ''))) AS valid, CAST(COUNT(*) AS BIGINT) AS n FROM pats GROUP BY 1", "part_groups", pats="SELECT group_name, CASE WHEN group_name = 'size-7' THEN '0%' WHEN group_name = 'size-9' THEN prefix ELSE prefix || '%' END AS p FROM part_groups"))
def q7(spark, sf):
    name = F.col("group_name")
    bad = F.when(name == "size-7", "0%").when(name == "size-9", F.col("prefix")).otherwise(F.concat("prefix", F.lit("%")))
    p = frame(spark, sf, "part_groups").groupBy("group_name").agg(F.collect_list(bad).alias("patterns"))
    return p.select("group_name", Q.valid_patterns("patterns").alias("valid"), F.size("patterns").cast("long").alias("n"))


#: Which source the rows of a table stand for: exporter-declared flows and the facts of either reporter.
PERIODS = f"""SELECT CASE flow WHEN 'export' THEN 'gacc' ELSE 'unscheduled' END AS source, month_idx FROM exports UNION SELECT CASE reporter WHEN '{UK}' THEN 'hmrc' ELSE 'eurostat' END, month_idx FROM facts"""
DUE = """SELECT p.source, p.month_idx, CASE WHEN s.lag IS NOT NULL THEN COALESCE(CASE WHEN p.source = 'eurostat' AND of_idx % 5 = 0 THEN make_date(CAST(of_idx // 12 AS INT), CAST(of_idx % 12 + 1 AS INT), 1) + 70 END,
      last_day(make_date(CAST(of_idx // 12 AS INT), CAST(of_idx % 12 + 1 AS INT), 1)) + CAST(s.lag AS INT)) END AS due, s.grace FROM (SELECT *, month_idx + CASE WHEN source = 'gacc' AND month_idx % 12 = 0 THEN 1 ELSE 0 END AS of_idx FROM {0}) p
    LEFT JOIN (VALUES ('eurostat', 46, 5), ('hmrc', 44, 7), ('gacc', 8, 4)) AS s(source, lag, grace) ON s.source = p.source"""
STATE = "CASE WHEN DATE '2001-10-20' < due THEN 'none_expected' WHEN DATE '2001-10-20' <= due + CAST(grace AS INT) THEN 'due' WHEN due IS NOT NULL THEN 'overdue' END AS state"


def periods_of(spark, sf):
    """(periods of every source, exact publication dates of some of them)."""
    t = frames(spark, sf, "exports", "facts")
    e = t["exports"].select(F.when(F.col("flow") == "export", "gacc").otherwise("unscheduled").alias("source"), "month_idx")
    p = e.unionByName(t["facts"].select(F.when(F.col("reporter") == UK, "hmrc").otherwise("eurostat").alias("source"), "month_idx")).distinct()
    exact = p.where("source = 'eurostat' and month_idx % 5 = 0").withColumn("exact_date", F.date_add(X.month_start("month_idx"), 70))
    return p, exact


@query("q9_publication", duck(f"SELECT source, month_idx, due, {STATE} FROM due", "exports", "facts", periods=PERIODS, due=DUE.format("periods")))
def q9(spark, sf):
    p, exact = periods_of(spark, sf)
    return Q.publication_expectation(p, exact, F.lit("2001-10-20").cast("date"), Q.schedules(spark)).select("source", "month_idx", "due", "state")


@query("q10_next_release", duck(f"SELECT source, month_idx, due, {STATE} FROM due", "exports", "facts", periods=PERIODS, due=DUE.format("(SELECT source, m + CASE WHEN source = 'gacc' AND m % 12 = 0 THEN 1 ELSE 0 END AS month_idx FROM (SELECT source, MAX(month_idx) + 1 AS m FROM periods GROUP BY 1) n) q")))
def q10(spark, sf):
    p, exact = periods_of(spark, sf)
    return Q.next_release_forecast(p, exact, F.lit("2001-10-20").cast("date"), Q.schedules(spark)).select("source", "month_idx", "due", "state")


@query("q11_source_status", duck("SELECT source, MAX(checked_at) AS last_checked, arg_max(result, (checked_at, event_id)) AS last_result, MAX(checked_at) FILTER (WHERE result = 'new_data') AS last_new_data, CAST(COUNT(*) AS BIGINT) AS n_checks, CAST(COUNT(*) FILTER (WHERE result = 'error') AS BIGINT) AS n_errors FROM check_log GROUP BY 1", "check_log"))
def q11(spark, sf):
    return Q.source_status(frame(spark, sf, "check_log"))


@query("q12_run_lifecycle", duck("SELECT MAX(checked_at) FILTER (WHERE result = 'not_yet') AS started, MAX(checked_at) FILTER (WHERE result = 'new_data') AS finished, MAX(checked_at) FILTER (WHERE result = 'not_yet') > MAX(checked_at) FILTER (WHERE result = 'new_data') AS in_flight FROM check_log", "check_log"))
def q12(spark, sf):
    return Q.run_lifecycle(frame(spark, sf, "check_log"), "not_yet", "new_data")


@query("q13_newly_overdue", duck("SELECT source, event_id FROM (SELECT *, lag(result) OVER (PARTITION BY source ORDER BY checked_at, event_id) AS b FROM check_log) a WHERE result = 'not_yet' AND (b IS NULL OR b <> 'not_yet')", "check_log"))
def q13(spark, sf):
    return Q.newly_overdue(frame(spark, sf, "check_log")).select("source", "event_id")


@query("q14_new_data_since", duck("SELECT source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checked_at DESC, event_id DESC) AS rk FROM check_log WHERE result = 'new_data' AND checked_at > TIMESTAMP '2024-01-10 00:00:00') a WHERE rk = 1", "check_log"))
def q14(spark, sf):
    return Q.new_data_since(frame(spark, sf, "check_log"), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("source", "event_id")


@query("q15_threshold_sweep", with_series("SELECT t.x AS threshold, CAST(COUNT(*) FILTER (WHERE m < t.x) AS BIGINT) AS n_under, round(COUNT(*) FILTER (WHERE m < t.x) / COUNT(*), 6) AS share, CAST(COUNT(*) FILTER (WHERE m < t.x) - COUNT(*) FILTER (WHERE m < 5e6) AS BIGINT) AS change FROM (SELECT least(value_current, value_prior) AS m FROM yoy) a CROSS JOIN (VALUES (1e6), (5e6), (2e7)) AS t(x) GROUP BY t.x"))
def q15(spark, sf):
    m = yoy_of(spark, sf).select(F.least("value_current", "value_prior").alias("m"))
    return Q.threshold_sweep(m, "m", [1e6, 2e7], 5e6).select("threshold", "n_under", r6("share"), "change")


@query("q17_replay", with_series("SELECT group_name, scope, flow, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE month_idx % 10 <> 0) AS BIGINT) AS n_match FROM yoy GROUP BY 1, 2, 3"))
def q17(spark, sf):
    """Findings, some of them falsified, against their windows summed again from raw rows."""
    told = yoy_of(spark, sf).withColumn("value_current", F.when(F.col("month_idx") % 10 == 0, F.col("value_current") * 1.01).otherwise(F.col("value_current")))
    raw = R.assign_groups(A.scoped(frame(spark, sf, "facts"), ENVELOPE, UK), frame(spark, sf, "group_patterns")).select(*KEYS, "month_idx", F.col("value_eur").alias("value"))
    return Q.replay(told, raw, KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if("matches").alias("n_match"))


@query("q19_publish_due", duck("SELECT MAX(month_idx) AS data_idx, MAX(month_idx) - 2 AS published_idx, TRUE AS due FROM facts", "facts"))
def q19(spark, sf):
    f = frame(spark, sf, "facts").select("month_idx")
    return Q.publish_due(f, f.select((F.col("month_idx") - 2).alias("month_idx")))


@query("q20_run_history", duck("SELECT event_id, source, result FROM check_log ORDER BY checked_at DESC, event_id DESC LIMIT 20", "check_log"))
def q20(spark, sf):
    return Q.run_history(frame(spark, sf, "check_log")).select("event_id", "source", "result")


@query("q22_notification_mark", duck("SELECT MAX(checked_at) AS mark FROM check_log WHERE result = 'new_data'", "check_log"))
def q22(spark, sf):
    return Q.notification_mark(frame(spark, sf, "check_log"), "new_data", F.lit("2000-01-01").cast("timestamp"))


# ---- texts, sources and sinks ---------------------------------------------------------------------

def _drafts(spark, sf):
    """A sentence per group-YoY row, every tenth with a wrong figure, with its facts."""
    y = yoy_of(spark, sf).withColumn("draft_id", F.concat_ws("|", *KEYS, "month_idx")).withColumn("wrong", F.col("month_idx") % 10 == 0)
    told = F.col("value_yoy") + F.when(F.col("wrong"), 0.5).otherwise(0.0)
    text = F.concat(F.lit("In the 12 months to 2001 trade "), F.when(told >= 0, "rose").otherwise("fell"), F.format_string(" by %.3f%% to ", F.abs(told) * 100), F.lit("€"), F.format_string("%.3f", F.col("value_current") / 1e6), F.lit("M."))
    facts = F.create_map(F.lit("value_yoy"), F.col("value_yoy"), F.lit("value_current"), F.col("value_current"))
    return y.select("draft_id", text.alias("text"), facts.alias("facts"), "wrong", F.array(F.when(F.col("month_idx") % 7 == 0, "h9").otherwise("h1")).alias("hypothesis_ids"))


@query("t1_t3_verify_numbers", with_series("SELECT kind, verified, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT 'pct' AS kind, NOT (month_idx % 10 = 0) AS verified FROM yoy UNION ALL SELECT 'currency', TRUE FROM yoy) a GROUP BY 1, 2"))
def t1(spark, sf):
    d = _drafts(spark, sf)
    v = T.verify_numbers(T.extract_numbers(d), T.flatten_facts(d))
    return v.groupBy("kind", "verified").agg(F.count("*").alias("n"))


@query("t4_validate_drafts", with_series("SELECT CASE WHEN month_idx % 7 = 0 THEN 'unknown_hypothesis' WHEN month_idx % 10 = 0 THEN 'unverified_number' ELSE 'ok' END AS reason, CAST(COUNT(*) AS BIGINT) AS n FROM yoy GROUP BY 1"))
def t4(spark, sf):
    d = _drafts(spark, sf)
    catalogue = spark.createDataFrame([("h1", 1, ["check customs notes"]), ("h2", 2, ["ask the trade body"])], "hypothesis_id string, ord int, steps array<string>")
    reasons = T.validate_drafts(d, catalogue, T.verify_numbers(T.extract_numbers(d), T.flatten_facts(d)))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


@query("t7_t8_labels", "SELECT n_name, lower(replace(n_name, '_', '-')) AS slug, n_name AS short FROM nation")
def t7(spark, sf):
    n = frame(spark, sf, "nation")
    return n.select("n_name", X.slug("n_name").alias("slug"), X.short_label(F.concat("n_name", F.lit(" (part), other"))).alias("short"))


@query("a2_to_observations", duck("SELECT month_idx, reporter, partner, product_nc, flow, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value_amount, round(CAST(SUM(quantity_kg) AS DOUBLE), 6) AS kg, CAST(COUNT(*) AS BIGINT) AS n_raw, string_agg(raw_id, ',' ORDER BY raw_id) AS ids FROM facts GROUP BY 1, 2, 3, 4, 5", "facts"))
def a2(spark, sf):
    f = frame(spark, sf, "facts").withColumn("suppl_unit", F.lit("p/st")).withColumn("quantity_suppl_unit", F.lit(0).cast("decimal(20,3)"))
    return readers.to_observations(f).select("month_idx", "reporter", "partner", "product_nc", "flow", r6("value_amount"), r6("kg"), "n_raw", F.array_join("raw_row_ids", ",").alias("ids"))


@query("a3_to_observations_uk", duck(f"SELECT month_idx, partner, product_nc, flow, round(CAST(SUM(value_eur) FILTER (WHERE suppression_index = 0) AS DOUBLE), 6) AS value_amount, CAST(COUNT(*) AS BIGINT) AS n_raw, CAST(COUNT(*) FILTER (WHERE suppression_index <> 0) AS BIGINT) AS n_suppressed FROM facts WHERE reporter = '{UK}' GROUP BY 1, 2, 3, 4", "facts"))
def a3(spark, sf):
    return readers.to_observations_uk(frame(spark, sf, "facts").where(F.col("reporter") == UK)).select("month_idx", "partner", "product_nc", "flow", r6("value_amount"), "n_raw", "n_suppressed")


def _release_pages(spark, sf):
    """Release pages rendered from exporter rows, one a month: a row of ten cells per label, or of seven on a page of January and February.

    Titles and unit cells come in the shapes that publishers use.
    """
    e = frame(spark, sf, "exports").where("currency = 'CNY' and version_seen = 1")
    wide = e.groupBy("label", "month_idx").agg(*(F.max(F.when(F.col("flow") == f, F.col("value_amount"))).alias(f) for f in ("export", "import")))
    n = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.14f", c))
    year, month, kind = F.floor(F.col("month_idx") / 12).cast("int"), (F.col("month_idx") % 12).cast("int"), F.col("month_idx") % 6
    both = (month == 1) & (year % 3 == 0)
    label = F.concat(F.lit("\n\u00a0\u00a0"), "label")
    ten = F.concat_ws("</td><td>", label, F.lit("1"), F.lit("2"), n("export"), F.lit("4"), n("import"), F.lit("6"), F.lit("7"), F.lit("8"), F.lit("9"))
    seven = F.concat_ws("</td><td>", label, F.lit("1"), n("export"), n("import"), F.lit("4"), F.lit("5"), F.lit("6"))
    row = F.concat(F.lit("<tr><td>"), F.when(both, seven).otherwise(ten), F.lit("</td></tr>"))
    pages = wide.groupBy("month_idx").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    name = F.element_at(F.array(*map(F.lit, readers.MONTH_NAMES)), month + 1)
    short = F.substring(name, 1, 3)
    when = F.when(both, F.element_at(F.array(*map(F.lit, ("January-February", "Jan\u2013Feb", "January \u2014 February"))), (year % 2 + 1).cast("int"))).when(kind % 2 == 0, short).when(kind == 1, name).otherwise(F.concat(short, F.lit(".")))
    head = F.when(kind == 0, "(4) ").when(kind == 1, "").when(kind == 2, "(3) ").otherwise("(4) ")
    what = F.when(kind == 3, "Total Export &amp; Import Values by Major Country (Region)").otherwise("Total Export &amp; Import Values by Country/Region")
    tail = F.when(kind == 1, " (in RMB)").when((kind == 2) & ~both, F.concat(F.lit(" (Only "), short, F.lit("., in CNY)"))).otherwise(" (in CNY)")
    title = F.concat(head, what, F.lit(", "), when, F.lit(" "), year.cast("string"), tail)
    unit = F.when(kind % 2 == 0, "<td><span><b>Unit: CNY 100 Million</b></span></td>").otherwise("<td>Unit: CNY 100 Million</td>")
    html = F.concat(F.lit('<html><body><div class="atcl-ttl">'), title, F.lit('</div><div class="atcl-date">2002/01/08</div><div class="atcl-cnt"><table><tr>'), unit, F.lit('</tr><tr><td colspan="10">Heading</td></tr>'), "rows", F.lit("</table></div></body></html>"))
    return pages.select(F.concat(F.lit("page-"), F.col("month_idx").cast("string")).alias("url"), F.encode(html, "UTF-8").alias("html"))


@query("s4_release_pages", duck("SELECT label, month_idx, flow, CASE WHEN month_idx % 12 = 1 AND (month_idx // 12) % 3 = 0 THEN 'cumulative_jan_feb' ELSE 'monthly' END AS period_kind, 4 AS section, 'CNY 100 Million' AS unit, DATE '2002-01-08' AS published, round(MAX(value_amount), 6) AS value_amount FROM exports WHERE currency = 'CNY' AND version_seen = 1 GROUP BY 1, 2, 3, 4", "exports"))
def s4(spark, sf):
    obs, _ = readers.parse_release_pages(_release_pages(spark, sf))
    return obs.where("period_kind <> 'ytd' and flow <> 'total'").select("label", "month_idx", "flow", "period_kind", "section", "unit", "published", r6("value_amount"))


@query("s5_s6_cells", "SELECT n_name AS label, 2 AS indent, n_nationkey % 2 = 0 AS is_subset, CAST(n_nationkey AS DOUBLE) * 1000 AS number, n_nationkey = 3 AS rejected FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT n_name, 2, FALSE, NULL, TRUE FROM nation WHERE n_nationkey = 3")
def s5(spark, sf):
    n = frame(spark, sf, "nation")
    cell = F.concat(F.lit(" \n\u00a0\u00a0"), F.when(F.col("n_nationkey") % 2 == 0, "of which: ").otherwise(""), "n_name", F.lit("  "))
    number = F.when(F.col("n_nationkey") == 3, "n/a").otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(",000\u00a0")))
    p = n.select(X.partner_label(cell).alias("p"), X.parse_number(number).alias("number"), X.number_rejected(number).alias("rejected"))
    return p.select("p.label", "p.indent", "p.is_subset", "number", "rejected")


@query("s11_s12_upserts", "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 OR n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS upserted, CASE WHEN n_nationkey < 20 THEN 'old' ELSE 'new' END AS inserted FROM nation")
def s11(spark, sf):
    n = frame(spark, sf, "nation").select("n_nationkey")
    old = n.where("n_nationkey < 20").withColumn("v", F.lit("old"))
    new = n.where("n_nationkey >= 20 or n_nationkey % 2 = 0").withColumn("v", F.lit("new"))
    up = sinks.upsert_by_key(old, new, ["n_nationkey"]).withColumnRenamed("v", "upserted")
    return up.join(sinks.insert_absent(old, new, ["n_nationkey"]).withColumnRenamed("v", "inserted"), "n_nationkey")
