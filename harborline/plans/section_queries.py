"""Queries over report sections and cards, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.fixtures import ENVELOPE, UK, duck, frame, frames
from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import ledger as L
from harborline.operators import ranking as K
from harborline.operators import relational as R
from harborline.operators import sections as C
from harborline.plans import report_queries as Q
from harborline.plans.series_queries import ALL_GOODS, CODE_GROUPS, CTES as SERIES_CTES, IN_ENV, KEYS, LIMITS, MOVER_CTES, RUN, allgoods_of, b9, balance_of, movers_of, r6, shapes, shared_yoy, shares_of, with_series, yoy_of
from harborline.registry import ORACLES, query
from harborline.sources.sinks import kept

BLOC_TABLES = ("exports", "exports_ytd", "fx_rates", "aliases")
SINGLE = "SELECT b.* FROM bloc b JOIN aliases a USING (label) WHERE a.aggregate_kind IS NULL OR a.aggregate_kind = 'eu_bloc'"
BILATERAL = "aggregate_kind is null or aggregate_kind = 'eu_bloc'"


def blocs(body: str, **more: str) -> str:
    return duck(body, *BLOC_TABLES, **Q.BLOCS, single=SINGLE, **more)


@query("r0c_top_bilateral_movers", blocs("SELECT label, flow, value_yoy FROM single WHERE month_idx = (SELECT MAX(month_idx) FROM single) AND abs(value_yoy) >= 0.05 ORDER BY abs(value_yoy) DESC, label, flow LIMIT 5"))
def r0c(spark, sf):
    return C.top_bilateral_movers(Q.bloc_yoy(spark, sf, BILATERAL)).select("label", "flow", r6("value_yoy"))


@query("r2_trade_balance_sheet", "SELECT reporter_scope, partner_scope, month_idx, balance_current, balance_yoy FROM (SELECT *, row_number() OVER (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx DESC) AS rk FROM (" + ORACLES["b7_trade_balance"] + ") b) c WHERE rk = 1")
def r2(spark, sf):
    b = balance_of(spark, sf)
    return R.latest_by(b, ["reporter_scope", "partner_scope"], F.desc("month_idx")).select("reporter_scope", "partner_scope", "month_idx", r6("balance_current"), r6("balance_yoy"))


@query("r5_reporter_movers", "SELECT group_name, scope, flow, rank, reporter, delta, CASE WHEN low_base THEN 'low base' END AS mark FROM (SELECT *, MAX(month_idx) OVER (PARTITION BY group_name, scope, flow) AS t FROM (" + ORACLES["b3r_reporter_breakdown"] + ") b) c WHERE month_idx = t")
def r5(spark, sf):
    b = kept(A.reporter_breakdown(yoy_of(spark, sf), frame(spark, sf, "facts"), frame(spark, sf, "group_patterns"), ENVELOPE, UK, limits=LIMITS))
    return C.reporter_movers_sheet(b).select(*KEYS, "rank", "reporter", r6("delta"), "mark")


@query("r6_r27_trajectory_section", shapes("SELECT group_name, scope, flow, shape, CAST(list_position([" + ", ".join(map(repr, C.SHAPE_ORDER)) + "], shape) AS INT) AS shape_rank FROM shaped"))
def r27(spark, sf):
    return C.trajectory_section(A.trajectory(yoy_of(spark, sf), limits=LIMITS)).select(*KEYS, "shape", F.col("shape_rank").cast("int").alias("shape_rank"))


@query("r7_bilateral_sheet", blocs("SELECT label, flow, month_idx, value_yoy, CASE WHEN label = (SELECT label FROM aliases WHERE aggregate_kind = 'eu_bloc') THEN 0 ELSE 1 END AS ord FROM (SELECT *, row_number() OVER (PARTITION BY label, flow ORDER BY month_idx DESC) AS rk FROM single) a WHERE rk = 1"))
def r7(spark, sf):
    bloc = frame(spark, sf, "aliases").where("aggregate_kind = 'eu_bloc'").first()["label"]
    return C.bilateral_sheet(Q.bloc_yoy(spark, sf, BILATERAL), bloc).select("label", "flow", "month_idx", r6("value_yoy"), "ord")


@query("r11_stability_index", with_series(f"SELECT group_name, badge, list_position(['green', 'yellow', 'red', 'unscored'], badge) AS ord FROM (SELECT group_name, {Q.BADGE_OF} AS badge FROM badge) b", stab=Q.STAB, badge=Q.BADGE))
def r11(spark, sf):
    return C.stability_index(K.stability_badge(K.stability_pairs(yoy_of(spark, sf)))).select("group_name", "badge", F.col("ord").cast("int").alias("ord"))


@query("r12_biggest_product_mover", duck("""SELECT product_nc, round(y0, 6) AS yoy, surfaced, round(score, 6) AS score FROM (
    SELECT m.product_nc, y0, bool_or(g.group_name = 'alpha') AS surfaced, abs(y0) * log10(greatest(c0, 1)) AS score FROM movers m JOIN code_groups g USING (product_nc) WHERE verdict = 'mover'
    GROUP BY m.product_nc, y0, c0 HAVING bool_or(g.group_name NOT IN ('beta', 'epsilon'))) a ORDER BY surfaced, score DESC, product_nc LIMIT 1""", "facts", "group_patterns", **MOVER_CTES))
def r12(spark, sf):
    movers = kept(movers_of(spark, sf))
    parents = R.group_codes(movers, frame(spark, sf, "group_patterns"))
    return C.biggest_product_mover(movers, parents, ["beta", "epsilon"], ["alpha"]).select("product_nc", r6("yoy0", "yoy"), "surfaced", r6("score"))


@query("r13_level_cards", "SELECT reporter_scope, partner_scope, month_idx, balance_current AS level, CAST(n AS BIGINT) AS n_points FROM (SELECT *, row_number() OVER (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx DESC) AS rk, COUNT(*) OVER (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS n FROM (" + ORACLES["b7_trade_balance"] + ") b) c WHERE rk = 1")
def r13(spark, sf):
    b = balance_of(spark, sf)
    c = C.level_card(b, ["reporter_scope", "partner_scope"], "balance_current")
    return c.select("reporter_scope", "partner_scope", "month_idx", r6("level"), F.size("points").cast("long").alias("n_points"))


@query("r13_import_share_cards", "SELECT 'imports ' || reporter_scope || ' ' || partner_scope AS card, month_idx, imports_current AS level, CAST(n AS BIGINT) AS n_points FROM (SELECT *, row_number() OVER (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx DESC) AS rk, COUNT(*) OVER (PARTITION BY reporter_scope, partner_scope ORDER BY month_idx RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS n FROM ("
    + ORACLES["b7_trade_balance"] + ") b) c WHERE rk = 1 UNION ALL SELECT 'share ' || flow, month_idx, value_share, CAST(n AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY month_idx DESC) AS rk, COUNT(*) OVER (PARTITION BY flow ORDER BY month_idx RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS n FROM (" + ORACLES["b8_allgoods_share"] + ") b) c WHERE rk = 1")
def r13b(spark, sf):
    imports = C.level_card(balance_of(spark, sf), ["reporter_scope", "partner_scope"], "imports_current").withColumn("card", F.concat_ws(" ", F.lit("imports"), "reporter_scope", "partner_scope"))
    shares = C.level_card(allgoods_of(spark, sf).drop("points"), ["flow"], "value_share").withColumn("card", F.concat_ws(" ", F.lit("share"), F.col("flow").cast("string")))
    cols = ["card", "month_idx", r6("level"), F.size("points").cast("long").alias("n_points")]
    return imports.select(*cols).unionByName(shares.select(*cols))


SIBLING = """SELECT e.reporter_scope, e.month_idx, e.balance_current, s.balance_current AS single_balance, e.n_months, w.value_share AS share FROM (SELECT *, COUNT(*) OVER (PARTITION BY reporter_scope ORDER BY month_idx) AS n_months, row_number() OVER (PARTITION BY reporter_scope ORDER BY month_idx DESC) AS rk FROM ({0}) b WHERE partner_scope = 'envelope') e
    LEFT JOIN ({0}) s ON s.partner_scope = 'single' AND s.reporter_scope = e.reporter_scope AND s.month_idx = e.month_idx LEFT JOIN ({1}) w ON w.flow = 1 AND w.month_idx = e.month_idx WHERE e.rk = 1"""


@query("r28_deficit_by_scope", "SELECT reporter_scope, month_idx, balance_current, single_balance, CAST(n_months AS BIGINT) AS n_months, share FROM (" + SIBLING.format(ORACLES["b7_trade_balance"], ORACLES["b8_allgoods_share"]) + ") a")
def r28(spark, sf):
    d = C.deficit_by_scope(kept(balance_of(spark, sf)), allgoods_of(spark, sf).where("flow = 1"))
    return d.select("reporter_scope", "month_idx", r6("balance_current"), r6("single_balance"), F.size("points").cast("long").alias("n_months"), r6("share"))


CELLS = "SELECT group_name, scope, flow, {k}, month_idx, SUM(value_eur) AS v FROM scoped JOIN code_groups USING (product_nc) GROUP BY ALL"
PARTS = """SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow, month_idx ORDER BY abs(c - p) DESC, reporter) AS by_size FROM (
    SELECT y.group_name, y.scope, y.flow, y.month_idx, m.reporter, y.value_current - y.value_prior AS gd, CAST(COALESCE(SUM(CASE WHEN y.month_idx - m.month_idx < 12 THEN m.v END), 0) AS DOUBLE) AS c, CAST(COALESCE(SUM(CASE WHEN y.month_idx - m.month_idx >= 12 THEN m.v END), 0) AS DOUBLE) AS p
      FROM last y JOIN by_reporter m ON m.group_name = y.group_name AND m.scope = y.scope AND m.flow = y.flow AND m.month_idx BETWEEN y.month_idx - 23 AND y.month_idx GROUP BY ALL) a"""
GOODS = """SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow, month_idx ORDER BY c DESC, product_nc) AS rk FROM (SELECT y.group_name, y.scope, y.flow, y.month_idx, m.product_nc, CAST(SUM(m.v) AS DOUBLE) AS c
      FROM last y JOIN by_code m ON m.group_name = y.group_name AND m.scope = y.scope AND m.flow = y.flow AND m.month_idx BETWEEN y.month_idx - 11 AND y.month_idx GROUP BY ALL) a WHERE c > 0"""


@query("r14_sector_detail", with_series("""SELECT l.group_name, l.scope, l.flow, l.month_idx, p.products, r.reporters, f.facets FROM last l
    LEFT JOIN (SELECT group_name, scope, flow, string_agg(product_nc, ',' ORDER BY rk) AS products FROM goods WHERE rk <= 3 GROUP BY 1, 2, 3) p USING (group_name, scope, flow)
    LEFT JOIN (SELECT group_name, scope, flow, string_agg(reporter, ',' ORDER BY rk) AS reporters FROM (SELECT *, row_number() OVER (PARTITION BY group_name, scope, flow ORDER BY CASE WHEN gd <> 0 THEN (c - p) / gd END DESC NULLS LAST, reporter) AS rk FROM parts WHERE by_size <= 10) a WHERE rk <= 3 GROUP BY 1, 2, 3) r USING (group_name, scope, flow)
    LEFT JOIN (SELECT group_name, string_agg(DISTINCT substr(product_nc, 1, 3), ',' ORDER BY substr(product_nc, 1, 3)) AS facets FROM code_groups GROUP BY 1) f USING (group_name)""",
    last="SELECT * EXCLUDE (t) FROM (SELECT *, MAX(month_idx) OVER (PARTITION BY scope) AS t FROM yoy) a WHERE month_idx = t", by_reporter=CELLS.format(k="reporter"), by_code=CELLS.format(k="product_nc"), parts=PARTS, goods=GOODS))
def r14(spark, sf):
    y, facts, patterns = shared_yoy(spark, sf), frame(spark, sf, "facts"), frame(spark, sf, "group_patterns")
    last = kept(R.at_latest_anchor(y, ["scope"]))  # only these findings need their products and reporters
    d = C.sector_detail(last, A.top_products(last, facts, patterns, ENVELOPE, UK), A.reporter_breakdown(last, facts, patterns, ENVELOPE, UK, limits=LIMITS))
    codes = facts.select("product_nc").distinct().withColumn("division", F.substring("product_nc", 1, 3))
    d = d.join(A.group_facets(patterns, codes), "group_name", "left")
    return d.select(*KEYS, "month_idx", F.array_join("product_ncs", ",").alias("products"), F.array_join("reporters", ",").alias("reporters"), F.array_join("facets", ",").alias("facets"))


@query("r14_section_order", duck("SELECT substr(product_nc, 2, 1) AS section, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS section_value FROM facts GROUP BY 1", "facts"))
def r14b(spark, sf):
    rows = frame(spark, sf, "facts").withColumn("section", F.substring("product_nc", 2, 1))
    return K.section_order(rows, "section", "value_eur").select("section", r6("section_value"))


@query("r15_state_of_play", blocs("SELECT label, flow, month_idx, value_yoy FROM (SELECT *, row_number() OVER (PARTITION BY label, flow ORDER BY month_idx DESC) AS rk FROM bloc) a WHERE rk = 1"))
def r15(spark, sf):
    return C.state_of_play(Q.bloc_yoy(spark, sf, "true"), ["label", "flow"]).select("label", "flow", "month_idx", r6("value_yoy"))


@query("r16_mirror_section", duck("""SELECT g.partner, g.month_idx, round(g.gap_pct, 6) AS gap_pct, round(l.z, 4) AS z, CASE WHEN starts_with(g.partner, 'BLOC:') THEN 0 ELSE 1 END AS ord FROM gaps g
    LEFT JOIN (SELECT partner, arg_max(z, month_idx) AS z FROM z WHERE abs(z) >= 1.5 GROUP BY 1) l USING (partner) WHERE g.skip IS NULL AND g.month_idx = (SELECT MAX(month_idx) FROM gaps WHERE skip IS NULL)""", *Q.MIRROR_TABLES, **Q.MIRROR, z=Q.Z))
def r16(spark, sf):
    g = Q.gaps_of(spark, sf)
    return C.mirror_section(g, A.mirror_zscore(g)).select("partner", "month_idx", r6("gap_pct"), F.round("z", 4).alias("z"), "ord")


@query("r17_share_section", "SELECT group_name, month_idx, value_share FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY month_idx DESC) AS rk FROM (" + ORACLES["b9_group_share"] + ") s) a WHERE rk = 1")
def r17(spark, sf):
    return C.share_section(b9(spark, sf)).select("group_name", "month_idx", "value_share")


@query("r19_bloc_macro", blocs("SELECT label, flow, month_idx, value_yoy, CASE WHEN label = 'Total' THEN 0 ELSE 1 END AS ord FROM (SELECT b.*, MAX(month_idx) OVER (PARTITION BY flow) AS t FROM bloc b JOIN aliases a USING (label) WHERE a.aggregate_kind IN ('region', 'world')) x WHERE month_idx = t"))
def r19(spark, sf):
    return C.bloc_macro(Q.bloc_yoy(spark, sf, "aggregate_kind in ('region', 'world')"), "Total").select("label", "flow", "month_idx", r6("value_yoy"), "ord")


@query("r29_bilateral_section", blocs("""SELECT label, month_idx, CASE WHEN bool_or(combined) THEN 'January and February combined' WHEN bool_or(partial) THEN 'months missing' END AS note, CAST(COUNT(*) AS BIGINT) AS n_flows,
      round(MAX(c) FILTER (WHERE flow = 'export'), 2) AS exports, round(MAX(c) FILTER (WHERE flow = 'import'), 2) AS imports, round(MAX(c) FILTER (WHERE flow = 'export') - MAX(c) FILTER (WHERE flow = 'import'), 2) AS balance,
      round(MAX(y) FILTER (WHERE flow = 'export'), 2) AS ytd_exports, round(MAX(y) FILTER (WHERE flow = 'import'), 2) AS ytd_imports, round(MAX(v) FILTER (WHERE flow = 'export'), 2) AS month_exports, round(MAX(v) FILTER (WHERE flow = 'import'), 2) AS month_imports
    FROM (SELECT w.*, kc + kp > 0 AS combined, nc < 12 OR np < 12 AS partial, MAX(month_idx) OVER (PARTITION BY label) AS t FROM windows w JOIN aliases a USING (label) WHERE a.aggregate_kind IS NULL OR a.aggregate_kind = 'eu_bloc') a WHERE month_idx = t GROUP BY 1, 2"""))
def r29(spark, sf):
    s = C.bilateral_section(Q.bloc_yoy(spark, sf, BILATERAL))
    sums = ("exports", "imports", "balance", "ytd_exports", "ytd_imports", "month_exports", "month_imports")
    return s.select("label", "month_idx", "note", (F.col("exports").isNotNull().cast("long") + F.col("imports").isNotNull().cast("long")).alias("n_flows"), *(F.round(c, 2).alias(c) for c in sums))


@query("r30_finding_counts", blocs("SELECT flow AS subkind, CAST(COUNT(*) AS BIGINT) AS n, MIN(month_idx) AS first_idx, MAX(month_idx) AS last_idx FROM single GROUP BY 1"))
def r30(spark, sf):
    return C.finding_counts(Q.bloc_yoy(spark, sf, BILATERAL), "flow")


#: A definition for all caveats but one, which is reported as missing.
DEFINED = ("cif_fob", "classification_drift", "multi_partner_sum", "currency_timing", "general_vs_special_trade", "eurostat_stat_procedure_mix", "cn8_revision")


def subkinds(spark, sf):
    """The subkind of every finding that the group changes and the mirror gaps make, with its number of findings."""
    scope = F.when(F.col("scope") == "uk", "_uk").when(F.col("scope") == "eu_27_plus_uk", "_combined").otherwise("")
    y = yoy_of(spark, sf).select(F.concat(F.lit("hs_group_yoy"), scope, F.when(F.col("flow") == 2, "_export").otherwise("")).alias("subkind"))
    return y.unionByName(Q.gaps_of(spark, sf).where("skip is null").select(F.lit("mirror_gap").alias("subkind"))).groupBy("subkind").agg(F.count("*").alias("n"))


KINDS = {**Q.MIRROR, "kinds": """SELECT subkind, COUNT(*) AS n FROM (SELECT 'hs_group_yoy' || CASE scope WHEN 'uk' THEN '_uk' WHEN 'eu_27_plus_uk' THEN '_combined' ELSE '' END || CASE flow WHEN 2 THEN '_export' ELSE '' END AS subkind FROM yoy
    UNION ALL SELECT 'mirror_gap' FROM gaps WHERE skip IS NULL) a GROUP BY 1"""}


def kinds(body: str) -> str:
    return duck(body, "facts_full", "group_patterns", "exports", "fx_rates", "aliases", "members", **SERIES_CTES, **KINDS)


def _universal(family: str) -> list[str]:
    return list(X.UNIVERSAL_CAVEATS.get(family, ()))


FAMILY_CODES = " UNION ALL ".join(f"SELECT '{f}' AS family, '{c}' AS code" for f in ("hs_group_yoy", "mirror_gap") for c in _universal(f))


@query("b10_b11_subkinds", kinds(f"""SELECT subkind, CASE WHEN subkind = 'mirror_gap' THEN 'mirror_gap' ELSE 'hs_group_yoy' END AS family, CASE WHEN contains(subkind, '_uk') THEN 'uk' WHEN contains(subkind, '_combined') THEN 'eu_27_plus_uk' ELSE 'eu_27' END AS scope,
    CASE WHEN suffix(subkind, '_export') THEN 2 ELSE 1 END AS flow, CASE WHEN subkind = 'mirror_gap' THEN {len(_universal('mirror_gap'))} ELSE {len(_universal('hs_group_yoy'))} END AS n_caveats, CAST(n AS BIGINT) AS n FROM kinds"""))
def b10(spark, sf):
    d = subkinds(spark, sf).select("subkind", X.decode_subkind("subkind").alias("d"), F.size(X.universal_caveats("subkind")).alias("n_caveats"), "n")
    return d.select("subkind", "d.family", "d.scope", "d.flow", "n_caveats", "n")


@query("r31_caveat_reference", kinds(f"SELECT DISTINCT c.family, c.code, c.code IN ({', '.join(map(repr, DEFINED))}) AS defined FROM ({FAMILY_CODES}) c JOIN kinds k ON starts_with(k.subkind, c.family)"))
def r31(spark, sf):
    u = subkinds(spark, sf).select(X.decode_subkind("subkind")["family"].alias("family"), X.universal_caveats("subkind").alias("codes")).distinct()
    known = spark.createDataFrame([(c, f"what {c} means") for c in DEFINED], "code string, definition string")
    return K.caveat_reference(u, known).select("family", "code", "defined")


@query("r32_cited_releases", duck("SELECT source, month_idx, MAX(checked_at) AS last_fetched FROM (SELECT source, 24289 - event_id % 40 AS month_idx, checked_at FROM check_log) r WHERE month_idx BETWEEN 24270 AND 24280 GROUP BY 1, 2", "check_log"))
def r32(spark, sf):
    r = frame(spark, sf, "check_log").select("source", (24289 - F.col("event_id") % 40).cast("int").alias("month_idx"), F.col("checked_at").alias("fetched_at"))
    return K.cited_releases(spark.createDataFrame([(24270, 24275), (24273, 24280)], "first_idx int, last_idx int"), r).withColumn("month_idx", F.col("month_idx").cast("long"))


@query("r33_finding_months", blocs("SELECT s.label, s.flow, s.month_idx AS anchor, CAST(COUNT(m.month_idx) AS BIGINT) AS n_months FROM single s JOIN (SELECT * FROM monthly WHERE value IS NOT NULL) m ON m.label = s.label AND m.flow = s.flow AND m.month_idx BETWEEN s.month_idx - 23 AND s.month_idx GROUP BY 1, 2, 3"))
def r33(spark, sf):
    m = C.finding_months(Q.bloc_yoy(spark, sf, BILATERAL), ["label", "flow"], Q.monthly_eur(spark, sf), frame(spark, sf, "fx_rates"))
    return m.groupBy("label", "flow", "anchor").agg(F.count("*").alias("n_months"))


@query("b13_cross_check", duck("SELECT partner, month_idx, n_own, n_other, round((o / n_other - w / n_own) / (w / n_own), 6) AS gap_pct FROM pairs WHERE w / n_own <> 0", "exports", "exports_ytd", "fx_rates", "aliases", "facts_full", **Q.BLOCS,
    pairs=f"""SELECT a.iso AS partner, b.month_idx, CAST(b.nc AS BIGINT) AS n_own, b.c AS w, CAST(COUNT(DISTINCT f.month_idx) AS BIGINT) AS n_other, CAST(SUM(f.value_eur) AS DOUBLE) AS o FROM windows b JOIN aliases a USING (label)
      JOIN (SELECT * FROM facts_full WHERE flow = 1 AND {IN_ENV} AND {ALL_GOODS}) f ON f.reporter = a.iso AND f.month_idx BETWEEN b.month_idx - 11 AND b.month_idx WHERE a.aggregate_kind IS NULL AND b.flow = 'export' GROUP BY 1, 2, 3, 4"""))
def b13(spark, sf):
    """Exports as one side declares them against the other side's imports from the envelope, per month present in the same window."""
    t = frames(spark, sf, "aliases", "facts_full")
    own = R.resolve_country(Q.bloc_yoy(spark, sf, "aggregate_kind is null and flow = 'export'"), t["aliases"]).withColumnRenamed("iso", "partner")
    other = A.importer_totals(t["facts_full"], ENVELOPE, UK).withColumnRenamed("reporter", "partner")
    return A.cross_check(own, other, ["partner"]).select("partner", "month_idx", F.col("n_current").alias("n_own"), F.col("other_n").alias("n_other"), r6("gap_pct"))


@query("b15_group_facets", duck("SELECT group_name, string_agg(DISTINCT substr(product_nc, 1, 3), ',' ORDER BY substr(product_nc, 1, 3)) AS facets FROM code_groups GROUP BY 1", "facts", "group_patterns", code_groups=CODE_GROUPS))
def b15(spark, sf):
    codes = frame(spark, sf, "facts").select("product_nc").distinct().withColumn("division", F.substring("product_nc", 1, 3))
    return A.group_facets(frame(spark, sf, "group_patterns"), codes).select("group_name", F.array_join("facets", ",").alias("facets"))


@query("b18_annual_by_region", duck("SELECT label, year, round(e, 2) AS exports, round(i, 2) AS imports, round(e - i, 2) AS balance FROM (SELECT label, CAST(month_idx // 12 AS INT) AS year, SUM(value) FILTER (WHERE flow = 'export') AS e, SUM(value) FILTER (WHERE flow = 'import') AS i FROM monthly WHERE value IS NOT NULL GROUP BY 1, 2) a", "exports", "fx_rates", monthly=Q.MONTHLY))
def b18(spark, sf):
    a = C.annual_by_region(Q.annual(spark, sf))
    return a.select("label", "year", *(F.round(c, 2).alias(c) for c in ("exports", "imports", "balance")))


def keyed_families(spark, sf):
    """The natural keys of the rows of all ten families."""
    y = shared_yoy(spark, sf)
    gaps = kept(Q.gaps_of(spark, sf).where("skip is null"))
    blocs_ = kept(Q.bloc_yoy(spark, sf, "true").join(frame(spark, sf, "aliases").select("label", "aggregate_kind"), "label"))
    one = F.lit(1).alias("flow")
    last = frame(spark, sf, "facts").where("flow = 1").agg(F.max("month_idx").alias("month_idx"))
    rows = {
        "mirror_gap": gaps, "mirror_gap_zscore": A.mirror_zscore(gaps), "hs_group_yoy": y, "hs_group_trajectory": y.select(*KEYS).distinct(),
        "product_mover": movers_of(spark, sf).select("product_nc", one).join(F.broadcast(last)), "bloc_yoy": blocs_.where("aggregate_kind in ('region', 'world')"),
        "bilateral_yoy": blocs_.where("aggregate_kind is null or aggregate_kind = 'eu_bloc'").withColumnRenamed("label", "partner"), "trade_balance": balance_of(spark, sf),
        "allgoods_share": allgoods_of(spark, sf).where("flow = 1"), "group_share": shares_of(spark, sf).select("group_name", one, "month_idx"),
    }
    return {f: L.keyed(df, f, F.lit(f), [], "v1").select(F.col("subkind").alias("family"), "nk") for f, df in rows.items()}


FAMILY_ROWS = {
    "mirror_gap": "SELECT partner, month_idx FROM gaps WHERE skip IS NULL", "mirror_gap_zscore": "SELECT partner, month_idx FROM z WHERE abs(z) >= 1.5", "hs_group_yoy": "SELECT group_name, scope, flow, month_idx FROM yoy",
    "hs_group_trajectory": "SELECT DISTINCT group_name, scope, flow FROM yoy", "product_mover": "SELECT product_nc, 1, (SELECT MAX(month_idx) FROM codes) FROM movers",
    "bloc_yoy": "SELECT label, flow, month_idx FROM windows JOIN aliases USING (label) WHERE aggregate_kind IN ('region', 'world')", "bilateral_yoy": "SELECT label, flow, month_idx FROM windows JOIN aliases USING (label) WHERE aggregate_kind IS NULL OR aggregate_kind = 'eu_bloc'",
    "trade_balance": "SELECT reporter_scope, partner_scope, month_idx FROM balances", "allgoods_share": "SELECT month_idx FROM world_shares WHERE flow = 1", "group_share": "SELECT group_name, 1, month_idx FROM group_shares",
}
NATURAL = " UNION ALL ".join(f"SELECT '{f}' AS family, substr(sha256('{f}' || chr(31) || {' || chr(31) || '.join(f'CAST(c{i} AS VARCHAR)' for i in range(len(L.KEYS[f])))}), 1, 32) AS nk FROM ({rows}) t({', '.join(f'c{i}' for i in range(len(L.KEYS[f])))})" for f, rows in FAMILY_ROWS.items())


@query("l4_natural_keys", duck(f"SELECT family, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT nk) AS BIGINT) AS n_keys, MIN(nk) AS first_nk, MAX(nk) AS last_nk FROM ({NATURAL}) k GROUP BY 1", "facts", "facts_full", "group_patterns", "exports", "exports_ytd", "fx_rates", "aliases", "members",
    **SERIES_CTES, **{k: v for k, v in MOVER_CTES.items() if k != "code_groups"}, **Q.MIRROR, z=Q.Z, **Q.BLOCS, balances=ORACLES["b7_trade_balance"], world_shares=ORACLES["b8_allgoods_share"], group_shares=ORACLES["b9_group_share"]))
def l4(spark, sf):
    parts = list(keyed_families(spark, sf).values())
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("nk").alias("n_keys"), F.min("nk").alias("first_nk"), F.max("nk").alias("last_nk"))
