"""Queries over tables that are kept up to date, laid out, checked and replayed at scale, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harborline.fixtures import ENVELOPE, UK, duck, frame
from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import filters as V
from harborline.operators import quality as Q
from harborline.operators import refresh as I
from harborline.operators import series as S
from harborline.plans import report_queries as P
from harborline.plans.series_queries import IN_ENV, KEYS, LIMITS, r6, with_series, yoy_of
from harborline.registry import query
from harborline.sources import sinks, tables
from harborline.sources.sinks import kept


def folder(spark, name: str) -> str:
    return f"{sinks.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_b3_refresh", with_series("SELECT group_name, scope, flow, month_idx, round(value_current, 6) AS value_current, round(value_prior, 6) AS value_prior, round(value_yoy, 6) AS value_yoy, round(kg_cov, 6) AS kg_cov, low_base, CAST(missing AS BIGINT) AS missing FROM yoy"))
def refreshed(spark, sf):
    """A state built while one month was otherwise and another lacked a country; then both months are taken in."""
    now = frame(spark, sf, "facts")
    once = now.where("not (month_idx = 24000 and reporter = 'N03')").withColumn("value_eur", F.when(F.col("month_idx") == 23990, F.col("value_eur") * 2).otherwise(F.col("value_eur")).cast("decimal(18,2)"))
    patterns, path = frame(spark, sf, "group_patterns"), folder(spark, "state")
    I.build(spark, path, once, patterns, ENVELOPE, UK, limits=LIMITS)
    I.refresh(spark, path, now, [23990, 24000], patterns, ENVELOPE, UK, "1", LIMITS)
    y = tables.read_keyed(spark, f"{path}/yoy")
    return y.select(*KEYS, "month_idx", r6("value_current"), r6("value_prior"), r6("value_yoy"), r6("kg_cov"), "low_base", "missing")


@query("s9_clustered_layout", duck(f"SELECT flow, month_idx, round(CAST(SUM(value_eur) AS DOUBLE), 6) AS value, CAST(COUNT(*) AS BIGINT) AS n_rows FROM facts WHERE {IN_ENV} AND starts_with(product_nc, '1402') GROUP BY 1, 2", "facts"))
def clustered(spark, sf):
    """Facts in folders by flow, sorted by partner and code; a heading's monthly totals through pushed filters."""
    path = folder(spark, "clustered")
    facts = frame(spark, sf, "facts").select("flow", "partner", "product_nc", "month_idx", "value_eur", "quantity_kg")
    tables.write_clustered(facts, path, ["flow"], ["partner", "product_nc"], 16, 1 << 20)
    rows = spark.read.parquet(path).where(X.in_envelope("partner", ENVELOPE) & F.col("product_nc").startswith("1402"))
    return S.monthly_totals(rows, ["flow"]).select("flow", "month_idx", r6("value"), "n_rows")


RAW = """SELECT month_idx AS period, reporter, partner, 'E' AS trade_type, product_nc, CASE WHEN flow = 1 THEN substr(product_nc, 1, 3) END AS product_sitc, substr(product_nc, 1, 4) AS product_cpa21,
    CASE WHEN month_idx % 2 = 0 THEN substr(product_nc, 1, 5) END AS product_cpa22, substr(product_nc, 1, 2) AS product_bec, CAST(NULL AS STRING) AS product_bec5, substr(product_nc, 2, 2) AS product_section, flow,
    CASE WHEN stat_procedure = '3' THEN NULL ELSE stat_procedure END AS stat_procedure, CASE WHEN month_idx % 5 = 0 THEN 'NAR' END AS suppl_unit, value_eur"""


@query("q3_duplicate_raw_rows", duck("SELECT " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '') AS {c}" for c in Q.RAW_KEY) + f", CAST(COUNT(*) AS BIGINT) AS n FROM ({RAW} FROM facts UNION ALL {RAW} FROM facts WHERE suppression_index = 1) r GROUP BY ALL HAVING COUNT(*) > 1", "facts"))
def duplicates(spark, sf):
    """Raw rows of which the suppressed ones came twice: keys of 14 columns that repeat."""
    facts = frame(spark, sf, "facts")
    raw = spark.sql(f"{RAW} FROM {{facts}} UNION ALL {RAW} FROM {{facts}} WHERE suppression_index = 1", facts=facts)
    return Q.duplicate_keys(raw, Q.RAW_KEY)


#: Fifty thresholds of each kind and the default among them.
SWEEPS = {"low_base": ([i * 4e5 for i in range(1, 51)], 6e6, True), "kg_coverage": ([i / 50 for i in range(1, 51)], 0.8, True), "z": ([i / 10 for i in range(1, 51)], 1.5, False)}
SWEPT = {
    "marks": "SELECT 'low_base' AS measure, least(value_current, value_prior) AS v FROM yoy UNION ALL SELECT 'kg_coverage', kg_cov FROM yoy UNION ALL SELECT 'z', abs(z) FROM z",
    "edges": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {x!r}::DOUBLE, {d!r}::DOUBLE, {str(u).lower()})" for m, (t, d, u) in SWEEPS.items() for x in sorted({*t, d})) + ") AS e(measure, threshold, standard, under)",
    "swept": "SELECT measure, threshold, standard, COUNT(*) FILTER (WHERE CASE WHEN under THEN v < threshold ELSE v >= threshold END) AS n, COUNT(*) FILTER (WHERE CASE WHEN under THEN v < standard ELSE v >= standard END) AS n0, COUNT(*) AS total FROM edges JOIN marks USING (measure) WHERE v IS NOT NULL GROUP BY 1, 2, 3",
}


@query("q15_three_sweeps", duck("SELECT measure, threshold, CAST(n AS BIGINT) AS n, round(n / total, 6) AS share, CAST(n - n0 AS BIGINT) AS change FROM swept", "facts", "group_patterns", *P.MIRROR_TABLES, **P.CTES, **P.MIRROR, z=P.Z, **SWEPT))
def sweeps(spark, sf):
    """Findings under fifty low-base floors and coverage shares, and z-scores at fifty and above, in one pass over both."""
    y = yoy_of(spark, sf).select(F.least("value_current", "value_prior").alias("low_base"), F.col("kg_cov").alias("kg_coverage"), F.lit(None).cast("double").alias("z"))
    none = F.lit(None).cast("double")
    z = A.mirror_zscore(P.gaps_of(spark, sf), threshold=0.0).select(none.alias("low_base"), none.alias("kg_coverage"), F.abs("z").alias("z"))
    swept = Q.threshold_sweeps(y.unionByName(z), {m: (m, t, d, u) for m, (t, d, u) in SWEEPS.items()})
    return swept.select("measure", "threshold", "n", r6("share"), "change")


@query("q15_flip_zone", with_series("""SELECT group_name, scope, flow, month_idx, round(v, 6) AS value, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_keys AS BIGINT) AS n_keys FROM (
    SELECT *, SUM(rows_of) OVER () AS n_rows, COUNT(*) OVER () AS n_keys, row_number() OVER (ORDER BY v, group_name, scope, flow) AS rk FROM (
      SELECT group_name, scope, flow, COUNT(*) AS rows_of, MAX(month_idx) AS month_idx, arg_max(m, month_idx) AS v FROM (SELECT *, least(value_current, value_prior) AS m FROM yoy) a WHERE m >= 4e5 AND m < 2e7 GROUP BY 1, 2, 3) b) c WHERE rk <= 20"""))
def flips(spark, sf):
    """Groups whose low-base mark depends on the floor between the lowest and the highest of the sweep."""
    rows = yoy_of(spark, sf).select(*KEYS, "month_idx", F.least("value_current", "value_prior").alias("m"))
    return Q.flip_zone(rows, KEYS, "m", 4e5, 2e7).select(*KEYS, "month_idx", r6("value"), "n_rows", "n_keys")


SHOWN = f"SELECT * FROM facts WHERE product_nc <> '000TOTAL' AND (reporter <> '{UK}' OR suppression_index = 0)"


@query("q17_stored_filters", with_series(f"""SELECT family, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE month_idx % 10 <> 0) AS BIGINT) AS n_match FROM (
    SELECT 'group' AS family, month_idx FROM yoy WHERE scope <> 'eu_27_plus_uk' UNION ALL
    SELECT 'reporter', month_idx FROM (SELECT DISTINCT reporter, flow, month_idx FROM ({SHOWN}) s WHERE {IN_ENV}) a UNION ALL
    SELECT 'heading', month_idx FROM (SELECT DISTINCT substr(product_nc, 1, 4), flow, month_idx FROM ({SHOWN}) s) b) c GROUP BY 1"""))
def stored_filters(spark, sf):
    """Findings of three families, some falsified, each with its filter as rows; all are replayed by the same joins."""
    facts = frame(spark, sf, "facts")
    shown = facts.where((F.col("product_nc") != X.TOTAL_CODE) & ((F.col("reporter") != UK) | (F.col("suppression_index") == 0)))
    cells = sinks.written(shown.groupBy("reporter", "partner", "product_nc", "flow", "month_idx").agg(F.sum("value_eur").alias("value")))
    false = F.when(F.col("month_idx") % 10 == 0, 1.01).otherwise(1.0)
    columns = ["family", "finding_id", "flow", "month_idx", "value_current", "partners", "reporters", "not_reporters", "prefixes"]

    def family(df, name, keys, partners=None, reporters=None, not_reporters=None, prefixes=None):
        none = F.lit(None).cast("array<string>")
        rows = df.withColumn("family", F.lit(name)).withColumn("finding_id", F.concat_ws("|", "family", *keys, "flow", "month_idx")).withColumn("value_current", F.col("value_current") * false)
        for c, v in (("partners", partners), ("reporters", reporters), ("not_reporters", not_reporters), ("prefixes", prefixes)):
            rows = rows.withColumn(c, none if v is None else v)
        return rows.select(*columns)

    envelope, uk = F.array(*map(F.lit, ENVELOPE)), F.array(F.lit(UK))
    of_group = frame(spark, sf, "group_patterns").groupBy("group_name").agg(F.collect_set("prefix").alias("p"))
    groups = yoy_of(spark, sf).where("scope <> 'eu_27_plus_uk'").join(of_group, "group_name")
    rolling = lambda rows, key: S.rolling_pair(S.monthly_totals(rows.withColumn("quantity_kg", F.lit(0)), [key, "flow"], "value"), [key, "flow"], ["value"])
    reporters = rolling(cells.where(X.in_envelope("partner", ENVELOPE)), "reporter")
    headings = rolling(cells.withColumn("heading", F.substring("product_nc", 1, 4)), "heading")
    found = kept(
        family(groups, "group", ["group_name", "scope"], envelope, F.when(F.col("scope") == "uk", uk), F.when(F.col("scope") == "eu_27", uk), F.col("p"))
        .unionByName(family(reporters, "reporter", ["reporter"], envelope, F.array("reporter")))
        .unionByName(family(headings, "heading", ["heading"], prefixes=F.array("heading")))
    )
    filters = kept(V.stored(found, partner=F.col("partners"), reporter=F.col("reporters"), not_reporter=F.col("not_reporters"), prefix=F.col("prefixes")))
    findings = found.select("finding_id", "flow", (F.col("month_idx") - 11).alias("first_idx"), F.col("month_idx").alias("last_idx"), "value_current")
    again = V.replayed(findings, filters, cells).join(found.select("finding_id", "family"), "finding_id")
    return again.groupBy("family").agg(F.count("*").alias("n"), F.count_if("matches").alias("n_match"))
