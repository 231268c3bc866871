"""Analysis families: each is one plan over all groups, scopes, flows and anchors.

Facts are reduced to months per key before any window, so windows see a few hundred rows per key
however many facts there are.  Thresholds are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import expr as X
from harborline.operators import idsets as I
from harborline.operators import relational as R
from harborline.operators import series as S
from harborline.sources.sinks import written

KEYS = ["group_name", "scope", "flow"]
#: Months of parts that a task puts into windows.
PART_ROWS = 250_000


@dataclass(frozen=True)
class Limits:
    low_base: float = 5_000_000.0
    reporter_low_base: float = 500_000.0
    kg_coverage: float = 0.80
    mover_floor: float = 2_000.0
    mover_yoy: float = 0.25
    mover_months: int = 10
    mover_anchor_yoy: float = 0.10
    mover_leave_out: float = 0.15
    top_floor: float = 1_000_000.0
    flat_mean: float = 0.02
    flat_std: float = 0.05
    slope: float = 0.005
    seasonal: float = 0.5
    least_windows: int = 6


def published_by_both(facts: DataFrame, uk: str, *keys: str) -> DataFrame:
    """keys, month_idx that both sources published, whatever the group: one row per month and key at most."""
    is_uk = (F.col("reporter") == uk).cast("int")
    both = facts.groupBy(*keys, "month_idx").agg(F.max(is_uk).alias("by_uk"), F.min(is_uk).alias("by_eu"))
    return both.where("by_uk = 1 and by_eu = 0").select(*keys, "month_idx")


def all_goods(facts: DataFrame, uk: str) -> DataFrame:
    """Rows that sum to all goods: the total rows of sources that have them, the detail rows of the one that has none.

    Detail and total rows side by side would count every value twice.
    """
    is_total = F.col("product_nc") == X.TOTAL_CODE
    return facts.where(F.when(F.col("reporter") == uk, ~is_total & (F.col("suppression_index") == 0)).otherwise(is_total))


def scoped(facts: DataFrame, envelope: tuple[str, ...], uk: str) -> DataFrame:
    """Envelope detail rows with `scope`: each source's own and the combined one, without suppressed rows.

    The combined scope keeps months that both sources published, judged without regard to groups.
    """
    is_uk = F.col("reporter") == uk
    rows = facts.where(X.in_envelope("partner", envelope) & (F.col("product_nc") != X.TOTAL_CODE) & (~is_uk | (F.col("suppression_index") == 0)))
    # a row per flow and calendar month: its size does not depend on the facts
    both = F.broadcast(published_by_both(facts, uk, "flow").withColumn("_both", F.lit(True)))
    scopes = F.array_compact(F.array(F.when(is_uk, "uk").otherwise("eu_27"), F.when(F.col("_both"), "eu_27_plus_uk")))
    return rows.join(both, ["flow", "month_idx"], "left").withColumn("scope", F.explode(scopes)).drop("_both")


def code_totals(facts: DataFrame, envelope: tuple[str, ...], uk: str) -> DataFrame:
    """Exact monthly sums of each code, scope and flow; those of a month follow from that month's facts alone."""
    return scoped(facts, envelope, uk).groupBy("product_nc", "scope", "flow", "month_idx").agg(
        F.sum("value_eur").alias("value_eur"), F.sum("quantity_kg").alias("quantity_kg"), F.sum(F.when(F.col("quantity_kg") > 0, F.col("value_eur"))).alias("with_kg"), F.count("*").alias("rows")
    )


def series_of_codes(codes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Monthly totals of each group, scope and flow from those of codes."""
    double = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return R.assign_groups(codes, patterns).groupBy(*KEYS, "month_idx").agg(
        double("value_eur").alias("value"), double("quantity_kg").alias("kg"), double("with_kg").alias("value_with_kg"), F.sum("rows").alias("n_rows")
    )


def group_series(facts: DataFrame, patterns: DataFrame, envelope: tuple[str, ...], uk: str) -> DataFrame:
    """Monthly totals of each group, scope and flow, as `series_of_codes` of `code_totals` gives them; each task sums its own rows to these few
    totals, so nothing of the facts' size is shuffled."""
    rows = R.assign_groups(scoped(facts, envelope, uk).select("product_nc", "scope", "flow", "month_idx", "value_eur", "quantity_kg"), patterns)
    double = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    with_kg = F.when(F.col("quantity_kg") > 0, F.col("value_eur"))
    return rows.groupBy(*KEYS, "month_idx").agg(double("value_eur").alias("value"), double("quantity_kg").alias("kg"), double(with_kg).alias("value_with_kg"), F.count("*").alias("n_rows"))


def group_yoy(series: DataFrame, limits: Limits = Limits(), most_missing: int = 1) -> DataFrame:
    """Rolling 12-month changes of value, weight and unit price; single and two-month registers; flags."""
    s = S.rolling_pair(series, KEYS, ["value", "kg", "value_with_kg"])
    s = S.two_month(S.single_month(s, KEYS), KEYS)
    missing = F.lit(24) - F.col("n_current") - F.col("n_prior")
    s = s.where((missing <= most_missing) & (F.col("value_prior") != 0)).withColumn("missing", missing)
    cov = lambda half: X.kg_coverage(f"value_with_kg_{half}", f"value_{half}")
    s = s.withColumn("kg_cov", F.least(cov("current"), cov("prior")))
    s = s.withColumn("value_yoy", X.yoy("value_current", "value_prior")).withColumn("kg_yoy", X.yoy("kg_current", "kg_prior"))
    for half in ("current", "prior"):
        s = s.withColumn(f"price_{half}", X.unit_price(f"value_with_kg_{half}", f"kg_{half}", "kg_cov", limits.kg_coverage))
    s = s.withColumn("price_yoy", X.yoy("price_current", "price_prior"))
    return (
        s.withColumn("low_base", X.low_base("value_current", "value_prior", limits.low_base)).withColumn("partial_window", F.col("missing") > 0)
        .withColumn("fragile", X.fragile("value_current", "value_prior", limits.low_base)).withColumn("driver", X.driver_label("kg_yoy", "value_yoy"))
    )


def yoy_caveats(s: DataFrame, limits: Limits = Limits()) -> Column:
    """Sorted caveat codes of a group-YoY row, without the universal ones."""
    marks = [(F.col("low_base"), "low_base_effect"), (F.col("kg_cov") < limits.kg_coverage, "low_kg_coverage"), (F.col("partial_window"), "partial_window"), (F.col("scope") == "eu_27_plus_uk", "cross_source_sum")]
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in marks))))


def windowed_parts(facts: DataFrame, patterns: DataFrame, anchors: DataFrame, part: str, envelope: tuple[str, ...], uk: str) -> DataFrame:
    """Two-window sums of each `part` (reporter, product) of a group at every anchor (KEYS, month_idx).

    A part without a row in the anchor month still has its windows: a spine of months from its first to 23 after its last
    row stands beside its sums, and one sort serves both range frames.  Months that no anchor's windows hold, and spine months that
    are outside the anchors of the group, are left out; a task gets about PART_ROWS of the rows, as its spine is up to 24 times as large.
    """
    anchors = written(anchors)  # a row a group and month
    bounds = anchors.groupBy(*KEYS).agg(F.min("month_idx").alias("_first"), F.max("month_idx").alias("_last"))
    rows = R.assign_groups(scoped(facts, envelope, uk).select("product_nc", *({part} - {"product_nc"}), "scope", "flow", "month_idx", "value_eur", "quantity_kg"), patterns)
    rows = rows.join(written(bounds), KEYS).where(F.col("month_idx").between(F.col("_first") - 23, F.col("_last")))
    months = written(rows.groupBy(*KEYS, part, "month_idx", "_first", "_last").agg(F.sum("value_eur").alias("v"), F.coalesce(F.sum("quantity_kg"), F.lit(0)).alias("k")))
    months = months.repartition(max(1, -(-months.count() // PART_ROWS)), *KEYS, part)
    by = Window.partitionBy(*KEYS, part).orderBy("month_idx")
    # each row stands for its own month and for the months up to the next row, at most 23 on
    until = F.least(F.coalesce(F.lead("month_idx").over(by) - 1, F.col("month_idx") + 23), F.col("month_idx") + 23)
    spine = months.withColumn("_until", until).withColumn("_at", F.explode(F.sequence("month_idx", "_until")))
    own = F.col("_at") == F.col("month_idx")
    spine = spine.where(own | F.col("_at").between(F.col("_first"), F.col("_last")))
    spine = spine.select(*KEYS, part, F.when(own, F.col("v")).alias("v"), F.when(own, F.col("k")).alias("k"), F.col("_at").alias("month_idx"))
    half = lambda c, first, last: F.coalesce(F.sum(c).over(by.rangeBetween(first, last)), F.lit(0)).cast("double")
    sums = spine.select(
        *KEYS, part, "month_idx", half("v", -11, 0).alias("part_current"), half("v", -23, -12).alias("part_prior"), half("k", -11, 0).alias("kg_part_current"), half("k", -23, -12).alias("kg_part_prior")
    )
    return anchors.join(sums, [*KEYS, "month_idx"])


def reporter_breakdown(yoy_rows: DataFrame, facts: DataFrame, patterns: DataFrame, envelope: tuple[str, ...], uk: str, k: int = 10, limits: Limits = Limits()) -> DataFrame:
    """Reporters of each finding ranked by the size of their change, with their share of the group's change."""
    anchors = yoy_rows.select(*KEYS, "month_idx", (F.col("value_current") - F.col("value_prior")).alias("group_delta"))
    p = windowed_parts(facts, patterns, anchors, "reporter", envelope, uk).withColumn("delta", F.col("part_current") - F.col("part_prior"))
    p = p.withColumn("part_yoy", X.yoy("part_current", "part_prior")).withColumn("kg_part_yoy", X.yoy("kg_part_current", "kg_part_prior"))
    p = p.withColumn("share", F.when(F.col("group_delta") != 0, F.col("delta") / F.col("group_delta"))).withColumn("low_base", F.col("part_prior") < limits.reporter_low_base)
    return R.top_k(p, [*KEYS, "month_idx"], k, F.desc(F.abs("delta")), F.asc("reporter"))


def top_products(yoy_rows: DataFrame, facts: DataFrame, patterns: DataFrame, envelope: tuple[str, ...], uk: str, k: int = 10) -> DataFrame:
    """The largest codes of each finding's current window, ranked after sources are merged."""
    p = windowed_parts(facts, patterns, yoy_rows.select(*KEYS, "month_idx"), "product_nc", envelope, uk).where("part_current > 0")
    return R.top_k(p, [*KEYS, "month_idx"], k, F.desc("part_current"), F.asc("product_nc"))


def product_mover(codes: DataFrame, limits: Limits = Limits(), key: str = "product_nc") -> DataFrame:
    """Five gates at the latest month for each code of a monthly series (key, month_idx, value); one aggregate.

    verdict is `mover` or the first gate that failed.
    """
    last = codes.agg(F.max("month_idx").alias("last"))
    s = codes.join(F.broadcast(last)).withColumn("back", F.col("last") - F.col("month_idx")).where("back < 26")
    aggs = []
    for a in range(3):
        for name, lo in (("c", a), ("p", a + 12)):
            inside = F.col("back").between(lo, lo + 11)
            aggs += [F.coalesce(F.sum(F.when(inside, F.col("value"))), F.lit(0.0)).alias(f"{name}{a}"), F.count(F.when(inside, 1)).alias(f"n{name}{a}")]
    peak = lambda lo: F.coalesce(F.max(F.when(F.col("back").between(lo, lo + 11), F.col("value"))), F.lit(0.0))
    t = s.groupBy(key).agg(F.first("last").alias("last"), *aggs, peak(0).alias("peak_c"), peak(12).alias("peak_p"))
    change = lambda c, p: F.when(p > 0, (c - p) / p)
    for a in range(3):
        t = t.withColumn(f"yoy{a}", change(F.col(f"c{a}"), F.col(f"p{a}")))
    left = F.when(F.col("yoy0") > 0, change(F.col("c0") - F.col("peak_c"), F.col("p0"))).otherwise(change(F.col("c0"), F.col("p0") - F.col("peak_p")))
    t = t.withColumn("leave_out_yoy", left)
    same = lambda x: (F.signum(x) == F.signum("yoy0"))
    steady = [F.coalesce(same(F.col(f"yoy{a}")) & (F.abs(f"yoy{a}") >= limits.mover_anchor_yoy), F.lit(False)) for a in range(3)]
    verdict = (
        F.when((F.col("p0") <= 0) | (F.least("c0", "p0") < limits.mover_floor), "floor")
        .when(F.abs("yoy0") < limits.mover_yoy, "small_change")
        .when((F.col("nc0") < limits.mover_months) | (F.col("np0") < limits.mover_months), "few_months")
        .when(~(steady[0] & steady[1] & steady[2]), "unsteady")
        .when(~F.coalesce(same(F.col("leave_out_yoy")) & (F.abs("leave_out_yoy") >= limits.mover_leave_out), F.lit(False)), "one_month")
        .otherwise("mover")
    )
    return t.withColumn("verdict", verdict)


#: Shapes and their labels.
SHAPES = {
    "flat": "flat", "rising": "sustained rising", "rising_accelerating": "rising, accelerating", "rising_decelerating": "rising, decelerating",
    "falling": "sustained falling", "falling_accelerating": "falling, accelerating", "falling_decelerating": "falling, decelerating",
    "u_recovery": "U-shape recovery (was falling, now rising)", "inverse_u_peak": "peak-and-fall (was rising, now falling)",
    "dip_recovery": "dip-and-recovery (was rising, dipped, now rising again)", "failed_recovery": "failed recovery (was falling, briefly rose, now falling again)",
    "volatile": "volatile (multiple direction changes)", "insufficient_data": "insufficient data to classify",
}


def trajectory(yoy_rows: DataFrame, keys: list[str] = KEYS, value: str = "value_yoy", limits: Limits = Limits(), smooth: int = 3) -> DataFrame:
    """The shape of each key's longest run of YoY windows, with features.

    A run has a few hundred windows at most, so each is one array: slopes, turns and autocorrelation are array functions of it.
    """
    run = S.smooth_centred(S.longest_run(yoy_rows, keys), keys, value, smooth)
    point = F.struct("month_idx", F.col(value).alias("v"), F.col("smooth").alias("s"))
    t = run.groupBy(*keys).agg(
        F.array_sort(F.collect_list(point)).alias("p"), F.count("*").alias("n_windows"), F.max(value).alias("max_yoy"), F.min(value).alias("min_yoy"), F.avg(value).alias("mean_yoy"),
        F.stddev_pop(value).alias("std_yoy"), F.avg(F.abs(value)).alias("mean_abs_yoy"), F.max_by("month_idx", F.struct(value, -F.col("month_idx"))).alias("peak_idx"),
        F.min_by("month_idx", F.struct(value, "month_idx")).alias("trough_idx"), (2 * F.sum(F.col("low_base").cast("int")) >= F.count("*")).alias("low_base_majority"),
        F.min("month_idx").alias("first_idx"), F.max("month_idx").alias("last_idx"),
    ).withColumn("v", F.col("p.v")).withColumn("s", F.col("p.s"))
    half, n = F.floor(F.size("s") / 2).cast("int"), F.size("s")
    signs = F.transform("s", lambda x: F.signum(x).cast("int"))
    t = t.withColumn("signs", signs).withColumn("turning", F.filter("signs", lambda x: x != 0))
    turns = lambda a: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.get(a, i) != F.get(a, i - 1)))
    crossing = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.get("signs", i) * F.get("signs", i - 1)) == -1)
    t = (
        t.withColumn("first_yoy", F.get("v", F.lit(0))).withColumn("last_yoy", F.element_at("v", -1)).withColumn("last_smooth", F.element_at("s", -1))
        .withColumn("sign_changes", turns("turning")).withColumn("cross_zero_idx", F.when(F.col("sign_changes") == 1, F.get(crossing, F.lit(0))))
        .withColumn("slope", S.median_slope(F.col("s"))).withColumn("early_slope", S.median_slope(F.slice("s", F.lit(1), half))).withColumn("late_slope", S.median_slope(F.slice("s", half + 1, n)))
        .withColumn("_line", S.median_slope(F.col("v"))).withColumn("seasonal_strength", S.autocorrelation(F.col("v"), F.col("_line"))).withColumn("seasonal", F.coalesce(F.col("seasonal_strength") >= limits.seasonal, F.lit(False)))
    )
    up, turned, slope = F.col("last_smooth") > 0, F.col("sign_changes"), F.col("slope")
    shape = (
        F.when(F.col("n_windows") < limits.least_windows, "insufficient_data")
        .when((F.col("mean_abs_yoy") < limits.flat_mean) & (F.col("std_yoy") < limits.flat_std), "flat")
        .when(turned == 2, F.when(F.element_at("turning", -1) > 0, "dip_recovery").otherwise("failed_recovery")).when(turned >= 3, "volatile")
        .when(turned == 1, F.when(up, "u_recovery").otherwise("inverse_u_peak"))
        .when(up, F.when(slope > limits.slope, "rising_accelerating").when(slope < -limits.slope, "rising_decelerating").otherwise("rising"))
        .otherwise(F.when(slope < -limits.slope, "falling_accelerating").when(slope > limits.slope, "falling_decelerating").otherwise("falling"))
    )
    label = F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv))
    return t.withColumn("shape", shape).withColumn("shape_label", label[F.col("shape")]).drop("p", "v", "s", "signs", "turning", "_line")


def canonical_exports(exports: DataFrame) -> DataFrame:
    """The pinned edition: monthly CNY exports with a value, latest version of each label and month."""
    pinned = exports.where("currency = 'CNY' and period_kind = 'monthly' and value_amount is not null and flow = 'export'")
    return R.latest_by(pinned, ["label", "month_idx"], F.desc("version_seen"))


def to_eur(df: DataFrame, rates: DataFrame, value: str = "value_amount") -> DataFrame:
    """eur = value x unit scale x the rate on or before the month; null where unit or rate is missing."""
    scaled = df.withColumn("_scale", X.unit_scale("unit")).withColumn("_currency", F.coalesce("_scale.currency", "currency"))
    rated = R.asof_rate(scaled, rates, "_currency")
    return rated.withColumn("eur", F.col(value) * F.col("_scale.multiplier") * F.when(F.col("_currency") == "EUR", 1.0).otherwise(F.col("rate"))).drop("_scale", "_currency")


def importer_totals(facts: DataFrame, envelope: tuple[str, ...], uk: str) -> DataFrame:
    """reporter, month_idx -> declared imports of all goods from the envelope."""
    rows = all_goods(facts, uk).where((F.col("flow") == 1) & X.in_envelope("partner", envelope))
    return rows.groupBy("reporter", "month_idx").agg(F.sum("value_eur").cast("double").alias("imports"))


def mirror_gap(exports: DataFrame, facts: DataFrame, rates: DataFrame, aliases: DataFrame, members: DataFrame, baselines: DataFrame, hubs: DataFrame, envelope: tuple[str, ...], uk: str) -> DataFrame:
    """Exporter-declared against importer-declared values of every partner and month; `skip` names what is missing.

    Single countries compare directly; the one comparable bloc compares with the sum of its members.
    """
    e = R.resolve_country(to_eur(canonical_exports(exports), rates), aliases).where("aggregate_kind is null or aggregate_kind = 'eu_bloc'")
    e = e.withColumn("partner", F.coalesce("iso", F.concat(F.lit("BLOC:"), F.col("aggregate_kind"))))
    imports = importer_totals(facts, envelope, uk)
    single = e.where("aggregate_kind is null").withColumn("member", F.col("iso"))
    bloc = R.members_at(e.where("aggregate_kind is not null"), members)
    both = single.unionByName(bloc).join(imports.withColumnRenamed("reporter", "member"), ["member", "month_idx"], "left")
    g = both.groupBy("partner", "month_idx", "eur", "unit", "rate").agg(F.sum("imports").alias("imports"), F.count("imports").alias("n_members"))
    g = R.hub_flag(R.baseline_for(g, baselines, "partner"), hubs, "partner")
    biggest = F.greatest(F.abs("imports"), F.abs("eur"))
    g = g.withColumn("gap", F.col("imports") - F.col("eur")).withColumn("gap_pct", F.when(biggest > 0, F.col("gap") / biggest))
    g = g.withColumn("excess", F.when(F.col("gap_pct") > 0, F.col("gap_pct") - F.col("baseline")))
    skip = F.when(X.unit_scale("unit").isNull(), "bad_unit").when(F.col("rate").isNull(), "no_rate").when(F.col("imports").isNull(), "no_counterpart_data")
    bloc_mark = F.when(F.col("partner").startswith("BLOC:"), F.lit("aggregate_composition"))
    return g.withColumn("skip", skip).withColumn("caveats", F.array_compact(F.array(bloc_mark, F.when(F.col("is_hub"), F.lit("transshipment_hub")))))


def mirror_zscore(gaps: DataFrame, n: int = 6, threshold: float = 1.5) -> DataFrame:
    """Months whose gap stands out from the partner's previous n gaps."""
    z = S.rolling_zscore(gaps.where("skip is null"), ["partner"], "gap_pct", n)
    return z.where(F.abs("z") >= threshold).withColumn("low_baseline_n", F.col("base_n") < n)


def partner_yoy(monthly: DataFrame, chunks: DataFrame, keys: list[str], ytd: DataFrame | None = None, least: int = 8) -> DataFrame:
    """Bloc or bilateral YoY in three registers: rolling 12 months, the single month, and the published year to date.

    Combined January-February chunks count in the windows; at least `least` of 12 months in either half.  ytd: keys, month_idx, ytd.
    """
    s = S.single_month(S.add_jan_feb(monthly, chunks, keys), keys).where((F.col("n_current") >= least) & (F.col("n_prior") >= least) & (F.col("value_prior") != 0))
    s = s.withColumn("value_yoy", X.yoy("value_current", "value_prior")).withColumn("partial_window", (F.col("n_current") < 12) | (F.col("n_prior") < 12)).withColumn("jan_feb_combined", F.col("chunks_current") + F.col("chunks_prior") > 0)
    marks = F.array(F.when(F.col("jan_feb_combined"), F.lit("jan_feb_combined")), F.when(F.col("partial_window"), F.lit("partial_window")))
    s = s.withColumn("caveats", F.array_compact(marks))
    return s if ytd is None else s.join(S.ytd_published(ytd, keys, "ytd").select(*keys, "month_idx", "ytd", "ytd_prior", "ytd_yoy"), [*keys, "month_idx"], "left")


def balance_series(facts: DataFrame, envelope: tuple[str, ...], single: str, uk: str) -> DataFrame:
    """reporter_scope, partner_scope, month_idx -> imports, exports, balance of all goods on months with both flows.

    The combined scope has the months for which both sources have both flows.
    """
    is_uk = F.col("reporter") == uk
    rows = all_goods(facts, uk).where(X.in_envelope("partner", envelope))
    rows = rows.withColumn("reporter_scope", F.explode(F.array(F.when(is_uk, "uk").otherwise("eu_27"), F.lit("eu_27_plus_uk"))))
    rows = rows.withColumn("partner_scope", F.explode(F.when(F.col("partner") == single, F.array(F.lit("envelope"), F.lit("single"))).otherwise(F.array(F.lit("envelope")))))
    by = lambda f, c: F.sum(F.when((F.col("flow") == f) & c, F.col("value_eur")))
    sides = [by(f, c).alias(n) for f, n_ in ((1, "imports"), (2, "exports")) for c, n in ((is_uk, f"uk_{n_}"), (~is_uk, f"eu_{n_}"))]
    s = rows.groupBy("reporter_scope", "partner_scope", "month_idx").agg(*sides)
    zero = lambda c: F.coalesce(c, F.lit(0))
    for n in ("imports", "exports"):
        eu, own = F.col(f"eu_{n}"), F.col(f"uk_{n}")
        whole = F.when(F.col("reporter_scope") == "eu_27_plus_uk", eu.isNotNull() & own.isNotNull()).otherwise(eu.isNotNull() | own.isNotNull())
        s = s.withColumn(n, F.when(whole, zero(eu) + zero(own)).cast("double"))
    s = s.where("imports is not null and exports is not null").select("reporter_scope", "partner_scope", "month_idx", "imports", "exports")
    return s.withColumn("balance", F.col("imports") - F.col("exports"))


def trade_balance(series: DataFrame, months: int = 12) -> DataFrame:
    """Rolling balance (whole windows only), its change, computed year to date and value per day."""
    keys = ["reporter_scope", "partner_scope"]
    s = S.ytd_computed(S.rolling_pair(series, keys, ["balance", "imports", "exports"], months), keys, "balance").where(F.col("n_current") == months)
    s = s.withColumn("balance_yoy", F.when(F.col("n_prior") == months, X.yoy("balance_current", "balance_prior")))
    return s.withColumn("per_day", X.per_day("balance_current", F.col("month_idx") - (months - 1), "month_idx"))


def external_totals(facts: DataFrame, members: list[str], keys: list[str]) -> DataFrame:
    """Totals from partners outside the bloc, with the number of partners.

    Keys without product_nc are sums over goods, so the caller chooses detail or total rows (`all_goods`).
    """
    rows = facts.where(~F.col("partner").isin(*members))
    return rows.groupBy(*keys).agg(F.sum("value_eur").cast("double").alias("value"), F.coalesce(F.sum("quantity_kg"), F.lit(0)).cast("double").alias("kg"), F.count_distinct("partner").alias("n_partners"), F.count("*").alias("n_rows"))


def from_total_rows(facts: DataFrame, uk: str) -> DataFrame:
    """The total rows of the sources that have them."""
    return facts.where((F.col("reporter") != uk) & (F.col("product_nc") == X.TOTAL_CODE))


def from_detail_rows(facts: DataFrame, uk: str) -> DataFrame:
    """The detail rows of the source without total rows, suppressed ones left out."""
    return facts.where((F.col("reporter") == uk) & (F.col("product_nc") != X.TOTAL_CODE) & (F.col("suppression_index") == 0))


def allgoods_from_total_row(facts: DataFrame, uk: str, keys: list[str]) -> DataFrame:
    """All goods of the sources with total rows: keys, month_idx -> value; `allgoods_lineage` has the raw rows behind."""
    return from_total_rows(facts, uk).groupBy(*keys, "month_idx").agg(F.sum("value_eur").cast("double").alias("value"))


def allgoods_from_detail(facts: DataFrame, uk: str, keys: list[str]) -> DataFrame:
    """All goods of the source without total rows."""
    return from_detail_rows(facts, uk).groupBy(*keys, "month_idx").agg(F.sum("value_eur").cast("double").alias("value"))


def allgoods_lineage(facts: DataFrame, uk: str, keys: list[str], per_chunk: int = 1024) -> DataFrame:
    """from_detail, keys, month_idx -> sets of raw ids in chunks of bounded size (`idsets`)."""
    rows = from_total_rows(facts, uk).withColumn("from_detail", F.lit(False)).unionByName(from_detail_rows(facts, uk).withColumn("from_detail", F.lit(True)))
    return I.id_sets(rows, ["from_detail", *keys, "month_idx"], "raw_id", per_chunk)


def share_of(num: DataFrame, den: DataFrame, keys: list[str], den_keys: list[str], first_idx: int | None = None) -> DataFrame:
    """Rolling shares by value and weight; whole windows of positive denominators only; score = |pp| + 100 x share.

    difference_pp is the share by weight less the share by value.
    """
    s = S.rolling_share(num, den, keys, den_keys, ["value", "kg"]).where((F.col("n_months") == 12) & F.col("value_share").isNotNull() & F.col("kg_share").isNotNull())
    s = s if first_idx is None else s.where(F.col("month_idx") >= first_idx)
    s = s.withColumn("difference_pp", (F.col("kg_share") - F.col("value_share")) * 100)
    return s.withColumn("score", F.abs("difference_pp") + 100 * F.col("value_share"))


def allgoods_share(facts: DataFrame, members: list[str], envelope: tuple[str, ...], single: str, uk: str, first_idx: int) -> DataFrame:
    """flow, month_idx -> rolling share of the envelope in extra-bloc trade of the sources with total rows, and of one partner.

    Months from first_idx on; 12 of 12 months on both sides; the single partner's share is null where it lacks months;
    `points` is the series as of each month.
    """
    rows = facts.where((F.col("reporter") != uk) & (F.col("product_nc") == X.TOTAL_CODE))
    sums = rows.groupBy("flow", "month_idx").agg(
        *(F.sum(F.when(c, F.col("value_eur"))).cast("double").alias(n) for n, c in (("env", X.in_envelope("partner", envelope)), ("one", F.col("partner") == single), ("den", ~F.col("partner").isin(*members))))
    )
    w = S.over_months(["flow"], -11, 0)
    whole = lambda c: F.count(c).over(w) == 12
    total = lambda c: F.sum(c).over(w)
    s = sums.withColumn("_env", F.when(whole("env") & whole("den") & (total("den") > 0), total("env") / total("den"))).withColumn("_one", F.when(whole("one"), total("one") / total("den")))
    s = s.where((F.col("month_idx") >= first_idx) & F.col("_env").isNotNull() & F.col("env").isNotNull()).select("flow", "month_idx", F.col("_env").alias("value_share"), F.col("_one").alias("single_share"))
    return s.withColumn("points", F.array_sort(F.collect_list(F.struct("month_idx", "value_share")).over(Window.partitionBy("flow").orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0))))


def partner_balance(bilateral: DataFrame, current: str = "value_current", prior: str = "value_prior") -> DataFrame:
    """Exports less imports of each partner and anchor; YoY null on a low base, a sign flip or |yoy| >= 5."""
    side = lambda f, c: F.max(F.when(F.col("flow") == f, F.col(c)))
    b = bilateral.groupBy("partner", "month_idx").agg((side(2, current) - side(1, current)).alias("balance"), (side(2, prior) - side(1, prior)).alias("balance_prior"))
    change = X.yoy(F.abs("balance"), F.abs("balance_prior"))
    flip = F.signum("balance") != F.signum("balance_prior")
    return b.where("balance is not null").withColumn("balance_yoy", F.when(F.coalesce(F.col("balance_prior"), F.lit(0.0)).__ne__(0) & ~flip & (F.abs(change) < 5), change))


def trade_map(codes: DataFrame, divisions: DataFrame, grouped: DataFrame) -> DataFrame:
    """Value per division with shares, an explicit unclassified bucket, and the share covered by any group.

    codes: product_nc, value; divisions: product_nc, division; grouped: product_nc of any group.
    """
    c = codes.where(X.is_detail_code("product_nc")).join(divisions, "product_nc", "left").join(grouped.distinct().withColumn("_in", F.lit(True)), "product_nc", "left")
    d = c.groupBy(F.coalesce("division", F.lit("unclassified")).alias("division")).agg(F.sum("value").alias("value"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("value"))), F.lit(0.0)).alias("covered"), F.count_distinct("product_nc").alias("n_codes"))
    total = d.agg(F.sum("value").alias("_t"))
    return d.join(F.broadcast(total)).select("division", "value", (F.col("value") / F.col("_t")).alias("share"), (F.col("covered") / F.col("value")).alias("covered_share"), "n_codes")


def group_facets(patterns: DataFrame, codes: DataFrame) -> DataFrame:
    """Divisions that a group spans (codes: product_nc, division), as a sorted array."""
    return R.assign_groups(codes, patterns).groupBy("group_name").agg(F.array_sort(F.collect_set("division")).alias("facets"))


def theme_rollup(codes: DataFrame, themes: DataFrame) -> DataFrame:
    """Value per theme; themes overlap and are never totalled.  themes: theme, prefix; codes: product_nc, value."""
    pairs = R.group_codes(codes, themes.select(F.col("theme").alias("group_name"), "prefix"))
    return codes.join(pairs.select("product_nc", "group_name").distinct(), "product_nc").groupBy(F.col("group_name").alias("theme")).agg(F.sum("value").alias("value"))


def chart_series(series: DataFrame, keys: list[str], anchors: DataFrame, months: int = 24) -> DataFrame:
    """A dense series of the months up to each key's anchor; absent months are null."""
    spine = anchors.select(*keys, F.explode(F.sequence(F.col("anchor") - (months - 1), F.col("anchor"))).alias("month_idx"), "anchor")
    return spine.join(series, [*keys, "month_idx"], "left").withColumn("half", F.when(F.col("anchor") - F.col("month_idx") < months // 2, "current").otherwise("prior"))


def cross_check(own: DataFrame, other: DataFrame, keys: list[str], months: int = 12) -> DataFrame:
    """A finding's window per month present against the other declarer's (keys, month_idx, imports) over the same window, and the gap in
    percent of the own side.  Windows of a key are short, so its months are joined by their offset."""
    at = other.select(*keys, F.col("imports"), F.explode(F.sequence("month_idx", F.col("month_idx") + (months - 1))).alias("month_idx"))
    o = at.groupBy(*keys, "month_idx").agg(F.sum("imports").alias("other_current"), F.count("*").alias("other_n"))
    j = own.join(o, [*keys, "month_idx"]).withColumn("own_month", F.col("value_current") / F.col("n_current")).withColumn("other_month", F.col("other_current") / F.col("other_n"))
    return j.where("own_month <> 0").withColumn("gap_pct", (F.col("other_month") - F.col("own_month")) / F.col("own_month"))


def skip_reasons(df: DataFrame, reason: str = "skip") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def staleness(findings: DataFrame, upstream: DataFrame) -> DataFrame:
    """Latest analysed month against the latest upstream month."""
    return findings.agg(F.max("month_idx").alias("analysed")).join(F.broadcast(upstream.agg(F.max("month_idx").alias("upstream")))).withColumn("months_behind", F.col("upstream") - F.col("analysed"))
