"""Report sections and cards over finding tables: latest rows, fixed orders, tails and sibling registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import expr as X
from harborline.operators import families as A
from harborline.operators import ranking as K
from harborline.operators import relational as R
from harborline.operators import series as S
from harborline.sources.sinks import kept

KEYS = ["group_name", "scope", "flow"]
#: Fixed order of shapes in the trajectory section: stories first, then directions, then the rest.
SHAPE_ORDER = (
    "dip_recovery", "failed_recovery", "u_recovery", "inverse_u_peak", "rising_accelerating", "falling_accelerating", "rising", "falling",
    "rising_decelerating", "falling_decelerating", "volatile", "flat", "insufficient_data",
)


def top_bilateral_movers(bilateral: DataFrame, least: float = 0.05, k: int = 5) -> DataFrame:
    rows = R.at_latest_anchor(bilateral, []).where(F.abs("value_yoy") >= least)
    return rows.orderBy(F.desc(F.abs("value_yoy")), "label", "flow").limit(k)


def reporter_movers_sheet(breakdown: DataFrame) -> DataFrame:
    """One row per reporter of each group's latest finding, with the low-base mark."""
    return R.at_latest_anchor(breakdown, KEYS).select(*KEYS, "rank", "reporter", "delta", "part_yoy", "share", F.when(F.col("low_base"), "low base").alias("mark"))


def bilateral_sheet(bilateral: DataFrame, bloc: str) -> DataFrame:
    """Latest of each label and flow, the bloc first."""
    rows = R.latest_by(bilateral, ["label", "flow"], F.desc("month_idx"))
    return rows.withColumn("ord", F.when(F.col("label") == bloc, 0).otherwise(1)).orderBy("ord", "label", "flow")


def stability_index(badges: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("green", "yellow", "red", "unscored"))), F.col("badge"))
    return badges.withColumn("ord", order).orderBy("ord", F.desc("persistent_share"))


def biggest_product_mover(movers: DataFrame, parents: DataFrame, held: list[str], surfaced: list[str]) -> DataFrame:
    """The mover with the highest score whose parents are not all held; codes without a surfaced parent come first."""
    groups = parents.groupBy("product_nc").agg(F.array_sort(F.collect_set("group_name")).alias("groups"))
    m = R.not_only_held(movers.where("verdict = 'mover'").join(groups, "product_nc"), "groups", held)
    shown = F.arrays_overlap("groups", F.array(*map(F.lit, surfaced)).cast("array<string>")) if surfaced else F.lit(False)
    m = m.withColumn("surfaced", shown).withColumn("score", K.mover_score("yoy0", "c0"))
    return m.orderBy("surfaced", F.desc("score"), "product_nc").limit(1)


def level_card(series: DataFrame, keys: list[str], value: str, tail: int = 36) -> DataFrame:
    """The latest value of each key and the tail of its series."""
    s = series.withColumn("points", S.series_as_of(keys, value, months=tail))
    return R.latest_by(s, keys, F.desc("month_idx")).select(*keys, "month_idx", F.col(value).alias("level"), "points")


def deficit_by_scope(balance: DataFrame, shares: DataFrame) -> DataFrame:
    """The latest envelope balance of each reporter scope, its monthly series, the single-partner balance and the share of the same month."""
    w = Window.partitionBy("reporter_scope").orderBy("month_idx")
    envelope = balance.where("partner_scope = 'envelope'").withColumn("points", F.collect_list(F.struct("month_idx", "balance_current")).over(w))
    last = R.latest_by(envelope, ["reporter_scope"], F.desc("month_idx"))
    one = balance.where("partner_scope = 'single'").select("reporter_scope", "month_idx", F.col("balance_current").alias("single_balance"))
    share = shares.select("month_idx", F.col("value_share").alias("share"))
    return last.select("reporter_scope", "month_idx", "balance_current", "points").join(one, ["reporter_scope", "month_idx"], "left").join(share, "month_idx", "left")


def sector_detail(yoy_rows: DataFrame, products: DataFrame, breakdown: DataFrame, k: int = 3) -> DataFrame:
    """Findings at each scope's own latest anchor with their first k products and reporters (by share)."""
    last = R.at_latest_anchor(yoy_rows, ["scope"])
    keys = [*KEYS, "month_idx"]
    listed = lambda df, name, order: R.top_k(df, keys, k, *order).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name]).alias(f"{name}s"))
    p = listed(products.drop("rank"), "product_nc", (F.desc("part_current"), F.asc("product_nc")))
    r = listed(breakdown.drop("rank"), "reporter", (F.desc_nulls_last("share"), F.asc("reporter")))
    return last.join(p, keys, "left").join(r, keys, "left")


def state_of_play(rows: DataFrame, keys: list[str]) -> DataFrame:
    return R.latest_by(rows, keys, F.desc("month_idx"))


def mirror_section(gaps: DataFrame, zs: DataFrame) -> DataFrame:
    """The latest month with each partner's latest z; the bloc first, then by excess."""
    z = R.latest_by(zs, ["partner"], F.desc("month_idx")).select("partner", "z")
    m = R.at_latest_anchor(gaps.where("skip is null"), []).join(z, "partner", "left")
    return m.withColumn("ord", F.when(F.col("partner").startswith("BLOC:"), 0).otherwise(1)).orderBy("ord", F.desc_nulls_last("excess"), "partner")


def share_section(shares: DataFrame) -> DataFrame:
    return R.latest_by(shares, ["group_name"], F.desc("month_idx")).orderBy(F.desc("value_share"), "group_name")


def bloc_macro(blocs: DataFrame, world: str) -> DataFrame:
    """The latest month of each flow; the world first, then by size."""
    m = R.at_latest_anchor(blocs, ["flow"])
    return m.withColumn("ord", F.when(F.col("label") == world, 0).otherwise(1)).orderBy("flow", "ord", F.desc("value_current"))


def trajectory_section(shapes: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SHAPE_ORDER)), F.col("shape"))
    return shapes.withColumn("shape_rank", rank).orderBy("scope", "shape_rank", "group_name", "flow")


def bilateral_section(bilateral: DataFrame) -> DataFrame:
    """Both flows of each partner's latest anchor in three registers, the balance, and a note of missing or combined months; the largest first."""
    last = R.at_latest_anchor(bilateral, ["label"])
    side = lambda f, c: F.max(F.when(F.col("flow") == f, F.col(c)))
    note = F.when(F.max(F.col("jan_feb_combined").cast("int")) == 1, "January and February combined").when(F.max(F.col("partial_window").cast("int")) == 1, "months missing")
    registers = [side(f, c).alias(f"{n}{f}s") for c, n in (("value_current", ""), ("ytd", "ytd_"), ("value", "month_")) for f in ("export", "import")]
    s = last.groupBy("label", "month_idx").agg(*registers, note.alias("note")).withColumn("balance", F.col("exports") - F.col("imports"))
    return s.orderBy(F.desc(F.coalesce("exports", F.lit(0.0)) + F.coalesce("imports", F.lit(0.0))), "label")


def finding_counts(findings: DataFrame, by: Column | str = "subkind") -> DataFrame:
    return findings.groupBy(X.col(by).alias("subkind")).agg(F.count("*").alias("n"), F.min("month_idx").alias("first_idx"), F.max("month_idx").alias("last_idx"))


def finding_months(findings: DataFrame, keys: list[str], monthly: DataFrame, rates: DataFrame, months: int = 24) -> DataFrame:
    """Every month inside a finding's windows with its value and the rate that applied."""
    f = findings.select(*keys, F.col("month_idx").alias("anchor"), F.explode(F.sequence(F.col("month_idx") - (months - 1), F.col("month_idx"))).alias("month_idx"))
    m = f.join(monthly, [*keys, "month_idx"]).withColumn("currency", F.lit("CNY"))
    return R.asof_rate(m, rates, "currency")


def annual_by_region(annual: DataFrame) -> DataFrame:
    """Exports, imports and balance of each label and year; the balance needs both sides."""
    side = lambda f: F.max(F.when(F.col("flow") == f, F.col("annual")))
    a = annual.groupBy("label", "year").agg(side("export").alias("exports"), side("import").alias("imports"), F.bool_or("partial").alias("partial"))
    return a.withColumn("balance", F.col("exports") - F.col("imports"))


def new_releases_since(releases: DataFrame, mark: Column) -> DataFrame:
    return releases.where(F.col("first_seen_at") > mark)


def report(facts: DataFrame, patterns: DataFrame, envelope: tuple[str, ...], uk: str, limits: A.Limits = A.Limits()) -> dict[str, DataFrame]:
    """The main sheets by name, ready for `sinks.write_report`; the YoY table is computed once."""
    yoy = kept(A.group_yoy(A.group_series(facts, patterns, envelope, uk), limits))
    badges = K.stability_badge(K.stability_pairs(yoy))
    return {
        "hs_yoy": K.latest_sheet(yoy, KEYS, ["value_yoy", "kg_yoy", "low_base", "fragile"]), "trajectories": A.trajectory(yoy, limits=limits), "stability_index": stability_index(badges),
        "low_base_review": K.low_base_review(yoy), "reporter_movers": reporter_movers_sheet(A.reporter_breakdown(yoy, facts, patterns, envelope, uk, limits=limits)),
    }
