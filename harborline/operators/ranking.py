"""Stability, movers, quotability and report tables over finding tables.  Sheets are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import expr as X
from harborline.operators import relational as R

KEYS = ["group_name", "scope", "flow"]


def stability_pairs(yoy_rows: DataFrame, keys: list[str] = KEYS, months: int = 6, shift: float = 0.05) -> DataFrame:
    """Each key's latest YoY against the one `months` before: flips, shifts, persistence."""
    last = yoy_rows.agg(F.max("month_idx").alias("_t"))
    p = yoy_rows.join(F.broadcast(last)).groupBy(*keys).agg(
        F.max(F.when(F.col("month_idx") == F.col("_t"), F.col("value_yoy"))).alias("now"), F.max(F.when(F.col("month_idx") == F.col("_t") - months, F.col("value_yoy"))).alias("then"),
        F.max(F.when(F.col("month_idx") == F.col("_t"), F.col("low_base").cast("int"))).alias("low_now"), F.max(F.when(F.col("month_idx") == F.col("_t") - months, F.col("low_base").cast("int"))).alias("low_then"),
    ).where("now is not null and then is not null")
    flip = F.signum("now") != F.signum("then")
    return p.withColumn("flip", flip).withColumn("shifted", ~flip & (F.abs(F.col("now") - F.col("then")) >= shift)).withColumn("persistent", ~F.col("flip") & ~F.col("shifted"))


def stability_badge(pairs: DataFrame, by: str = "group_name", green: float = 0.67, yellow: float = 0.33, least: int = 3) -> DataFrame:
    b = pairs.groupBy(by).agg(F.count("*").alias("n_pairs"), (F.count_if("persistent") / F.count("*")).alias("persistent_share"))
    return b.withColumn("badge", F.when(F.col("n_pairs") < least, "unscored").when(F.col("persistent_share") >= green, "green").when(F.col("persistent_share") >= yellow, "yellow").otherwise("red"))


def backtest(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.count_if("persistent").alias("n_persistent"), F.count_if("flip").alias("n_flips"), F.count_if("shifted").alias("n_shifts"),
        F.count_if(F.expr("low_now = 1 and low_then = 0")).alias("n_into_low_base"), F.count_if(F.expr("low_now = 0 and low_then = 1")).alias("n_out_of_low_base"),
    )


def mover_score(yoy: Column | str, value: Column | str) -> Column:
    return F.abs(X.col(yoy)) * F.log10(F.greatest(X.col(value), F.lit(1.0)))


def top_movers(yoy_rows: DataFrame, badges: DataFrame, held: DataFrame, floor: float, least: float = 0.10, k: int = 5, scope: str = "eu_27") -> DataFrame:
    """The k highest scores at the latest anchor of a scope: large, moved, not low base, not red, not held."""
    rows = R.at_latest_anchor(yoy_rows.where(F.col("scope") == scope), [])
    rows = rows.where(~F.col("low_base") & (F.col("value_current") >= floor) & (F.abs("value_yoy") >= least))
    rows = rows.join(badges.where("badge = 'red'"), "group_name", "left_anti").join(held, "group_name", "left_anti")
    return rows.withColumn("score", mover_score("value_yoy", "value_current")).orderBy(F.desc("score"), "group_name", "flow").limit(k)


def quotability(rows: DataFrame) -> DataFrame:
    """low base, then red, then fragile, then the badge; with the missing months named."""
    q = F.when(F.col("low_base"), "low_base").when(F.col("badge") == "red", "red").when(F.col("fragile"), "fragile").otherwise(F.coalesce("badge", F.lit("unscored")))
    return rows.withColumn("quotability", F.concat_ws(" ", q, F.when(F.col("missing") > 0, F.format_string("(%d of 24 months missing)", F.col("missing")))))


def summary_sheet(yoy_rows: DataFrame, shapes: DataFrame, badges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: latest YoY of 3 scopes x 2 flows wide, shape, badge."""
    latest = R.at_latest_anchor(yoy_rows, KEYS).withColumn("_by", F.concat_ws("_", "scope", F.when(F.col("flow") == 1, "import").otherwise("export")))
    names = [f"{s}_{f}" for s in ("eu_27", "uk", "eu_27_plus_uk") for f in ("import", "export")]
    wide = R.pivot_first(latest, "group_name", "_by", names, "value_yoy")
    shape = shapes.where("scope = 'eu_27' and flow = 1").select("group_name", "shape")
    return groups.select("group_name", F.coalesce("display_name", "group_name").alias("name")).join(wide, "group_name", "left").join(shape, "group_name", "left").join(badges.select("group_name", "badge"), "group_name", "left")


def with_ranks(sheet: DataFrame, movers: DataFrame, scope: str = "eu_27") -> DataFrame:
    """A summary sheet with the rank of each group among the movers of a scope, imports and exports apart; null outside them."""
    rank = lambda flow, name: F.max(F.when((F.col("scope") == scope) & (F.col("flow") == flow), F.col("rank"))).alias(name)
    ranks = movers.groupBy("group_name").agg(rank(1, "top_movers_rank_imp"), rank(2, "top_movers_rank_exp"))
    return sheet.join(ranks, "group_name", "left")


def latest_sheet(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The latest finding of each key, flattened to the columns of a sheet."""
    return R.latest_by(rows, keys, F.desc("month_idx")).select(*keys, "month_idx", *columns)


def low_base_review(yoy_rows: DataFrame) -> DataFrame:
    return R.at_latest_anchor(yoy_rows, KEYS).where("low_base").withColumn("smaller_window", F.least("value_current", "value_prior"))


def movers_section(yoy_rows: DataFrame, k: int = 10) -> DataFrame:
    """Latest of each group, then the k largest changes of each scope and flow."""
    return R.top_k(R.latest_by(yoy_rows, KEYS, F.desc("month_idx")), ["scope", "flow"], k, F.desc(F.abs("value_yoy")), F.asc("group_name"))


def section_order(rows: DataFrame, section: str, value: str, last: str = "9") -> DataFrame:
    """Sections with their total value, the largest first and one fixed section last."""
    totals = rows.groupBy(section).agg(F.sum(value).alias("section_value"))
    return totals.orderBy(F.asc((F.col(section) == last).cast("int")), F.desc("section_value"), F.asc(section))


def interest_shortlist(branches: dict[str, tuple[DataFrame, Column, int]], headline: DataFrame, cap: int = 8) -> DataFrame:
    """The best of each branch (subject, strength) by an order, less headline subjects; more kinds first, then strength.

    strength belongs to the subject: it is the same in each branch that has the subject, and counts once.
    """
    parts = [df.orderBy(order, "subject").limit(k).select("subject", "strength", F.lit(name).alias("kind")) for name, (df, order, k) in branches.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    s = every.groupBy("subject").agg(F.count_distinct("kind").alias("n_kinds"), F.max("strength").alias("strength"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return s.join(headline, "subject", "left_anti").orderBy(F.desc("n_kinds"), F.desc("strength"), "subject").limit(cap)


FLIPS = ("inverse_u_peak", "failed_recovery")


def shortlist_branches(yoy_rows: DataFrame, shares: DataFrame, shapes: DataFrame, zs: DataFrame, dependency: float = 0.85) -> dict[str, tuple[DataFrame, Column, int]]:
    """Branches of the shortlist: movers, dependency, shape flips (by group) and mirror gaps (by partner, without blocs).

    yoy_rows: the latest of each group; shares: latest value_share of each group; shapes: any scope and flow.
    """
    yoy = yoy_rows.groupBy("group_name").agg(F.max(F.abs("value_yoy")).alias("size"))
    flips = shapes.where(F.col("shape").isin(*FLIPS)).select("group_name", F.lit(True).alias("flips")).distinct()
    groups = yoy.join(shares.select("group_name", "value_share"), "group_name", "full").join(flips, "group_name", "full")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    groups = groups.withColumn("strength", part("size") + part("value_share")).withColumnRenamed("group_name", "subject")
    gaps = zs.where(~F.col("partner").startswith("BLOC:")).select(F.col("partner").alias("subject"), (F.abs("z") / 2).alias("strength"))
    by_size = F.desc(part("size"))
    return {
        "mover": (groups.where("size is not null"), by_size, 3),
        "dependency": (groups.where(F.col("value_share") >= dependency), F.desc("value_share"), 3),
        "flip": (groups.where("flips"), by_size, 2),
        "mirror": (R.latest_by(gaps, ["subject"], F.desc("strength")), F.desc("strength"), 2),
    }


def carry_forward(current: DataFrame, previous: DataFrame, note: str = "note") -> DataFrame:
    """Annotations of the same finding and period fill empty ones and never replace others."""
    p = previous.select("finding_id", F.col("month_idx"), F.col(note).alias("_note"))
    return current.join(p, ["finding_id", "month_idx"], "left").withColumn(note, F.coalesce(note, "_note")).drop("_note")


def cited_releases(findings: DataFrame, releases: DataFrame) -> DataFrame:
    """Releases in the window of any finding (first_idx, last_idx), with the last fetch; by month, not by a range join."""
    months = findings.select(F.explode(F.sequence("first_idx", "last_idx")).alias("month_idx")).distinct()
    return releases.join(months, "month_idx", "left_semi").groupBy("source", "month_idx").agg(F.max("fetched_at").alias("last_fetched"))


def caveat_reference(universal: DataFrame, definitions: DataFrame) -> DataFrame:
    """Universal caveats with their definitions; missing ones are marked."""
    u = universal.select("family", F.explode("codes").alias("code"))
    return u.join(definitions, "code", "left").withColumn("defined", F.col("definition").isNotNull())


def own_caveats(codes: Column | str, subkind: Column | str) -> Column:
    """A finding's caveats less the universal ones of its family."""
    return F.array_except(X.col(codes), X.universal_caveats(subkind))


def coverage_manifest(releases: DataFrame, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(first, last, count per source; the last k releases of each)."""
    cover = releases.groupBy("source").agg(F.min("month_idx").alias("first_idx"), F.max("month_idx").alias("last_idx"), F.count("*").alias("n_releases"))
    return cover, R.top_k(releases, ["source"], k, F.desc("month_idx"))


def warnings(rows: DataFrame, extreme: float = 3.0) -> DataFrame:
    """The mark of an extreme single month and the phrase for missing months."""
    mark = F.when(F.abs("single_yoy") >= extreme, F.format_string("single month %+.0f%%", F.col("single_yoy") * 100))
    phrase = F.when(F.col("missing") > 0, F.when(F.col("n_current") < 12, F.lit("current window incomplete")).otherwise("prior window incomplete"))
    return rows.withColumn("warning", F.concat_ws("; ", mark, phrase))


def mover_sentence(rows: DataFrame) -> DataFrame:
    word = F.when(F.col("value_yoy") >= 0, "rose").otherwise("fell")
    flow = F.when(F.col("flow") == 1, "Imports").otherwise("Exports")
    text = F.concat(flow, F.lit(" of "), F.col("group_name"), F.lit(" "), word, F.lit(" "), F.format_string("%.1f%%", F.abs("value_yoy") * 100), F.lit(" to "), X.format_scaled("value_current"))
    return rows.withColumn("sentence", text)


def significant_shifts(pairs: DataFrame, material: float = 0.05) -> DataFrame:
    """Revision pairs (old_value, new_value) that moved by more than `material` or turned, with their rank: turned ones first, then the largest moves."""
    turned = F.signum("old_value") != F.signum("new_value")
    moved = F.abs(F.col("new_value") - F.col("old_value"))
    return pairs.withColumn("turned", turned).where(turned | (moved > material)).withColumn("moved", moved)


def cycle_digest(regime: DataFrame, shifts: DataFrame, order: list[str], lead: int = 3) -> DataFrame:
    """One row with the sentence of a cycle's regime (`ledger.revision_regime`); for movement with counts and the `lead` sharpest shifts.

    shifts: `significant_shifts` with group_name, scope and flow; `order` breaks ties.
    """
    first = shifts.orderBy(F.desc("turned"), F.desc("moved"), *order).limit(lead)
    phrase = F.format_string("%s (%s %s) %+.1f%% to %+.1f%%", "group_name", "scope", F.when(F.col("flow") == 1, "imports").otherwise("exports"), F.col("old_value") * 100, F.col("new_value") * 100)
    # `lead` rows at most
    place = F.struct((~F.col("turned")).alias("t"), (-F.col("moved")).alias("m"), *order, phrase.alias("phrase"))
    sharpest = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["phrase"]), "; ").alias("sharpest"))
    size = shifts.agg(F.count("*").alias("n_shifts"), F.count_if("turned").alias("n_turned"))
    one = regime.join(F.broadcast(size)).join(F.broadcast(sharpest))  # a row each
    moved = F.concat_ws(
        " ", F.when(F.col("n_shifts") > 0, F.format_string("%d findings moved by more than five points, %d of them to the other side; sharpest: %s.", "n_shifts", "n_turned", "sharpest")),
        F.when(F.col("n_new") > 0, F.format_string("%d findings are new.", "n_new")),
    )
    text = (
        F.when(F.col("regime") == "first_export", "First export: all findings are a baseline.").when(F.col("regime") == "no_change", "No new findings and no material shifts.")
        .when(F.col("regime") == "method_bump", F.format_string("A new method stamped %d findings again without moving them.", "n_pairs")).otherwise(moved)
    )
    return one.select("regime", "n_shifts", "n_turned", "n_new", text.alias("digest"))


def arithmetic_line(current: str = "value_current", prior: str = "value_prior") -> Column:
    """The workings of a YoY as text."""
    c, p = F.format_number(current, 0), F.format_number(prior, 0)
    return F.concat(F.lit("("), c, F.lit(" - "), p, F.lit(") / "), p, F.lit(" = "), X.format_pct(X.yoy(current, prior)))


def movers_with_drafts(movers: DataFrame, drafts: DataFrame) -> DataFrame:
    """Ranked movers with the newest active draft of their group, each draft at its first mover only."""
    d = R.latest_by(drafts.where("active"), ["group_name"], F.desc("created_at"))
    first = R.latest_by(movers, ["group_name"], F.desc("score"))
    return first.join(d.select("group_name", "draft_id"), "group_name")


def fact_sheet(yoy_rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per group: its facts as a map of `scope.flow.name` to value, low-base blocks outside eu_27 dropped."""
    latest = R.at_latest_anchor(yoy_rows, KEYS).where((F.col("scope") == "eu_27") | ~F.col("low_base"))
    flow = F.when(F.col("flow") == 1, "import").otherwise("export")
    facts = latest.select("group_name", F.explode(F.create_map(*(x for n in ("value_current", "value_prior", "value_yoy", "kg_yoy", "price_yoy") for x in (F.concat_ws(".", "scope", flow, F.lit(n)), F.col(n).cast("double"))))).alias("path", "value"))
    sheet = facts.where("value is not null").groupBy("group_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("facts"))
    return sheet.join(shapes.where("scope = 'eu_27' and flow = 1").select("group_name", "shape"), "group_name", "left")
