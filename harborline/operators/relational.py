"""Joins, set operations and selections that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def group_patterns_alone(patterns: DataFrame) -> DataFrame:
    """The prefixes of each group less those that a shorter prefix of the group covers: a code matches a group once at most."""
    p = patterns.distinct()
    shorter = p.select(F.col("group_name").alias("_g"), F.col("prefix").alias("_p"))
    covered = (F.col("group_name") == F.col("_g")) & (F.length("_p") < F.length("prefix")) & F.col("prefix").startswith(F.col("_p"))
    return p.join(shorter, covered, "left_anti")


def assign_groups(facts: DataFrame, patterns: DataFrame, code: str = "product_nc") -> DataFrame:
    """One row per fact and matching group; groups overlap, so never sum across groups.

    An equi-join with the dimension of patterns, which Spark broadcasts by its own size check, on those prefixes of each 8-digit code
    that are as long as some pattern.
    """
    alone = group_patterns_alone(patterns)
    return with_prefixes(facts.where(F.col(code).rlike("^[0-9]{8}$")), alone, code).join(alone, "prefix").drop("prefix")


def with_prefixes(rows: DataFrame, prefixes: DataFrame, code: str) -> DataFrame:
    """rows once for each length that a prefix has, with the prefix of the code of that length; one row of lengths is broadcast."""
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    heads = F.transform(F.filter("_lengths", lambda n: n.between(1, F.length(code))), lambda n: F.substring(F.col(code), F.lit(1), n))
    return rows.join(F.broadcast(lengths)).withColumn("prefix", F.explode(heads)).drop("_lengths")


def group_codes(codes: DataFrame, patterns: DataFrame, code: str = "product_nc") -> DataFrame:
    """(code, group columns) for every group with a prefix of the code."""
    return assign_groups(codes.select(code).distinct(), patterns, code)


def select_groups(groups: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The groups of these names (None: all), by id."""
    return (groups if names is None else groups.where(F.col("group_name").isin(*names))).orderBy("group_id")


def with_release(observations: DataFrame, releases: DataFrame, key: str = "release_id") -> DataFrame:
    """Observations with their release; those of unknown releases go."""
    return observations.join(releases, key)


def of_group(findings: DataFrame, group_id: Column | int, ids: str = "hs_group_ids") -> DataFrame:
    """Findings whose array of groups has the group."""
    return findings.where(F.array_contains(ids, group_id))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def at_latest_anchor(df: DataFrame, keys: list[str], anchor: str = "month_idx") -> DataFrame:
    """The rows of each key's latest anchor."""
    last = df.groupBy(*keys).agg(F.max(anchor).alias("_last")) if keys else df.agg(F.max(anchor).alias("_last"))
    joined = df.join(F.broadcast(last)) if not keys else df.join(last, keys)
    return joined.where(F.col(anchor) == F.col("_last")).drop("_last")


def resolve_country(df: DataFrame, aliases: DataFrame, label: str = "label") -> DataFrame:
    """iso and aggregate_kind of a label: codes stand for themselves, others are looked up exactly; null: unresolved."""
    known = aliases.select(F.col("label").alias(label), F.col("iso").alias("_iso"), "aggregate_kind")
    own = F.when(F.col(label).rlike("^[A-Z]{2}$"), F.col(label))
    return df.join(known, label, "left").withColumn("iso", F.coalesce("_iso", own)).drop("_iso")


def members_at(df: DataFrame, members: DataFrame, anchor: str = "month_idx", kind: str = "aggregate_kind") -> DataFrame:
    """A row per member of each row's bloc that is valid at its anchor (open bounds)."""
    m = members.select(F.col("aggregate_kind").alias("_kind"), F.col("iso").alias("member"), "valid_from", "valid_to")
    inside = (F.col(anchor) >= F.coalesce("valid_from", F.lit(-(1 << 31)))) & (F.col(anchor) <= F.coalesce("valid_to", F.lit((1 << 31) - 1)))
    return df.join(m, (F.col(kind) == F.col("_kind")) & inside).drop("_kind", "valid_from", "valid_to")


def asof_rate(df: DataFrame, rates: DataFrame, currency: str, anchor: str = "month_idx") -> DataFrame:
    """rate and rate_idx: the latest rate on or before the anchor; null without one.

    Anchors and rates are merged per currency and month (one row each) and the last rate is carried forward.
    """
    r = rates.select(F.col("currency_from").alias(currency), F.col("rate_idx").alias(anchor), "rate", "rate_idx")
    wanted = df.select(currency, anchor).distinct().join(r, [currency, anchor], "full")
    w = Window.partitionBy(currency).orderBy(anchor)
    carried = wanted.select(currency, anchor, F.last("rate", True).over(w).alias("rate"), F.last("rate_idx", True).over(w).alias("rate_idx"))
    return df.join(carried, [currency, anchor], "left")


def baseline_for(df: DataFrame, baselines: DataFrame, partner: str, fallback: float = 0.075) -> DataFrame:
    """baseline and its scope: per partner, else the global one, else the fallback."""
    own = baselines.where("partner is not null").select(F.col("partner").alias(partner), F.col("baseline").alias("_own"))
    wide = baselines.where("partner is null").agg(F.max("baseline").alias("_wide"))
    scope = F.when(F.col("_own").isNotNull(), "per_partner").when(F.col("_wide").isNotNull(), "global").otherwise("fallback")
    return df.join(own, partner, "left").join(F.broadcast(wide)).withColumn("baseline", F.coalesce("_own", "_wide", F.lit(fallback))).withColumn("baseline_scope", scope).drop("_own", "_wide")


def hub_flag(df: DataFrame, hubs: DataFrame, partner: str) -> DataFrame:
    h = hubs.select(F.col("iso").alias(partner), F.lit(True).alias("_hub"))
    return df.join(h, partner, "left").withColumn("is_hub", F.coalesce("_hub", F.lit(False))).drop("_hub")


def aligned_months(eu: DataFrame, uk: DataFrame) -> DataFrame:
    """(flow, month_idx) published by both sources, whatever the group."""
    both = eu.select("flow", "month_idx", F.lit(1).alias("s")).distinct().union(uk.select("flow", "month_idx", F.lit(2).alias("s")).distinct())
    return both.groupBy("flow", "month_idx").agg(F.count_distinct("s").alias("n")).where("n = 2").drop("n")


def lineage(findings: DataFrame, observations: DataFrame, ids: str = "observation_ids", key: str = "id") -> DataFrame:
    """A row per observation behind a finding."""
    return findings.withColumn(key, F.explode(ids)).drop(ids).join(observations, key)


def pivot_first(df: DataFrame, key: str, by: str, names: list[str], value: str) -> DataFrame:
    """One row per key, a column per name."""
    return df.groupBy(key).agg(*(F.first(F.when(F.col(by) == n, F.col(value)), True).alias(n) for n in names))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bucket (0: under the first edge), n, share."""
    bucket = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select("bucket", "n", (F.col("n") / F.col("_t")).alias("share"))


def mode_lowest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; the lowest of equals."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return latest_by(n, keys, F.desc("_n"), F.asc(value)).drop("_n")


def sibling_groups(patterns: DataFrame, k: int = 6) -> DataFrame:
    """Groups that share a heading (the first four digits of a pattern), k at most each, by id."""
    head = patterns.select("group_id", F.substring("prefix", 1, 4).alias("heading")).distinct()
    other = head.select(F.col("group_id").alias("sibling_id"), "heading")
    pairs = head.join(other, "heading").where("group_id <> sibling_id").groupBy("group_id", "sibling_id").agg(F.count("*").alias("shared"))
    return top_k(pairs, ["group_id"], k, F.asc("sibling_id"))


def not_only_held(df: DataFrame, groups: str, held: list[str]) -> DataFrame:
    """Rows with a parent group that is not held."""
    return df.where(F.size(F.array_except(groups, F.array(*map(F.lit, held)).cast("array<string>"))) > 0)
