"""Filters of findings kept as data, and one set of joins that interprets all of them over the raw sums.

A stored filter is a row a value: finding_id, dimension (`partner`, `reporter`, `prefix`, `not_reporter`), value; a dimension without rows takes everything.
The finding itself has its flow and its months.  Findings share filters (all anchors of a group have one), so
filters are first named by what they hold; each different one is evaluated once, to a monthly series, and findings pick their months from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.relational import with_prefixes

ANY = "*"
DIMENSIONS = ("partner", "reporter", "not_reporter", "prefix")


def stored(findings: DataFrame, **values: Column) -> DataFrame:
    """Filter rows of findings: for each dimension an array of values or null."""

    def rows(name: str, v: Column) -> Column:
        return F.transform(F.coalesce(v.cast("array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("dimension"), x.alias("value")))

    each = [rows(name, v) for name, v in values.items()]
    return findings.select("finding_id", F.explode(F.concat(*each)).alias("f")).select("finding_id", "f.*").distinct()


def named(findings: DataFrame, filters: DataFrame) -> DataFrame:
    """finding_id, flow, first_idx, last_idx and, for each dimension, the name of its set of values (ANY for none)."""
    lists = filters.groupBy("finding_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("dimension") == d, F.col("value")))).alias(d) for d in DIMENSIONS))
    name = lambda d: F.when(F.size(d) > 0, F.sha1(F.concat_ws("\x1f", d)))
    names = lists.select("finding_id", *(name(d).alias(f"{d}_set") for d in DIMENSIONS))
    j = findings.select("finding_id", "flow", "first_idx", "last_idx").join(names, "finding_id", "left")
    return j.select("finding_id", "flow", "first_idx", "last_idx", *(F.coalesce(f"{d}_set", F.lit(ANY)).alias(f"{d}_set") for d in DIMENSIONS))


def _values(filters: DataFrame, findings: DataFrame, dimension: str) -> DataFrame:
    """(set, value) of the different sets of one dimension."""
    own = filters.where(F.col("dimension") == dimension).join(findings.select("finding_id", f"{dimension}_set"), "finding_id")
    return own.select(f"{dimension}_set", F.col("value").alias(dimension)).distinct()


def alone(prefixes: DataFrame, by: str) -> DataFrame:
    """Prefixes of each set that no shorter one of it covers, so that a code meets a set once."""
    shorter = prefixes.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.length("prefix") - 1, F.lit(1))))).where(F.col("_n") < F.length("prefix"))
    covered = shorter.select(by, "prefix", F.expr("substring(prefix, 1, _n)").alias("_head")).join(prefixes.select(by, F.col("prefix").alias("_head")), [by, "_head"])
    return prefixes.join(covered.select(by, "prefix").distinct(), [by, "prefix"], "left_anti")


def evaluated(cells: DataFrame, filters: DataFrame, findings: DataFrame) -> DataFrame:
    """flow, the four sets, month_idx -> value of every different filter over cells (reporter, partner, product_nc, flow, month_idx, value).

    The prefix join comes first and its result is summed at once; partner and reporter are equi-joins on set and value.
    """
    sets = [f"{d}_set" for d in DIMENSIONS]
    combos = findings.select("flow", *sets).distinct()
    values = {d: _values(filters, findings, d) for d in DIMENSIONS}
    by = ["reporter", "partner", "flow", "month_idx"]
    prefixes = alone(values["prefix"], "prefix_set")
    some = with_prefixes(cells, prefixes, "product_nc").join(prefixes, "prefix").groupBy("prefix_set", *by).agg(F.sum("value").alias("value"))
    every = cells.groupBy(*by).agg(F.sum("value").alias("value")).withColumn("prefix_set", F.lit(ANY))
    rows = some.unionByName(every).join(combos, ["prefix_set", "flow"])
    for d, c, within in (("partner", "partner", True), ("reporter", "reporter", True), ("not_reporter", "reporter", False)):
        known = values[d].select(f"{d}_set", F.col(d).alias(c), F.lit(True).alias("_in"))
        inside = F.coalesce("_in", F.lit(False))
        rows = rows.join(known, [f"{d}_set", c], "left").where((F.col(f"{d}_set") == ANY) | (inside if within else ~inside)).drop("_in")
    return rows.groupBy("flow", *sets, "month_idx").agg(F.sum("value").alias("value"))


def replayed(findings: DataFrame, filters: DataFrame, cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """finding_id, value_current, replayed (the sum over its months that its stored filter gives), matches.

    findings: finding_id, flow, first_idx, last_idx, value_current.  A filter that catches nothing sums to 0.
    """
    f = named(findings, filters)
    series = evaluated(cells, filters, f)
    months = f.withColumn("month_idx", F.explode(F.sequence("first_idx", "last_idx")))
    sums = months.join(series, ["flow", *(f"{d}_set" for d in DIMENSIONS), "month_idx"]).groupBy("finding_id").agg(F.sum("value").cast("double").alias("replayed"))
    j = findings.select("finding_id", "value_current").join(sums, "finding_id", "left").withColumn("replayed", F.coalesce("replayed", F.lit(0.0)))
    return j.withColumn("matches", F.abs(F.col("replayed") - F.col("value_current")) <= tolerance * F.greatest(F.abs("value_current"), F.lit(1.0)))
