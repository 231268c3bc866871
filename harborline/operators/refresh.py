"""Group series and their changes kept up to date: after months of facts were replaced, only what they touch is computed again.

Three keyed snapshots lie beside each other: `codes` (sums of a code, scope, flow and month), `series` (of a group) and `yoy`
(changes at every anchor).  A refresh reads the facts of the replaced months, finds the code cells whose sums differ from the stored ones,
from these the group cells that changed, and from these the 24 anchors whose windows hold them.  Group rows are read from the buckets of the touched groups
and within 23 months of the replaced ones, and only these buckets are written.

The snapshots are switched in the order yoy, series, codes, and each remembers the refresh it took in.  What changed is told from `codes`, which is
switched last: a refresh that died in between does the rest when it comes again with its name.
Patterns, envelope and limits belong to a state; other ones need a build of their own.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators import families as A
from harborline.operators import relational as R
from harborline.sources.sinks import written
from harborline.sources.tables import bucket_of, pointed, read_keyed, update_keyed

CELL = ["product_nc", "scope", "flow", "month_idx"]
AT = [*A.KEYS, "month_idx"]
SUMS = ["value_eur", "quantity_kg", "with_kg", "rows"]
BUCKETS = 32


def build(spark: SparkSession, path: str, facts: DataFrame, patterns: DataFrame, envelope: tuple[str, ...], uk: str, name: str = "0", limits: A.Limits = A.Limits(), buckets: int = BUCKETS) -> None:
    """The first state, from all facts."""
    first = lambda _, new: new
    codes = written(A.code_totals(facts, envelope, uk))
    series = written(A.series_of_codes(codes, patterns))
    update_keyed(spark, f"{path}/yoy", A.group_yoy(series, limits), A.KEYS, name, first, buckets)
    update_keyed(spark, f"{path}/series", series, A.KEYS, name, first, buckets)
    update_keyed(spark, f"{path}/codes", codes, ["month_idx"], name, first, buckets)


def changed_codes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells (CELL) whose sums differ, that came or that went."""
    told = old.select(*CELL, *(F.col(c).alias(f"_{c}") for c in SUMS))
    j = told.join(new.select(*CELL, *SUMS), CELL, "full")
    return j.where(reduce(or_, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SUMS))).select(*CELL)


def touched_anchors(cells: DataFrame, months: int = 24) -> DataFrame:
    """The anchors whose windows hold the cells."""
    on = F.explode(F.sequence(F.col("month_idx"), F.col("month_idx") + months - 1))
    return cells.select(*A.KEYS, on.alias("month_idx")).distinct()


def refresh(spark: SparkSession, path: str, facts: DataFrame, months: list[int], patterns: DataFrame, envelope: tuple[str, ...], uk: str, name: str, limits: A.Limits = A.Limits()) -> dict[str, int]:
    """Takes in the replaced months of facts; facts in folders of month_idx are read from those of the months alone.

    Returns the number of changed group cells, of anchors computed again and of buckets written.
    """
    of_months = F.col("month_idx").isin(*months)
    new = written(A.code_totals(facts.where(of_months), envelope, uk))
    wanted = spark.createDataFrame([(m,) for m in months], "month_idx int")
    only = [r[0] for r in wanted.select(bucket_of(["month_idx"], pointed(spark, f"{path}/codes")["buckets"])).distinct().collect()]  # a row a month at most
    stored = read_keyed(spark, f"{path}/codes", only)
    old = new.where("false") if stored is None else stored.where(of_months)
    cells = written(R.assign_groups(changed_codes(old, new), patterns).select(*AT).distinct())
    fresh = written(A.series_of_codes(new, patterns).join(cells, AT, "left_semi"))
    anchors = written(touched_anchors(cells))

    groups = [r[0] for r in cells.select(bucket_of(A.KEYS, pointed(spark, f"{path}/series")["buckets"])).distinct().collect()]  # `buckets` rows at most
    rows = read_keyed(spark, f"{path}/series", groups)
    near = F.col("month_idx").between(min(months) - 23, max(months) + 23)
    around = fresh if rows is None else rows.where(near).join(cells.select(*A.KEYS).distinct(), A.KEYS, "left_semi").join(cells, AT, "left_anti").select(fresh.columns).unionByName(fresh)
    again = written(A.group_yoy(around, limits).join(anchors, AT, "left_semi"))

    replaced = lambda with_: lambda had, gone: with_ if had is None else had.join(gone, AT, "left_anti").select(with_.columns).unionByName(with_)
    taken = update_keyed(spark, f"{path}/yoy", anchors, A.KEYS, name, replaced(again))
    update_keyed(spark, f"{path}/series", cells, A.KEYS, name, replaced(fresh))
    update_keyed(spark, f"{path}/codes", wanted, ["month_idx"], name, lambda had, gone: new if had is None else had.where(~of_months).unionByName(new))
    return {"cells": cells.count(), "anchors": anchors.count(), "buckets": len(taken)}
