"""Monthly series: windows over months (range frames) or points (row frames), gaps, slopes, shares.

A series is a DataFrame with key columns, month_idx and values.  All frames of a family share one
partitioning and ordering, so Spark sorts once; series are aggregated to months before any window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.expr import yoy
from harborline.operators import selection


def over_months(keys: list[str], first: int, last: int) -> Window:
    """Calendar months first..last relative to the row: gaps count as gaps."""
    return Window.partitionBy(*keys).orderBy("month_idx").rangeBetween(first, last)


def monthly_totals(facts: DataFrame, keys: list[str], value: str = "value_eur", kg: str = "quantity_kg") -> DataFrame:
    """keys, month_idx -> value, kg, value_with_kg (doubles of exact decimal sums), n_rows."""
    with_kg = F.when(F.col(kg) > 0, F.col(value))
    double = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return facts.groupBy(*keys, "month_idx").agg(double(F.col(value)).alias("value"), double(F.col(kg)).alias("kg"), double(with_kg).alias("value_with_kg"), F.count("*").alias("n_rows"))


def rolling_pair(series: DataFrame, keys: list[str], values: list[str], months: int = 12) -> DataFrame:
    """For each value x: x_current, x_prior; and n_current, n_prior months present."""
    now, before = over_months(keys, 1 - months, 0), over_months(keys, 1 - 2 * months, -months)
    cols = [c for v in values for c in (F.sum(v).over(now).alias(f"{v}_current"), F.coalesce(F.sum(v).over(before), F.lit(0.0)).alias(f"{v}_prior"))]
    return series.select("*", *cols, F.count("*").over(now).alias("n_current"), F.count("*").over(before).alias("n_prior"))


def missing_months(keys: list[str], first: int, last: int) -> Column:
    """Month indexes of the frame that the series lacks."""
    m = F.col("month_idx")
    return F.array_except(F.sequence(m + first, m + last), F.collect_set("month_idx").over(over_months(keys, first, last)))


def at_lag(value: str, keys: list[str], lag: int = 12) -> Column:
    """The value of exactly `lag` months before."""
    return F.max(value).over(over_months(keys, -lag, -lag))


def single_month(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return series.withColumn("single_prior", at_lag(value, keys)).withColumn("single_yoy", yoy(value, "single_prior"))


def two_month(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The last two calendar months against the same a year before; an absent month counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = series.withColumn("two_current", zero(F.sum(value).over(over_months(keys, -1, 0)))).withColumn("two_prior", zero(F.sum(value).over(over_months(keys, -13, -12))))
    return out.withColumn("two_yoy", yoy("two_current", "two_prior"))


def ytd_published(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Published cumulative values against the same month a year before."""
    return series.withColumn("ytd_prior", at_lag(value, keys)).withColumn("ytd_yoy", yoy(value, "ytd_prior"))


def ytd_computed(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """January to the row's month, null unless every month is there; and the change on the year before."""
    year = F.floor(F.col("month_idx") / 12)
    w = Window.partitionBy(*keys, year).orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count("*").over(w) == F.col("month_idx") % 12 + 1
    out = series.withColumn("ytd", F.when(whole, F.sum(value).over(w)))
    return out.withColumn("ytd_prior", at_lag("ytd", keys)).withColumn("ytd_yoy", yoy("ytd", "ytd_prior"))


def add_jan_feb(series: DataFrame, chunks: DataFrame, keys: list[str], value: str = "value", months: int = 12) -> DataFrame:
    """Two-window sums of a monthly series with combined January-February chunks (keys, jan_idx, value).

    A chunk counts only where neither month is published, only as a whole, and never as an anchor.
    """
    known = series.where(F.col("month_idx") % 12 < 2).select(*keys, (F.col("month_idx") - F.col("month_idx") % 12).alias("jan_idx")).distinct()
    alone = chunks.join(known, [*keys, "jan_idx"], "left_anti").select(*keys, F.col("jan_idx").alias("month_idx"), F.lit(None).cast("double").alias(value), F.col(value).alias("chunk"))
    both = series.select(*keys, "month_idx", value, F.lit(None).cast("double").alias("chunk")).unionByName(alone)
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def half(first: int, last: int, name: str) -> list[Column]:
        w, c = over_months(keys, first, last), over_months(keys, first, last - 1)
        total = zero(F.sum(value).over(w)) + zero(F.sum("chunk").over(c))
        return [total.alias(f"{value}_{name}"), (F.count(value).over(w) + 2 * F.count("chunk").over(c)).alias(f"n_{name}"), F.count("chunk").over(c).alias(f"chunks_{name}")]

    out = both.select(*keys, "month_idx", value, *half(1 - months, 0, "current"), *half(1 - 2 * months, -months, "prior"))
    return out.where(F.col(value).isNotNull())


def rolling_zscore(series: DataFrame, keys: list[str], value: str, n: int = 6, least: int = 3) -> DataFrame:
    """z of each point against the n points before it; null under `least` points or without spread."""
    w = Window.partitionBy(*keys).orderBy("month_idx").rowsBetween(-n, -1)
    out = series.withColumn("base_n", F.count(value).over(w)).withColumn("base_mean", F.avg(value).over(w)).withColumn("base_std", F.stddev_samp(value).over(w))
    return out.withColumn("z", F.when((F.col("base_n") >= least) & (F.col("base_std") > 1e-12), (F.col(value) - F.col("base_mean")) / F.col("base_std")))


def series_gaps(series: DataFrame, keys: list[str], skip_january: bool = False) -> DataFrame:
    """keys, first, last, n_missing, missing (month indexes between first and last)."""
    out = series.groupBy(*keys).agg(F.min("month_idx").alias("first"), F.max("month_idx").alias("last"), F.collect_set("month_idx").alias("there"))
    gaps = F.array_except(F.sequence("first", "last"), "there")
    gaps = F.filter(gaps, lambda m: m % 12 != 0) if skip_january else gaps
    return out.select(*keys, "first", "last", F.size(gaps).alias("n_missing"), F.array_sort(gaps).alias("missing"))


def longest_run(series: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the longest run of consecutive months of each key; the earliest of equals."""
    by = Window.partitionBy(*keys)
    islands = series.withColumn("_island", F.col("month_idx") - F.row_number().over(by.orderBy("month_idx")))
    run = Window.partitionBy(*keys, "_island")
    sized = islands.withColumn("_run", F.struct(F.count("*").over(run).alias("n"), (-F.min("month_idx").over(run)).alias("first")))
    return sized.withColumn("_best", F.max("_run").over(by)).where("_run = _best").drop("_island", "_run", "_best")


def smooth_centred(series: DataFrame, keys: list[str], value: str, window: int = 3) -> DataFrame:
    """A centred mean that shrinks at the ends."""
    w = Window.partitionBy(*keys).orderBy("month_idx").rowsBetween(-(window // 2), window // 2)
    return series.withColumn("smooth", F.avg(value).over(w))


def sign_runs(series: DataFrame, keys: list[str], value: str, flat: float = 0.0) -> DataFrame:
    """keys -> sign_changes (zeros ignored), last_sign, first_sign."""
    sign = F.when(F.abs(F.col(value)) > flat, F.signum(value).cast("int"))
    marked = series.where(sign.isNotNull()).withColumn("_s", sign)
    prior = F.lag("_s").over(Window.partitionBy(*keys).orderBy("month_idx"))
    return marked.withColumn("_turn", (prior != F.col("_s")).cast("int")).groupBy(*keys).agg(
        F.coalesce(F.sum("_turn"), F.lit(0)).alias("sign_changes"), F.max_by("_s", "month_idx").alias("last_sign"), F.min_by("_s", "month_idx").alias("first_sign")
    )


def middle(sorted_values: Column) -> Column:
    """The median of a sorted array, null of an empty one."""
    at = lambda i: F.get(sorted_values, F.floor(i).cast("int"))
    return (at((F.size(sorted_values) - 1) / 2) + at(F.size(sorted_values) / 2)) / 2


@F.pandas_udf(T.DoubleType())
def _median_slopes(values: pd.Series) -> pd.Series:
    return pd.Series([0.0 if v is None else selection.median_slope(v) for v in values])


def median_slope(values: Column) -> Column:
    """Theil-Sen: the median slope of all pairs of an array (positions count, not months), by selection in n log n; 0 under two values."""
    return _median_slopes(values.cast("array<double>"))


def autocorrelation(values: Column, slope: Column, lag: int = 12) -> Column:
    """Correlation of an array with itself `lag` places on, less its Theil-Sen line (`median_slope`); null under lag + 2 values or without variance."""
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    mean = lambda a: total(a) / F.size(a)

    def correlation(r: Column) -> Column:
        a, b = F.slice(r, F.lit(1), F.size(r) - lag), F.slice(r, F.lit(lag + 1), F.size(r))
        less = lambda x: bind(mean(x), lambda m: F.transform(x, lambda v: v - m))
        return bind(F.struct(less(a).alias("a"), less(b).alias("b")), lambda p: ratio(p["a"], p["b"]))

    def ratio(a: Column, b: Column) -> Column:
        square = total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x))
        return F.when(square > 1e-24, total(F.zip_with(a, b, lambda x, y: x * y)) / F.sqrt(square))

    line = lambda m: F.transform(values, lambda v, i: v - m * i)
    rest = bind(slope, line)
    level = bind(rest, lambda r: F.transform(r, lambda v: v - middle(F.array_sort(r))))
    return F.when(F.size(values) >= lag + 2, bind(level, correlation))


def _arrays(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    points = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month_idx", F.col(value).alias("v")))).alias("p"))
    return points.select(*keys, F.col("p.v").alias("v"))


def theil_sen(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys -> slope: the median of all pairwise slopes (positions count, not months)."""
    return _arrays(series, keys, value).where(F.size("v") > 1).select(*keys, median_slope(F.col("v")).alias("slope"))


def seasonal_autocorr(series: DataFrame, keys: list[str], value: str, lag: int = 12) -> DataFrame:
    """keys -> autocorr of the detrended series at the lag; null under lag + 2 points or without variance."""
    return _arrays(series, keys, value).withColumn("_line", median_slope(F.col("v"))).select(*keys, autocorrelation(F.col("v"), F.col("_line"), lag).alias("autocorr"))


def rolling_share(num: DataFrame, den: DataFrame, keys: list[str], den_keys: list[str], values: list[str], months: int = 12) -> DataFrame:
    """Shares of rolling sums on months that both sides have; null unless both windows are whole."""
    d = den.select(*den_keys, "month_idx", *(F.col(v).alias(f"{v}_den") for v in values))
    joined = num.join(d, [*den_keys, "month_idx"])
    w = over_months(keys, 1 - months, 0)
    whole = F.count("*").over(w) == months
    cols = []
    for v in values:
        total = F.sum(f"{v}_den").over(w)
        cols.append(F.when(whole & (total != 0), F.sum(v).over(w) / total).alias(f"{v}_share"))
    return joined.select("*", *cols, F.count("*").over(w).alias("n_months"))


def series_as_of(keys: list[str], *cols: str, months: int = 24) -> Column:
    """The array of the last `months` months' points up to each row."""
    return F.array_sort(F.collect_list(F.struct("month_idx", *cols)).over(over_months(keys, 1 - months, 0)))


def annual_from_ytd(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, year -> the latest cumulative value of the year and whether the year is partial."""
    year = F.floor(F.col("month_idx") / 12).cast("int").alias("year")
    return series.groupBy(*keys, year).agg(F.max_by(value, "month_idx").alias("annual"), (F.max("month_idx") % 12 != 11).alias("partial"))
