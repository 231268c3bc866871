"""Coverage, duplicates, reconciliation, calendars, run logs and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.functions import expr as X
from harborline.operators import relational as R


def coverage_gaps(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month_idx) missing although key and month both occur: dense months are made per key, not by a cross join."""
    months = facts.select("month_idx").distinct().agg(F.array_sort(F.collect_set("month_idx")).alias("all"))
    there = facts.groupBy(*keys).agg(F.collect_set("month_idx").alias("there"))
    return there.join(F.broadcast(months)).select(*keys, F.explode(F.array_except("all", "there")).alias("month_idx"))


#: The columns that tell raw rows apart.
RAW_KEY = [
    "period", "reporter", "partner", "trade_type", "product_nc", "product_sitc", "product_cpa21", "product_cpa22", "product_bec", "product_bec5", "product_section", "flow", "stat_procedure", "suppl_unit",
]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Natural keys (null as '') that occur more than once, in two rounds.

    The first counts 64-bit hashes of the key; the second compares whole keys, but only of rows whose hash repeats, so that a wide key is shuffled
    in proportion to the duplicates.
    """
    text = df.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)).withColumn("_hash", F.xxhash64(*keys))
    repeated = text.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    return text.join(repeated, "_hash", "left_semi").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unexpected(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def reconcile(facts: DataFrame, key: str, tolerance: float = 0.15) -> DataFrame:
    """Detail against the total row of each key: relative difference and verdict."""
    total = F.sum(F.when(F.col("product_nc") == X.TOTAL_CODE, F.col("value_eur"))).cast("double")
    detail = F.sum(F.when(F.col("product_nc") != X.TOTAL_CODE, F.col("value_eur"))).cast("double")
    r = facts.groupBy(key).agg(total.alias("total"), detail.alias("detail"))
    diff = F.when(F.col("total") != 0, F.abs(F.col("detail") - F.col("total")) / F.abs("total"))
    return r.withColumn("difference", diff).withColumn("within", diff <= tolerance)


def currency_unit_consistent(currency: Column | str, unit: Column | str) -> Column:
    """A unit that names a currency names the row's own."""
    scale = X.unit_scale(unit)
    return F.coalesce(scale["currency"].isNull() | (scale["currency"] == X.col(currency)), F.lit(False)) & scale.isNotNull()


def valid_patterns(patterns: Column | str) -> Column:
    """Non-empty, 2 to 8 digits and a %, no null, none that catches the total row."""
    p = X.col(patterns)
    return F.coalesce((F.size(p) > 0) & F.forall(p, lambda x: F.coalesce(x.rlike("^[0-9]{2,8}%$") & ~F.lit(X.TOTAL_CODE).startswith(F.regexp_replace(x, "%$", "")), F.lit(False))), F.lit(False))


def not_present(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


#: Days from the close of a month to its publication and of grace, and whether January comes with February.
SCHEDULES = (("eurostat", 46, 5, False), ("hmrc", 44, 7, False), ("gacc", 8, 4, True))


def schedules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEDULES, "source string, lag_days int, grace_days int, january_with_february boolean")


def publication_expectation(periods: DataFrame, calendar: DataFrame, as_of: Column, schedule: DataFrame) -> DataFrame:
    """due date (exact from the calendar, else close of the month plus the source's lag) and none_expected / due / overdue.

    calendar: source, month_idx, exact_date; schedule: as SCHEDULES.  A source without a schedule has no due date and no state.
    """
    c = calendar.select("source", F.col("month_idx").alias("_for"), "exact_date")
    p = periods.join(schedule, "source", "left")
    moved = F.coalesce("january_with_february", F.lit(False)) & (F.col("month_idx") % 12 == 0)
    p = p.withColumn("_for", F.col("month_idx") + moved.cast("int")).join(c, ["source", "_for"], "left")
    due = F.when(F.col("lag_days").isNotNull(), F.coalesce("exact_date", F.date_add(F.last_day(X.month_start("_for")), F.col("lag_days"))))
    p = p.withColumn("due", due)
    state = F.when(as_of < F.col("due"), "none_expected").when(as_of <= F.date_add("due", F.col("grace_days")), "due").when(F.col("due").isNotNull(), "overdue")
    return p.withColumn("state", state).drop("_for")


def next_release_forecast(releases: DataFrame, calendar: DataFrame, as_of: Column, schedule: DataFrame) -> DataFrame:
    """The next month of each source and when it is due, soonest first; January goes to February where they come as one."""
    nxt = releases.groupBy("source").agg((F.max("month_idx") + 1).alias("month_idx")).join(schedule.select("source", "january_with_february"), "source", "left")
    skip = F.coalesce("january_with_february", F.lit(False)) & (F.col("month_idx") % 12 == 0)
    nxt = nxt.withColumn("month_idx", F.col("month_idx") + skip.cast("int")).drop("january_with_february")
    return publication_expectation(nxt, calendar, as_of, schedule).orderBy("due", "source")


def source_status(log: DataFrame) -> DataFrame:
    """Last check, its result, last new data and counts of each source."""
    return log.groupBy("source").agg(
        F.max("checked_at").alias("last_checked"), F.max_by("result", F.struct("checked_at", "event_id")).alias("last_result"),
        F.max(F.when(F.col("result") == "new_data", F.col("checked_at"))).alias("last_new_data"), F.count("*").alias("n_checks"), F.count_if(F.col("result") == "error").alias("n_errors"),
    )


def sources_rollup(log: DataFrame, releases: DataFrame, sources: DataFrame) -> DataFrame:
    """Every expected source with its checks and what the store has of it: latest month and the months missing up to it.

    sources: source, january_with_february (a missing January is no gap there); one that was never checked has no telemetry, one without releases no months.
    """
    own = releases.join(sources, "source", "left_semi")
    months = own.groupBy("source").agg(F.min("month_idx").alias("_first"), F.max("month_idx").alias("latest_idx"), F.collect_set("month_idx").alias("_there"))
    j = sources.join(source_status(log), "source", "left").join(months, "source", "left")
    gaps = F.array_except(F.sequence("_first", "latest_idx"), "_there")
    gaps = F.filter(gaps, lambda m: ~F.coalesce("january_with_february", F.lit(False)) | (m % 12 != 0))
    return j.withColumn("gaps", F.coalesce(F.array_sort(gaps), F.array().cast("array<int>"))).drop("_first", "_there", "january_with_february")


def newly_overdue(log: DataFrame, bad: str = "not_yet") -> DataFrame:
    """Checks at which a spell of `bad` results began."""
    before = F.lag("result").over(Window.partitionBy("source").orderBy("checked_at", "event_id"))
    return log.withColumn("_before", before).where((F.col("result") == bad) & (F.col("_before").isNull() | (F.col("_before") != bad))).drop("_before")


def new_data_since(log: DataFrame, mark: Column) -> DataFrame:
    return R.latest_by(log.where((F.col("result") == "new_data") & (F.col("checked_at") > mark)), ["source"], F.desc("checked_at"), F.desc("event_id"))


def run_lifecycle(log: DataFrame, start: str, finish: str) -> DataFrame:
    """Last start, last finish and whether a run is in flight."""
    one = log.agg(F.max(F.when(F.col("result") == start, F.col("checked_at"))).alias("started"), F.max(F.when(F.col("result") == finish, F.col("checked_at"))).alias("finished"))
    return one.withColumn("in_flight", F.coalesce(F.col("started") > F.col("finished"), F.col("started").isNotNull()))


def run_history(log: DataFrame, k: int = 20) -> DataFrame:
    return log.orderBy(F.desc("checked_at"), F.desc("event_id")).limit(k)


def run_histories(logs: dict[str, DataFrame], k: int = 20) -> DataFrame:
    """log, rank and the latest k runs of each log, newest first: run_id, at, result, duration_ms, counts and their total.

    Each log has run_id, at, result, duration_ms and counts (a map of numbers, or null).
    """
    columns = ["run_id", "at", "result", "duration_ms", "counts"]
    every = None
    for name, df in logs.items():
        one = df.select(F.lit(name).alias("log"), *columns)
        every = one if every is None else every.unionByName(one)
    total = F.when(F.col("counts").isNotNull(), F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda t, v: t + v))
    return R.top_k(every.withColumn("total", total), ["log"], k, F.desc("at"), F.desc("run_id"))


def against_published(sums: DataFrame, published: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Our sums (keys, value) beside published figures (keys, figure): the relative difference, and whether it is within the tolerance; a figure without sums is not."""
    j = published.join(sums.select(*keys, "value"), keys, "left")
    off = F.when(F.col("figure") != 0, F.abs(F.col("value") - F.col("figure")) / F.abs("figure"))
    return j.withColumn("difference", off).withColumn("within", F.coalesce(off < tolerance, F.lit(False)))


def place_among(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are at most the value, by a tree of comparisons."""
    if not edges:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(value >= edges[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))


def threshold_sweeps(rows: DataFrame, measures: dict[str, tuple[str, list[float], float, bool]]) -> DataFrame:
    """measure, threshold, n, share, change (against the default) for any number of thresholds of several measures, in one pass.

    measures: name -> (column, thresholds, default, under); n counts rows under the threshold, or those at it and above.  Each row is one count in the
    histogram over the sorted thresholds of each measure that it has; running totals over these few counts give every threshold.
    """
    edges = {m: sorted({*t, default}) for m, (_, t, default, _) in measures.items()}
    places = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(m).alias("measure"), place_among(F.col(c), edges[m]).alias("place"))) for m, (c, _, _, _) in measures.items()))
    counts = rows.select(F.explode(F.array_compact(places)).alias("p")).groupBy("p.measure", "p.place").agg(F.count("*").alias("c"))
    table = [(m, i, x, x == default, under) for m, (_, _, default, under) in measures.items() for i, x in enumerate(edges[m])]
    t = rows.sparkSession.createDataFrame(table, "measure string, place int, threshold double, is_default boolean, under boolean")
    total = Window.partitionBy("measure")
    upto = total.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    both = t.join(counts, ["measure", "place"], "full")  # the place after the last threshold has no threshold
    n = both.withColumn("_total", F.coalesce(F.sum("c").over(total), F.lit(0))).withColumn("_below", F.coalesce(F.sum("c").over(upto), F.lit(0))).where("threshold is not null")
    n = n.withColumn("n", F.when(F.col("under"), F.col("_below")).otherwise(F.col("_total") - F.col("_below")))
    n = n.withColumn("change", F.col("n") - F.max(F.when(F.col("is_default"), F.col("n"))).over(total))
    return n.select("measure", "threshold", "n", F.when(F.col("_total") > 0, F.col("n") / F.col("_total")).alias("share"), "change")


def threshold_sweep(rows: DataFrame, value: str, thresholds: list[float], default: float) -> DataFrame:
    """Rows under each threshold of one measure, their share, and the change against the default."""
    return threshold_sweeps(rows, {value: (value, thresholds, default, True)}).select("threshold", F.col("n").alias("n_under"), "share", "change")


def flip_zone(rows: DataFrame, keys: list[str], value: str, first: float, last: float, order: Column | None = None, k: int = 20) -> DataFrame:
    """The k keys whose verdict depends on the threshold within [first, last): each by its latest such row, the smallest `order` (the value) first.

    n_rows and n_keys are the size of the whole zone.
    """
    zone = rows.where((F.col(value) >= first) & (F.col(value) < last))
    latest = zone.groupBy(*keys).agg(F.max_by(F.struct("month_idx", F.col(value).alias("value")), "month_idx").alias("x"), F.count("*").alias("_rows"))
    size = latest.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    top = latest.select(*keys, "x.month_idx", "x.value").orderBy(F.col("value") if order is None else order, *keys).limit(k)
    return top.join(F.broadcast(size))


def replay(findings: DataFrame, raw: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Findings' current windows summed again from raw rows (keys, month_idx, value) and compared."""
    months = findings.select(*keys, "month_idx", "value_current").withColumn("at", F.explode(F.sequence(F.col("month_idx") - 11, F.col("month_idx"))))
    again = months.join(raw.groupBy(*keys, F.col("month_idx").alias("at")).agg(F.sum("value").alias("v")), [*keys, "at"]).groupBy(*keys, "month_idx", "value_current").agg(F.sum("v").cast("double").alias("replayed"))
    return again.withColumn("matches", F.abs(F.col("replayed") - F.col("value_current")) <= tolerance * F.greatest(F.abs("value_current"), F.lit(1.0)))


def publish_due(data: DataFrame, published: DataFrame) -> DataFrame:
    """Whether the latest data month is newer than the last published one."""
    return data.agg(F.max("month_idx").alias("data_idx")).join(F.broadcast(published.agg(F.max("month_idx").alias("published_idx")))).withColumn("due", F.coalesce(F.col("data_idx") > F.col("published_idx"), F.lit(True)))


def lookups_present(lookups: dict[str, DataFrame]) -> list[str]:
    """Names of lookups that are empty."""
    return [n for n, df in lookups.items() if df.isEmpty()]


def require_lookups(lookups: dict[str, DataFrame]) -> None:
    """Fails where a lookup is empty, as joins with it would silently lose every row."""
    if missing := lookups_present(lookups):
        raise ValueError(f"empty lookups: {', '.join(sorted(missing))}")


def notification_mark(log: DataFrame, kind: str, fallback: Column) -> DataFrame:
    return log.agg(F.coalesce(F.max(F.when(F.col("result") == kind, F.col("checked_at"))), fallback).alias("mark"))
