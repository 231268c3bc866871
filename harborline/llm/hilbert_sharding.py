"""Hilbert-curve ordering of documents, cut into shards; DataFrame functions only.

Each metadata dimension is quantised to 2**bits cells of about equal row counts: numbers by approximate percentiles,
strings by the whole values at which the running total of rows, in the order of the values, passes each 2**bits-th
of all rows (at most 2**bits - 1 values for each dimension reach the driver).  The cells' Hilbert index
orders the rows.  Equal texts are one group: all of its rows take the group's lowest index, and ties go by
text and id, so that a group is one stretch of the order.  Ranks come from a range partitioned sort (a partition's
offset plus the place in it), and runs of equal row counts are the shards: a file of one run
spans a small box of every dimension, which min/max statistics can prune.

Law: `rows`, so counts of shards differ by one at most.  The borders between shards follow from that
law alone, so each of them may cut one group (and must, where a group is larger than a shard); no other group
is spread over shards.  Only narrow rows are shuffled, never texts; they are written once, before the sort reads them.

Edge cases: null texts count as empty; null metadata is the smallest value; ties and repeated rows
share a cell and are ordered by id; an empty table gives an empty result; with fewer rows than
shards some shards stay empty; columns of the input with the names of results are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import kept, small_or_not, table


@dataclass(frozen=True)
class Settings:
    shards: int = 8
    bits: int = 6  # cells of a dimension: 2**bits
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars")
    accuracy: int = 2000  # of the percentiles


def string_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """The values at which the running total of rows passes each 1 / cells of all rows; cells - 1 at most."""
    counts = df.groupBy(F.coalesce(F.col(name), F.lit("")).alias("v")).agg(F.count("*").alias("n"))
    placed = kept(counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum("n").alias("of_part"))  # a row for each partition
    before = sizes.select("_part", (F.sum("of_part").over(Window.orderBy("_part")) - F.col("of_part")).alias("before"), F.sum("of_part").over(Window.partitionBy(F.lit(0))).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
    steps = lambda c: F.floor(c * cells / F.col("total"))
    totals = placed.join(F.broadcast(before), "_part").withColumn("upto", upto)
    found = totals.where((F.col("upto") < F.col("total")) & (steps(F.col("upto")) > steps(F.col("upto") - F.col("n")))).select("v").collect()
    return sorted((r.v for r in found), key=str.encode)


def hilbert_index(cells: Column, n: int, bits: int) -> Column:
    """The place on the Hilbert curve of an array of n cell numbers of `bits` bits (Skilling's transform)."""
    flip = lambda y, p: F.transform(y, lambda v, k: F.when(k == 0, v.bitwiseXOR(p)).otherwise(v))

    def swap(y: Column, i: Column, p: Column) -> Column:
        t = F.get(y, F.lit(0)).bitwiseXOR(F.get(y, i)).bitwiseAND(p)
        return F.transform(y, lambda v, k: F.when((k == 0) | (k == i), v.bitwiseXOR(t)).otherwise(v))

    power = lambda q: F.expr("1").cast("int") * F.pow(F.lit(2), q).cast("int")

    def undo(x: Column, q: Column) -> Column:
        low = power(q) - 1
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)),
            x,
            lambda y, i: F.when(F.get(y, i).bitwiseAND(power(q)) != 0, flip(y, low)).otherwise(swap(y, i, low)),
        )

    levels = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1))
    x = F.aggregate(levels, cells, undo) if bits > 1 else cells
    gray = F.transform(x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, c: a.bitwiseXOR(c)))
    last = lambda g: F.get(g, F.lit(n - 1))
    twist = lambda g: F.aggregate(levels, F.lit(0), lambda t, q: F.when(last(g).bitwiseAND(power(q)) != 0, t.bitwiseXOR(power(q) - 1)).otherwise(t)) if bits > 1 else F.lit(0)
    # a one-element array binds the gray code and the twist to a name, so that each is computed once
    out = F.transform(F.array(gray), lambda g: F.transform(F.array(twist(g)), lambda t: F.transform(g, lambda v: v.bitwiseXOR(t))))
    turned = F.get(F.get(out, F.lit(0)), F.lit(0))
    digits = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    bit = lambda v, q: F.floor(v / power(q)).cast("long") % 2
    interleave = lambda y: F.aggregate(digits, F.lit(0).cast("long"), lambda h, q: F.aggregate(y, h, lambda a, v: a * 2 + bit(v, q)))
    return F.get(F.transform(F.array(turned), interleave), F.lit(0))


def cells_of(df: DataFrame, s: Settings) -> Column:
    """The array of each row's cells."""
    kinds, cells = dict(df.dtypes), 1 << s.bits
    share = F.array(*(F.lit(i / cells) for i in range(1, cells)))
    number = lambda d: F.coalesce(F.col(d).cast("double"), F.lit(float("-inf")))
    numbers = [d for d in s.dimensions if kinds[d] != "string"]
    found = df.agg(F.count("*").alias("_rows"), *(F.percentile_approx(number(d), share, F.lit(s.accuracy)).alias(d) for d in numbers)).first()
    cuts = {d: (number(d), sorted(set(found[d] or []))) for d in numbers}
    cuts |= {d: (F.coalesce(F.col(d), F.lit("")), string_cuts(df, d, cells)) for d in s.dimensions if kinds[d] == "string"}
    cell = lambda v, at: sum((F.when(v > F.lit(c), 1).otherwise(0) for c in at), F.lit(0))
    return F.array(*(cell(*cuts[d]).cast("int") for d in s.dimensions))


def assignments(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot for every row of df (doc_id, text, dimensions)."""
    text = F.coalesce("text", F.lit(""))
    body = F.encode(text, "UTF-8")
    rows = kept(df.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        hilbert_index(cells_of(df, s), len(s.dimensions), s.bits).alias("hilbert"), F.xxhash64(text).alias("_text"),
    ))
    group = ["_text", "text_crc32", "size"]
    lowest = rows.groupBy(*group).agg(F.min("hilbert").alias("_lowest"), F.max("hilbert").alias("_highest")).where("_lowest < _highest").drop("_highest")
    rows = rows.join(small_or_not(kept(lowest)), group, "left").withColumn("hilbert", F.coalesce("_lowest", "hilbert")).drop("_lowest")
    order = ["hilbert", *group, "doc_id"]
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_text"))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    shard = F.expr(f"(_rank * {s.shards}) div _total")
    begin = F.expr(f"(shard * _total + {s.shards - 1}) div {s.shards}")
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", rank).withColumn("shard", shard)
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", F.col("shard").cast("int").alias("shard"), (F.col("_rank") - begin).alias("slot"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assignments(table(spark, sf_dir, "documents"))
    return a.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
