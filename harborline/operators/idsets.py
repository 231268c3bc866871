"""Sets of ids behind a result, as sorted chunks of bounded size that merge.

A set is a few rows of its key: chunk c of level n holds the ids whose hash begins with the n bits of c.  The level grows with the set, so
that a chunk has about `per_chunk` ids however many rows a key has; no array grows with the facts, and the ids of a hot key are grouped in
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that name the finest chunks.
FINE_BITS = 24


def _fine(id_: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_), 64 - FINE_BITS).cast("int")


def _leveled(fine: DataFrame, keys: list[str], per_chunk: int) -> DataFrame:
    """Rows (keys, fine, ids) joined to chunks of the level that the key's number of ids asks for."""
    n = fine.groupBy(*keys).agg(F.sum(F.size("ids")).alias("_n"))
    level = F.least(F.greatest(F.ceil(F.log2(F.col("_n") / F.lit(per_chunk))), F.lit(0)), F.lit(FINE_BITS)).cast("int")
    rows = fine.join(n.select(*keys, level.alias("level")), keys)
    chunk = F.floor(F.col("_fine") / F.pow(F.lit(2), F.lit(FINE_BITS) - F.col("level"))).cast("int")
    grouped = rows.groupBy(*keys, "level", chunk.alias("chunk")).agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return grouped.withColumn("n", F.size("ids"))


def id_sets(rows: DataFrame, keys: list[str], id_: str, per_chunk: int = 1024) -> DataFrame:
    """keys, level, chunk, ids (sorted, each once), n of the ids of rows; null ids count as none."""
    given = rows.where(F.col(id_).isNotNull()).select(*keys, F.col(id_).alias("_id"))
    fine = given.groupBy(*keys, _fine(F.col("_id")).alias("_fine")).agg(F.collect_set("_id").alias("ids"))
    return _leveled(fine, keys, per_chunk)


def merge_sets(a: DataFrame, b: DataFrame, keys: list[str], per_chunk: int = 1024) -> DataFrame:
    """The union of two sets of each key; chunks are taken apart and joined again where levels differ or grow."""
    both = a.select(*keys, F.explode("ids").alias("_id")).unionByName(b.select(*keys, F.explode("ids").alias("_id")))
    return id_sets(both, keys, "_id", per_chunk)


def set_sizes(sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_ids, first_id (the smallest)."""
    return sets.groupBy(*keys).agg(F.sum("n").alias("n_ids"), F.min(F.get("ids", F.lit(0))).alias("first_id"))


def members(sets: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """A row an id."""
    return sets.select(*keys, F.explode("ids").alias(name))
