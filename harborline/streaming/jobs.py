"""Structured Streaming jobs: running monthly totals of arriving files, and the ledger fed by micro-batches.

Both keep a keyed snapshot: a micro-batch reads and writes the hash buckets of its own keys only, and becomes visible by one
switch of a pointer.  A batch that comes again after its switch changes nothing; one that failed before it left nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harborline.operators.ledger import merge_findings
from harborline.sources.tables import update_keyed, upserted

LEDGER = "id string, nk string, sig string, subkind string, created_at timestamp, last_confirmed_at timestamp, superseded_at timestamp, superseded_by_id string"


def stream_monthly_totals(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, keys: list[str], buckets: int = 64) -> StreamingQuery:
    """Totals per (keys, month_idx) of Parquet files that arrive in path, in update mode."""
    every = [*keys, "month_idx"]
    rows = spark.readStream.schema(schema).parquet(path)
    totals = rows.groupBy(*every).agg(F.sum("value_eur").alias("value"), F.count("*").alias("n_rows"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        update_keyed(batch.sparkSession, out, batch, every, f"{batch_id:012d}", lambda old, new: upserted(old, new, every), buckets)

    return totals.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ledger_merge(findings: DataFrame, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """A stream of findings (nk, sig, subkind, run_ts) merged into the ledger batch by batch, at the batch's latest run_ts."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ts = batch.agg(F.max("run_ts")).first()[0]

        def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return merge_findings(spark.createDataFrame([], LEDGER) if old is None else old, new, F.lit(ts)).drop("action")

        if ts is not None:
            update_keyed(spark, out, batch, ["nk"], f"{batch_id:012d}", merged, buckets)

    return findings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
