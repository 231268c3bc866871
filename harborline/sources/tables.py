"""Tables that change in part or appear as a whole: a pointer file, keyed snapshots, bucketed tables, clustered files.

Data are written by Spark to folders that nobody reads yet; then one small pointer file is replaced.  A reader who follows
the pointer sees the state before or after, and a run that fails or comes again changes nothing that is pointed at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "_current.json"


# ---- the pointer ----


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def switch(spark: SparkSession, path: str, said: dict) -> None:
    """Makes `said` what the pointer of a folder says, by one rename over the old file."""
    jvm = spark._jvm
    folder, store = _store(spark, path)
    store.mkdirs(folder)
    new, now = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"_next-{uuid.uuid4().hex}", POINTER))
    out = store.create(new)
    out.write(json.dumps(said).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(new), store.makeQualified(now), options)


def pointed(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says; None where there is none yet."""
    folder, store = _store(spark, path)
    now = spark._jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if not store.exists(now):
        return None
    source = store.open(now)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return json.loads(text)


# ---- keyed snapshots ----


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_keyed(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The snapshot that the pointer names, or some of its buckets; None where there is nothing."""
    said = pointed(spark, path)
    at = {} if said is None else {k: v for k, v in said["at"].items() if only is None or int(k) in only}
    if not at:
        return None
    # the pointer holds the schema, so that reading needs no look into a file
    return spark.read.schema(T.StructType.fromJson(said["schema"])).parquet(*(f"{path}/run={v}/bucket={k}" for k, v in sorted(at.items())))


def update_keyed(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], name: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """Merges a batch into a keyed snapshot; only buckets of its keys are read and written.  Returns these buckets.

    merge(old rows of these buckets or None, batch) gives their new rows; it must keep rows in their bucket.  Batches are told apart by name:
    one whose name is not above the last one changes nothing.  `buckets` is fixed by the first batch; choose it so that
    one is a file's size.
    """
    said = pointed(spark, path)
    if said is not None and name <= said["last"]:
        return []
    n = buckets if said is None else said["buckets"]
    batch = batch.persist()
    try:
        touched = sorted(r[0] for r in batch.select(bucket_of(keys, n)).distinct().collect())  # `buckets` rows at most
        if touched:
            old = read_keyed(spark, path, touched)
            new = merge(old, batch)
            # the name of a run that failed before the switch is not used again
            run = f"{name}-{uuid.uuid4().hex[:8]}"
            new.withColumn("bucket", bucket_of(keys, n)).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/run={run}")
            at = {k: v for k, v in ({} if said is None else said["at"]).items() if int(k) not in touched}
            at |= {k: run for k in _buckets_in(spark, f"{path}/run={run}")}
            switch(spark, path, {"last": name, "buckets": n, "at": at, "schema": new.schema.jsonValue()})
        return touched
    finally:
        batch.unpersist()


def _buckets_in(spark: SparkSession, run: str) -> list[str]:
    folder, store = _store(spark, run)
    names = (s.getPath().getName() for s in store.listStatus(folder))
    return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]


def vacuum_keyed(spark: SparkSession, path: str) -> int:
    """Deletes bucket folders that the pointer does not name; call it when no reader uses an older state.  Returns their number."""
    said, gone = pointed(spark, path), 0
    folder, store = _store(spark, path)
    if said is None:
        return 0
    named = {f"run={v}/bucket={k}" for k, v in said["at"].items()}
    for run in store.listStatus(folder):
        if run.getPath().getName().startswith("run="):
            for k in _buckets_in(spark, run.getPath().toString()):
                if f"{run.getPath().getName()}/bucket={k}" not in named:
                    gone += bool(store.delete(spark._jvm.org.apache.hadoop.fs.Path(run.getPath(), f"bucket={k}"), True))
    return gone


def upserted(old: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows and the old rows of other keys."""
    return batch if old is None else old.join(batch.select(*keys), keys, "left_anti").select(batch.columns).unionByName(batch)


# ---- bucketed tables ----


def write_bucketed(df: DataFrame, key: str, buckets: int, path: str) -> str:
    """A table at path in hash buckets of key, sorted by it; the name under which this session reads it.

    Joins and aggregates on the key read it without an exchange, and what keeps that partitioning is written without one.
    """
    name = f"t_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


# ---- clustered files ----


def write_clustered(df: DataFrame, path: str, by: list[str], order: list[str], files: int, group_bytes: int = 16 << 20, mode: str = "append") -> None:
    """df in folders by `by`, its rows range-partitioned and sorted by `order` within, in row groups of about group_bytes.

    A folder with many rows gets many files, cut at values of `order`; a reader's filters on `order` skip files, row groups and pages by their
    statistics.  A value of all of `by` and `order` that holds very many rows is one range; a further column in `order` splits it.
    """
    ranged = df.repartitionByRange(files, *by, *order).sortWithinPartitions(*by, *order)
    ranged.write.mode(mode).option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 2000).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


# ---- reports that appear as a whole ----


def publish_report(spark: SparkSession, sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> str:
    """Writes every sheet to a folder of this run, then switches the report's pointer to it; a sheet that fails leaves the old report."""
    run = uuid.uuid4().hex
    for name, df in sheets.items():
        getattr(df.write, form)(f"{path}/run={run}/{name}")
    switch(spark, path, {"run": run, "form": form, "sheets": sorted(sheets)})
    return run


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of the report that the pointer names; all are of one run."""
    said = pointed(spark, path)
    if said is None:
        raise FileNotFoundError(f"no report at {path}")
    return {n: getattr(spark.read, said["form"])(f"{path}/run={said['run']}/{n}") for n in said["sheets"]}
