"""Writing layers: append, period replacement, upserts, results kept in the shared folder.  `tables` has those that change in part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: for a small result that several branches of a plan read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: as `kept`, but a plain table to the optimizer."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_raw(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("period").parquet(path)


def replace_period(df: DataFrame, path: str) -> None:
    """Replaces the periods of df and no others; refuses an empty replacement."""
    if df.isEmpty():
        raise ValueError("an empty replacement would delete a period")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def upsert_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming wins."""
    return existing.join(incoming.select(*keys), keys, "left_anti").select(existing.columns).unionByName(incoming)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing wins."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def upsert_coalesce(existing: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The new value of each column, or the old one where the new one is null."""
    new = incoming.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols))
    j = existing.join(new, keys, "full")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in existing.columns))


_made: dict[tuple[str, str], str] = {}


def once(spark: SparkSession, name: str, make) -> DataFrame:
    """make() written to the shared folder the first time that this application asks for the name; later askers read it."""
    key = (spark.sparkContext.applicationId, name)
    if key in _made:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{_made[key]}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            del _made[key]
    if key not in _made:
        path = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])
