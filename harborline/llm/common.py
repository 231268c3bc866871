"""What several operators share: tables, byte n-grams, size-checked broadcasts, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count shows at most this many rows of a few bytes each.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as decimal text (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


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
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of our own in the shared folder, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


_held: dict[str, object] = {}


def held(name: str, make):
    """A worker's one object that outlives a task (a vocabulary, a mapped model); another name replaces it."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Drops what a worker holds and gives free memory back to the system, as idle workers stay alive."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def byte_grams(offsets: np.ndarray, body: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first): buckets of all byte n-grams of each text; first[i] is where text i begins in them."""
    n = len(body)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(np.maximum(np.diff(offsets) - size + 1, 0), out=first[1:])
    if n < size:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = np.zeros(n - size + 1, np.uint32)
    for k in range(size):
        h = h * np.uint32(0x01000193) + body[k : n - size + 1 + k] + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    h = h[doc[: n - size + 1] == doc[size - 1 :]]  # n-grams across a border belong to no text
    return (h & np.uint32((1 << bits) - 1)).astype(np.int64), first
