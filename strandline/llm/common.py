"""What several operators of this subpackage share: staged tables, worker state, Arrow helpers, Bloom filters."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset a local session gets a folder of its own, a
    cluster an error: its executors would not see the driver's folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage, fixes what tasks made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes every staged table; results that are not read yet become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Within it an Arrow batch for Python has at most so many rows. Long rows fill batches up to 64 MB, which the JVM holds twice
    beside its heap, with buffers that grow by doubling, and Python once. For actions: what runs later has the old setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_state() -> dict:
    """A dictionary that outlives the tasks of one Python worker."""
    return sys.modules.setdefault("_strandline_worker", types.ModuleType("_strandline_worker")).__dict__


def sliced(batches, rows: int = 1000):
    """Arrow batches in pieces of at most `rows` rows, so that what Python makes of one stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each value; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOOM_BITS = 1 << 25
BLOOM_SEEDS = (1, 2, 3)


def bloom(df: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a bigint column: at most bits/64 words reach the driver, whatever the number of rows.

    Beyond its capacity more values pass, so it may only stand before an exact join."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(s)), F.lit(bits)) for s in BLOOM_SEEDS])).alias("at")
    words = df.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("held"))
    out = np.zeros(bits // 64, np.uint64)
    table = words.toArrow()
    out[table["word"].to_numpy()] = table["held"].to_numpy().view(np.uint64)
    return out


def bloom_columns(column: str, bits: int = BLOOM_BITS) -> list:
    """The columns of bit positions that bloom_has() looks up."""
    return [F.pmod(F.xxhash64(F.col(column), F.lit(s)), F.lit(bits)).alias(f"_bloom{s}") for s in BLOOM_SEEDS]


def bloom_has(words: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    out = np.ones(batch.num_rows, bool)
    for s in BLOOM_SEEDS:
        at = batch[f"_bloom{s}"].to_numpy(zero_copy_only=False).astype(np.int64)
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return out
