"""Cutting lineage with checkpoints in the folder that the cluster shares; numbers by hash that any engine can repeat."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset a local session gets a folder of its own, a
    cluster an error: its executors would not see the driver's folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, read again: like cut(), but its last stage runs once."""
    path = f"{shared_dir(df.sparkSession)}/strandline/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with its rank, from 1, in the order of the columns: ranks within range partitions, plus the rows of those before.

    The one window over all is over a row for each partition. Rows alike in all columns are ranked in some order."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    local = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    return local.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_k")).select(*df.columns, name)


def md5_number(*parts: Column, digits: int = 13) -> Column:
    """The first hexadecimal digits of md5 of the parts joined by `:`, as a number: the same in Spark and SQL."""
    text = F.concat_ws(":", *[x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")
