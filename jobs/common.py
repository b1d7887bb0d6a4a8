"""What the jobs share: configuration, logging, writing and reading of partitioned tables."""

from __future__ import annotations

import json
import logging
import tomllib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("strandline.jobs")


def shipped_config(name: str) -> dict:
    """The configuration beside the job's file."""
    return tomllib.loads(Path(__file__).with_name(f"{name}.toml").read_text())


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration anywhere that Spark reads."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes df by partitions; those that it has rows of are replaced, others stay. A large partition gets several files."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def hold_config(spark: SparkSession, path: str, config: dict) -> None:
    """Raises where the output at path was begun with another configuration: its rows could not be put together with new ones."""
    now = json.dumps(config, sort_keys=True)
    held = table_or_empty(spark, path, "config string").first()
    if held is None:
        spark.createDataFrame([(now,)], "config string").coalesce(1).write.mode("overwrite").parquet(path)
    elif held["config"] != now:
        raise ValueError(f"{path} holds another configuration; give a new folder for output and checkpoint")
