"""The round log as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def round_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """A running summary for a live view: the last round and the best accuracy so far."""
    return log.groupBy().agg(F.max("round").alias("last_round"), F.max("global_acc").alias("best_acc"), F.sum("comms_mb").alias("comms_mb"))
