"""Streams of checks: an extension. Rules are stateless; tallies take a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.rules import Registry, evaluate


def read_inputs(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def evaluate_stream(inputs: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Checks as their inputs arrive."""
    return evaluate(inputs, registry)


def tally_stream(checks: DataFrame, at: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by status in windows of time; rows later than `late` are left out."""
    grouped = checks.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.upper("status").alias("status")).count()
    return grouped.select(F.col("w.start").alias("window_start"), "status", F.col("count").alias("n_checks"))
