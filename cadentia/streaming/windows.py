"""The window operators over streams of events: tumbling, sliding and session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet event files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, key: str, length: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    return _sums(df.withWatermark("ts", late), key, F.window("ts", length))


def sliding(df: DataFrame, key: str, length: str = "32 seconds", step: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    return _sums(df.withWatermark("ts", late), key, F.window("ts", length, step))


def sessions(df: DataFrame, key: str, gap: str = "1 hour", late: str = "1 minute") -> DataFrame:
    return _sums(df.withWatermark("ts", late), key, F.session_window("ts", gap))


def _sums(df: DataFrame, key: str, window) -> DataFrame:
    g = df.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("energy"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "energy")
