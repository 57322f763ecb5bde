"""Tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the folder that spark.checkpoint.dir names, and read back: later plans begin at it.

    Without that setting df is cached, which keeps its plan: later steps are right but plan longer.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        return df.persist()
    path = f"{base.rstrip('/')}/cadentia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
