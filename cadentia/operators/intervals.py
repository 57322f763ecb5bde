"""Points and the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_interval(points: DataFrame, intervals: DataFrame, at: str, key: str = "filename", start: str = "start", end: str = "end", carry: tuple[str, ...] = ()) -> DataFrame:
    """points with start, end and the carried columns of the interval [start, end) of their key that holds them; others go.

    Intervals of a key don't overlap. Both tables are sorted once by key and place and every point takes the last interval
    that began, so no point is paired with all intervals of its key.
    """
    names = {f"_p{i}": c for i, c in enumerate(points.columns)}
    iv = intervals.select(F.col(key).alias("_key"), F.col(start).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(start, end, *carry).alias("_iv"), *[F.lit(None).cast(points.schema[c].dataType).alias(n) for n, c in names.items()])
    own = points.select(F.col(key).alias("_key"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(iv.schema["_iv"].dataType).alias("_iv"), *[F.col(c).alias(n) for n, c in names.items()])
    by = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = iv.unionByName(own).withColumn("_held", F.last("_iv", ignorenulls=True).over(by)).where((F.col("_kind") == 1) & (F.col("_at") < F.col(f"_held.{end}")))
    return held.select(*[F.col(n).alias(c) for n, c in names.items()], *[F.col(f"_held.{c}").alias(c) for c in (start, end, *carry)])
