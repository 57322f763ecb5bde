"""Small views of tracks and phases: buckets, colours, names, clocks, counts in order of appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .library import bucket, unpivot

# The role of each phase type, the limits of complexity and of places in an arc, and the colours of tension.
ROLES = {
    "Intro/Ambient": "Opening/Atmospheric", "Introduction": "Opening", "Build-up/Energetic": "Development/Tension", "Rhythmic/Percussive": "Rhythmic Foundation",
    "Bright/Melodic": "Melodic Focus", "Climax/Peak": "Climactic/Peak Energy", "Development": "Musical Development", "Breakdown/Quiet": "Tension Release",
    "Conclusion": "Closing", "Outro/Fade": "Closing/Fade",
}
OTHER_ROLE = "Developmental"
COMPLEXITY = ([(0.5, "Simple"), (1.0, "Moderate")], "Complex")
ARC = ([(0.25, "Opening Quarter"), (0.5, "First Half"), (0.75, "Second Half")], "Closing Quarter")
COLOURS = ([(0.15, "#607D8B"), (0.30, "#4FD1C5"), (0.60, "#4FD1C5"), (1.01, "#F4C471")], "#4FD1C5")
LAST_PLACE = 9999


def complexity(phases: Column, seconds: Column) -> Column:
    """By phases a minute; null for a piece without duration."""
    return bucket(F.try_divide(phases.cast("double"), seconds / 60), *COMPLEXITY)


def arc_position(position: Column, total: Column) -> Column:
    """By the share of a sequence that lies behind a position, counted from 1."""
    return bucket(F.try_divide(position.cast("double"), total), *ARC)


def role(phase_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(phase_type, F.lit(""))), F.lit(OTHER_ROLE))


def tension_colour(v: Column) -> Column:
    """The colour of a tension; below 0 the one for values outside of all limits."""
    return F.when(v < 0, COLOURS[1]).otherwise(bucket(v, *COLOURS))


def slug(name: Column) -> Column:
    """Lower-case letters and digits of a name without its suffix, with hyphens between."""
    plain = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def track_name(filename: Column) -> Column:
    """A file's name without suffix, what stands before ___, and a leading number."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    stem = F.when(F.instr(stem, "___") > 0, F.regexp_replace(stem, "^.*?___", "")).otherwise(stem)
    return F.trim(F.regexp_replace(stem, r"^[0-9]+[\s\-_.]+", ""))


def title(label: Column) -> Column:
    """Words of a label with spaces for underscores, each with a capital."""
    return F.initcap(F.translate(label, "_", " "))


def clock2(seconds: Column) -> Column:
    """MM:SS; minutes run on past an hour."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def stamp(ts: Column) -> Column:
    """A moment as yyyymmdd_HHMMSS."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def score(value: Column, least: Column, most: Column, flat: float = 0.5) -> Column:
    """value within least..most as 0..1; flat where they are equal."""
    return F.when(most == least, F.lit(flat)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - least) / (most - least))))


def value_counts(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, n, first, place): how often each value occurs, most frequent first; of equal counts the one seen first in order.

    The ranking window holds one row for each value, not for each row of df.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first")))


def dominant(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key; of equal counts the one seen first in order."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return n.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "_first")).alias("x")).select(key, "x.*")


def label_summary(df: DataFrame, label: str, vocabulary: list[dict], categories: tuple[str, ...]) -> DataFrame:
    """One row about the labels of tracks: total, unique, the share of each category, and diversity: unique by the vocabulary's size."""
    names = rules.as_table(df.sparkSession, [{"name": r["name"], "category": r["category"]} for r in vocabulary])
    j = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).join(F.broadcast(names), F.col(label) == F.col("name"), "left")
    total = F.sum("n")
    shares = [F.coalesce(F.try_divide(F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).cast("double"), total), F.lit(0.0)).alias(f"{c}_ratio") for c in categories]
    return j.agg(F.coalesce(total, F.lit(0)).alias("total"), F.count("*").alias("unique"), *shares, (F.count("*") / len(vocabulary)).alias("diversity"))


def variance_ranks(df: DataFrame, columns: list[str], top: int = 10, bottom: int = 5) -> DataFrame:
    """(feature, variance, side, place): the columns of most and of least sample variance."""
    v = unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns).groupBy("feature").agg(F.var_samp("value").alias("variance"))
    by = Window.orderBy(F.desc_nulls_last("variance"), "feature")  # one row for each column
    r = v.withColumn("place", F.row_number().over(by)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    high = r.where(F.col("place") <= top).select("feature", "variance", F.lit("high").alias("side"), "place")
    low = r.where(F.col("place") > F.col("_n") - bottom).select("feature", "variance", F.lit("low").alias("side"), (F.col("place") - F.greatest(F.col("_n") - bottom, F.lit(0))).alias("place"))
    return high.unionByName(low)


def in_sequence(tracks: DataFrame, sequence: DataFrame, key: str = "filename") -> DataFrame:
    """tracks with place: their position in a sequence, LAST_PLACE for those that it lacks."""
    at = sequence.select(F.col(key).alias("_k"), F.col("position").alias("_p"))
    return tracks.join(at, F.col(key) == F.col("_k"), "left").withColumn("place", F.coalesce("_p", F.lit(LAST_PLACE))).drop("_k", "_p")


def with_paths(features: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """features with the path of the file of that name; of several files of one name the first path."""
    first = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("_name")).agg(F.min("path").alias("path"))
    return features.join(first, F.col(key) == F.col("_name")).drop("_name")


def latest(paths: DataFrame, column: str = "path") -> DataFrame:
    """The export with the greatest path: its folders carry their time in their names."""
    return paths.agg(F.max(column).alias(column))
