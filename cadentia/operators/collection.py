"""Whole collections in figures: summaries, statistics and cluster profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import library, summaries
from .views import clock2, dominant

#: Columns of a collection's tracks: filename, duration, tempo, energy, brightness, key, mood, character.
LABELS = ("key", "mood", "character")


def _common(df: DataFrame, label: str, order: str) -> DataFrame:
    """One row: the most frequent value of a label, of equal ones the first in order, and how many there are."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return n.agg(F.min_by(label, F.struct(-F.col("n"), "at")).alias(f"common_{label}"), F.count("*").alias(f"unique_{label}s"))


def summary(tracks: DataFrame, phases: DataFrame | None = None, order: str = "filename") -> DataFrame:
    """One row of figures on a collection: files, durations, ranges and deviations of tempo, energy and brightness,
    the most frequent key, mood and character with their numbers, and statistics of the phases if there are any."""
    spread = [e for c in ("tempo", "energy", "brightness") for e in (F.avg(c).alias(f"avg_{c}"), (F.max(c) - F.min(c)).alias(f"{c}_range"), F.stddev_samp(c).alias(f"{c}_std"))]
    one = tracks.agg(
        F.count("*").alias("total_files"), F.sum("duration").alias("total_duration_seconds"), (F.sum("duration") / 60).alias("total_duration_minutes"),
        F.avg("duration").alias("avg_duration_seconds"), (F.avg("duration") / 60).alias("avg_duration_minutes"), *spread,
    )
    for label in LABELS:  # one row each
        one = one.crossJoin(F.broadcast(_common(tracks, label, order)))
    return one.crossJoin(F.broadcast(summaries.phase_statistics(phases))) if phases is not None else one


# The unit of a metric, by the first of these that its name holds.
UNITS = (("minutes", "minutes"), ("duration", "seconds"), ("tempo", "BPM"), ("brightness", "Hz"), ("energy", "RMS"))


def long(one: DataFrame) -> DataFrame:
    """(metric, value as text, unit) of a row of figures."""
    told = one.select(*[F.col(c).cast("string").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value")
    unit: Column = F.lit("")
    for part, name in reversed(UNITS):
        unit = F.when(F.col("metric").contains(part), name).otherwise(unit)
    return told.withColumn("unit", unit)


def statistics(tracks: DataFrame, phases: DataFrame, clusters: DataFrame, sequence: DataFrame) -> DataFrame:
    """One row of nested figures on tracks, phases(filename, phase_type), clusters(cluster, a row for each track) and sequence(position, duration, tempo, energy)."""
    span = lambda c: F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    n = F.count("*")
    one = tracks.agg(
        n.alias("tracks"), F.sum("duration").alias("duration"), F.avg("duration").alias("mean_duration"), span("tempo").alias("tempo"),
        (F.count_distinct("key") / n).alias("key_diversity"), (F.count_distinct("mood") / n).alias("mood_diversity"),
    )
    per = phases.groupBy("filename").agg(n.alias("n")).agg(F.sum("n").alias("total"), F.avg("n").alias("mean"))
    p = per.crossJoin(F.broadcast(phases.agg(F.count_distinct("phase_type").alias("types")))).select(F.struct("total", "mean", "types").alias("phases"))
    c = clusters.groupBy("cluster").agg(n.alias("n")).agg(F.struct(n.alias("clusters"), F.max("n").alias("largest"), F.min("n").alias("smallest")).alias("clusters"))
    s = sequence.agg(F.struct(
        F.sum("duration").alias("duration"), F.min("tempo").alias("slowest"), F.max("tempo").alias("fastest"), F.min_by("energy", "position").alias("first_energy"), F.max_by("energy", "position").alias("last_energy"),
    ).alias("sequence"))
    return one.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(s))  # one row each


def cluster_profiles(df: DataFrame, cluster: str = "cluster", key: str = "filename") -> DataFrame:
    """One row a cluster: its tracks, means and sample deviations, labels, structure, homogeneity and coherence.

    df has a row for each track with tempo, duration, energy, brightness, key, mood, character, num_phases, has_climax and
    has_breakdown. The names of a cluster's tracks are one sorted list: it grows with the cluster, as the table that it feeds does.
    """
    pair = lambda c: (F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"{c}_std"))
    percent = lambda c: (F.count_if(F.col(c)) * 100.0 / F.count("*")).alias(f"{c.removeprefix('has_')}_percent")
    g = df.groupBy(cluster).agg(
        F.count("*").alias("count"), F.array_sort(F.collect_list(key)).alias("files"), *pair("tempo"), *pair("duration"), *pair("energy"), *pair("brightness"),
        F.avg("num_phases").alias("avg_phases"), percent("has_climax"), percent("has_breakdown"), *[F.count_distinct(c).alias(f"{c}_diversity") for c in LABELS],
    )
    for label, name in (("key", "common_key"), ("mood", "dominant_mood"), ("character", "dominant_character")):
        g = g.join(dominant(df, cluster, label, key).select(cluster, F.col(label).alias(name)), cluster, "left")
    g = g.join(library.homogeneity(df, cluster, ["tempo", "energy", "brightness"]), cluster, "left")
    return g.join(library.coherence(df, cluster, "tempo", "key", "mood", "energy").select(cluster, "coherence"), cluster, "left")


def cluster_table(profiles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Profiles under the 24 names of the exported table."""
    c = F.col
    # Names and order of the columns
    return profiles.select(
        F.concat(F.lit("Cluster_"), c(cluster).cast("string")).alias("cluster_name"), c(cluster).cast("string").alias("cluster_id"), c("count").alias("track_count"), F.array_join("files", "; ").alias("track_files"),
        c("avg_tempo").alias("avg_tempo_bpm"), "tempo_std", c("avg_duration").alias("avg_duration_seconds"), (c("avg_duration") / 60).alias("avg_duration_minutes"), c("duration_std").alias("duration_std_seconds"),
        "avg_energy", "energy_std", c("avg_brightness").alias("avg_brightness_hz"), "brightness_std", F.coalesce("common_key", F.lit("Unknown")).alias("common_key"), "key_diversity", "avg_phases",
        c("climax_percent").alias("climax_percentage"), c("breakdown_percent").alias("breakdown_percentage"), F.coalesce("dominant_mood", F.lit("Unknown")).alias("dominant_mood"), "mood_diversity",
        F.coalesce("dominant_character", F.lit("Unknown")).alias("dominant_character"), "character_diversity", F.coalesce("homogeneity", F.lit(0.0)).alias("homogeneity_score"), c("coherence").alias("musical_coherence"),
    )


def phase_table(phases: DataFrame, key: str = "filename") -> DataFrame:
    """Phases(key, phase_number, phase_type, start_time, end_time, duration, energy, brightness, roughness, onset, moods) under the 19 names of the exported table."""
    c = F.col
    whole = phases.groupBy(key).agg(F.max("end_time").alias("_total"), F.count("*").alias("_n"))
    # Names and order of the columns
    return phases.join(whole, key).select(
        c(key).alias("filename"), c("_total").alias("total_duration_seconds"), (c("_total") / 60).alias("total_duration_minutes"), c("_n").alias("total_phases"), "phase_number", "phase_type",
        c("start_time").alias("start_time_seconds"), c("end_time").alias("end_time_seconds"), c("duration").alias("duration_seconds"), (c("duration") / 60).alias("duration_minutes"),
        c("energy").alias("avg_energy"), c("brightness").alias("avg_brightness_hz"), c("roughness").alias("avg_roughness"), c("onset").alias("onset_density_per_second"),
        F.array_join("moods", ", ").alias("mood_descriptors"), F.greatest(F.size("moods"), F.lit(0)).alias("mood_count"),
        clock2(c("start_time")).alias("start_time_formatted"), clock2(c("end_time")).alias("end_time_formatted"), library.clock(c("duration"), True).alias("duration_formatted"),
    )


def sequence_table(sequence: DataFrame, within: str | None = None) -> DataFrame:
    """A sequence(position, filename, duration, tempo, key, mood, character, energy, reasoning) under the names of the exported table."""
    c = F.col
    s = library.running_total(sequence, "position", "duration", within)
    # Names and order of the columns
    return s.select(
        *([within] if within else []), "position", "filename", c("duration").alias("duration_seconds"), (c("duration") / 60).alias("duration_minutes"), library.clock(c("duration"), True).alias("duration_formatted"),
        c("tempo").alias("tempo_bpm"), "key", c("mood").alias("primary_mood"), c("character").alias("primary_character"), c("energy").alias("energy_level"), "reasoning",
        c("position_pct").alias("position_percentage"), c("total").alias("cumulative_duration_seconds"), (c("total") / 60).alias("cumulative_duration_minutes"),
    )
