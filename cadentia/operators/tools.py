"""The answers of the remote tools as tables: one nested row for each track, piece, place or cluster, and one row of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import insights, library, summaries, views
from .views import clock2

# Names of the fields, as callers of the tools know them.


def mood_answer(tracks: DataFrame) -> DataFrame:
    """(filename, analysis, technical_properties) of tracks(filename, duration, tempo, key, energy, brightness, moods, primary_mood, mood_confidence, tags, primary_character, character_confidence)."""
    c = F.col
    return tracks.select(
        "filename",
        F.struct(
            F.coalesce("primary_mood", F.lit("unknown")).alias("primary_mood"), F.array_join("moods", ", ").alias("mood_descriptors"), F.coalesce("mood_confidence", F.lit(0.0)).alias("mood_confidence"),
            F.coalesce("primary_character", F.lit("unknown")).alias("primary_character"), F.array_join("tags", ", ").alias("character_tags"), F.coalesce("character_confidence", F.lit(0.0)).alias("character_confidence"),
        ).alias("analysis"),
        F.struct(
            c("duration").alias("duration_seconds"), (c("duration") / 60).alias("duration_minutes"), c("tempo").alias("tempo_bpm"), F.coalesce("key", F.lit("unknown")).alias("key"),
            c("energy").alias("energy_level"), c("brightness").alias("spectral_brightness_hz"),
        ).alias("technical_properties"),
    )


def mood_totals(tracks: DataFrame) -> DataFrame:
    return tracks.agg(
        F.count("*").alias("total_tracks"), F.count_distinct(F.coalesce("primary_mood", F.lit("unknown"))).alias("unique_moods"), F.count_distinct(F.coalesce("primary_character", F.lit("unknown"))).alias("unique_characters"),
        F.avg(F.coalesce("mood_confidence", F.lit(0.0))).alias("avg_confidence"), (F.sum("duration") / 60).alias("total_duration_minutes"),
    )


def _timing(prefix: str, c: Column) -> list[Column]:
    return [c.alias(f"{prefix}_seconds"), clock2(c).alias(f"{prefix}_formatted")]


def phase_answer(phases: DataFrame) -> DataFrame:
    """(filename, overall_structure, phases) of phases(filename, phase_number, phase_type, start_time, end_time, duration, energy, brightness, roughness, onset, moods)."""
    c = F.col
    one = F.struct(
        "phase_number",
        F.struct(*_timing("start_time", c("start_time")), *_timing("end_time", c("end_time")), *_timing("duration", c("duration"))).alias("timing"),
        F.struct("phase_type", c("moods").alias("mood_descriptors"), views.role(c("phase_type")).alias("structural_role")).alias("classification"),
        F.struct(
            c("energy").alias("avg_energy"), c("brightness").alias("avg_brightness_hz"), c("roughness").alias("avg_roughness"), c("onset").alias("onset_density_per_second"),
            library.bucket(c("energy"), *library.ENERGY).alias("energy_level"), library.bucket(c("brightness"), *library.BRIGHTNESS).alias("brightness_level"),
        ).alias("characteristics"),
    )
    g = phases.groupBy("filename").agg(F.max("end_time").alias("_t"), F.count("*").alias("_n"), F.array_sort(F.collect_list(one)).alias("phases"))
    whole = F.struct(*_timing("total_duration", c("_t")), c("_n").alias("num_phases"), views.complexity(c("_n"), c("_t")).alias("structural_complexity"))
    return g.select("filename", whole.alias("overall_structure"), "phases")


def phase_totals(phases: DataFrame) -> DataFrame:
    per = phases.groupBy("filename").agg(F.count("*").alias("n"), F.max("end_time").alias("t")).agg(F.count("*").alias("total_files"), F.sum("n").alias("total_phases"), F.avg("n").alias("avg_phases_per_track"), (F.sum("t") / 60).alias("total_duration_minutes"))
    return per.crossJoin(F.broadcast(phases.agg(F.count_distinct("phase_type").alias("unique_phase_types"))))  # one row each


def sequence_answer(sequence: DataFrame, within: str) -> DataFrame:
    """(within, position, filename, timing, musical_properties, sequencing) of ordered playlists(within, position, filename, duration, tempo, key, mood, character, energy)."""
    c = F.col
    w = Window.partitionBy(within)
    s = library.running_total(sequence, "position", "duration", within).withColumn("_n", F.count("*").over(w))
    return s.select(
        within, "position", "filename",
        F.struct(*_timing("duration", c("duration")), *_timing("cumulative_time", c("total"))).alias("timing"),
        F.struct(
            c("tempo").alias("tempo_bpm"), c("key").alias("detected_key"), c("mood").alias("primary_mood"), c("character").alias("primary_character"), c("energy").alias("energy_level"),
            library.bucket(c("tempo"), *library.TEMPO).alias("tempo_category"), library.bucket(c("energy"), *library.ENERGY).alias("energy_category"),
        ).alias("musical_properties"),
        F.struct(library.reasoning(c("position"), c("_n")).alias("placement_reasoning"), views.arc_position(c("position"), c("_n")).alias("position_in_arc")).alias("sequencing"),
    )


def sequence_totals(sequence: DataFrame, within: str) -> DataFrame:
    g = sequence.groupBy(within).agg(
        F.count("*").alias("total_tracks"), F.sum("duration").alias("total_duration_seconds"), F.min("tempo").alias("min_bpm"), F.max("tempo").alias("max_bpm"),
        F.min_by("energy", "position").alias("opening_energy"), F.max_by("energy", "position").alias("closing_energy"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "mood"))), lambda x: x["mood"]).alias("mood_journey"),
    )
    g = g.join(summaries.energy_ends(sequence, within), within)
    return g.withColumnRenamed("progression", "progression_type").withColumn("total_duration_formatted", clock2(F.col("total_duration_seconds")))


def cluster_answer(profiles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, cluster_info, musical_characteristics, creative_characteristics, structural_properties, recommendations) of cluster profiles."""
    c = F.col
    told = profiles.select("*", c("avg_tempo").alias("tempo"), c("avg_energy").alias("energy"))
    advice = insights.cluster_advice(told, cluster)
    return profiles.join(advice, cluster).select(
        cluster,
        F.struct(F.concat(F.lit("Cluster_"), c(cluster).cast("string")).alias("cluster_name"), c("count").alias("track_count"), c("files").alias("tracks")).alias("cluster_info"),
        F.struct(c("avg_tempo").alias("avg_tempo_bpm"), c("avg_duration").alias("avg_duration_seconds"), c("avg_energy").alias("avg_energy_level"), c("avg_brightness").alias("avg_brightness_hz"), "common_key", "avg_phases").alias("musical_characteristics"),
        F.struct("dominant_mood", "dominant_character", "mood_diversity", "character_diversity").alias("creative_characteristics"),
        F.struct(c("climax_percent").alias("climax_percentage"), c("breakdown_percent").alias("breakdown_percentage"), c("coherence").alias("structural_coherence")).alias("structural_properties"),
        c("advice").alias("recommendations"),
    )


def cluster_totals(profiles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Sizes, and the cluster called most coherent: that with the greatest share of climaxes, of equal ones the first."""
    return profiles.agg(
        F.sum("count").alias("total_tracks"), F.count("*").alias("num_clusters"), F.max("count").alias("largest_cluster_size"), F.min("count").alias("smallest_cluster_size"),
        F.min_by(cluster, F.struct(-F.col("climax_percent"), F.col(cluster))).alias("most_coherent_cluster"),
    )


def cluster_count(tracks: int, asked: int | None = None) -> int:
    """How many clusters a call gets: what it asks for, 5 otherwise, and no more than there are tracks."""
    return min(asked if asked is not None else 5, tracks)


def comprehensive(tracks: DataFrame, phases: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row about a collection: tracks, minutes, keys, tempo, the most frequent mood (of equal ones the smallest), clusters and phases."""
    one = tracks.agg(
        F.count("*").alias("total_tracks"), (F.sum("duration") / 60).alias("total_duration_minutes"), F.count_distinct("key").alias("unique_keys"), F.avg("tempo").alias("avg_tempo_bpm"),
        F.coalesce(F.mode("mood", True), F.lit("Unknown")).alias("dominant_mood"),
    )
    p = phases.groupBy("filename").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_phases"), F.avg("n").alias("avg_phases_per_track"))
    return one.crossJoin(F.broadcast(profiles.agg(F.count("*").alias("num_clusters")))).crossJoin(F.broadcast(p))  # one row each
