"""From frames and onsets to phases, and from a trajectory to sections, their labels and narratives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels, narrative, phases, sections
from .intervals import in_interval

SAMPLE_RATE, HOP = 22050, 512
SMOOTH_S, APART_S = 2.0, 10.0
#: Seconds around the middle of a section from which it is labelled, and the least that will do.
SLICE_S, LEAST_SLICE_S = 20.0, 0.5
# What stands for the bandwidth and the rolloff of a phase, as shares of its brightness.
BANDWIDTH_SHARE, ROLLOFF_SHARE = 0.3, 1.5


def frame_range(seconds: Column, sr: int = SAMPLE_RATE, hop: int = HOP) -> Column:
    """The frame that a moment falls into."""
    return F.floor(seconds * sr / hop)


def phase_means(bounds: DataFrame, frames: DataFrame, onsets: DataFrame, key: str = "filename", sr: int = SAMPLE_RATE, hop: int = HOP) -> DataFrame:
    """bounds(key, phase_number, start_time, end_time) with duration, energy, brightness, roughness (the mean of the crossings) and onset:
    means over the frames frame_idx of each phase, and onsets(key, t) a second. Phases without a frame go."""
    ranges = bounds.select(key, "phase_number", frame_range(F.col("start_time"), sr, hop).alias("_from"), frame_range(F.col("end_time"), sr, hop).alias("_to"))
    inside = in_interval(frames.select(key, "frame_idx", "energy", "brightness", "zcr"), ranges.where("_to > _from"), "frame_idx", key, "_from", "_to", ("phase_number",))
    means = inside.groupBy(key, "phase_number").agg(*[F.avg(c).alias(n) for c, n in (("energy", "energy"), ("brightness", "brightness"), ("zcr", "roughness"))])
    hits = in_interval(onsets.select(key, "t"), bounds, "t", key, "start_time", "end_time", ("phase_number",)).groupBy(key, "phase_number").agg(F.count("*").alias("_onsets"))
    both = bounds.join(means, [key, "phase_number"]).join(hits, [key, "phase_number"], "left").withColumn("duration", F.col("end_time") - F.col("start_time"))
    return both.withColumn("onset", F.coalesce("_onsets", F.lit(0)) / F.col("duration")).drop("_onsets")


def phase_bounds(frames: DataFrame, key: str = "filename", sr: int = SAMPLE_RATE, hop: int = HOP) -> DataFrame:
    """(key, phase_number, start_time, end_time) from frames(key, frame_idx, energy, brightness): smoothed over two seconds, their
    change peaks ten seconds apart."""
    smooth = phases.moving_average(frames.select(key, "frame_idx", "energy", "brightness"), "energy", key, "frame_idx", int(sr / hop * SMOOTH_S), "smooth_energy")
    smooth = phases.moving_average(smooth, "brightness", key, "frame_idx", int(sr / hop * SMOOTH_S), "smooth_brightness")
    changed = phases.change_signal(smooth, key, "frame_idx", "smooth_energy", "smooth_brightness")
    peaks = phases.separated(phases.local_peaks(changed, key, "frame_idx"), key, "frame_idx", "change", int(sr / hop * APART_S))
    seconds = F.col("frame_idx") * hop / sr
    ends = frames.groupBy(key).agg((F.max("frame_idx") * hop / sr).alias("duration"))
    return phases.boundaries(peaks.select(key, seconds.alias("t")), ends, key)


def detect_phases(frames: DataFrame, onsets: DataFrame, key: str = "filename", sr: int = SAMPLE_RATE, hop: int = HOP) -> DataFrame:
    """Phases with bounds, means, position, phase_type and moods of every piece."""
    typed = phases.classify(phase_means(phase_bounds(frames, key, sr, hop), frames, onsets, key, sr, hop), key)
    return phase_moods(typed, key)


def phase_moods(typed: DataFrame, key: str = "filename") -> DataFrame:
    """Phases with moods: those of the rules that their means meet. Every row is scored by itself."""
    row = typed.withColumn("_row", F.struct(*typed.columns))
    rated = labels.mood_scores(row.select("_row", "energy", "brightness", "roughness", "onset", "duration", (F.col("brightness") * BANDWIDTH_SHARE).alias("bandwidth"), F.col("roughness").alias("zcr")), key="_row")
    return rated.select("_row.*", "moods")


def track_aggregates(tracks: DataFrame, phase_rows: DataFrame, key: str = "filename") -> DataFrame:
    """tracks with the structural features of their phases; null where a track has none."""
    return tracks.join(phases.structure(phase_rows, key), key, "left")


def detect_sections(points: DataFrame, durations: DataFrame, key: str = "filename") -> DataFrame:
    """Typed sections of every piece, from points(key, rn, time, energy, brightness, roughness, zcr, chroma_spread, tension) and durations(key, duration):
    limits from the change score, short ones merged, long ones split."""
    limits = sections.split_long(sections.boundaries(sections.change_score(points, key), durations, key), points, key)
    return sections.section_stats(sections.sections(limits, key), points, key)


def section_labels(secs: DataFrame, frames: DataFrame, onsets: DataFrame, key: str = "filename") -> DataFrame:
    """secs with mood, character and tags: the first of the rules that the means over the middle of a section meet.

    frames(key, t, energy, brightness, zcr, bandwidth, rolloff) and onsets(key, t) are looked up in the 20 seconds around
    the middle. Sections of under half a second, and those without a frame, are neutral and have no tags.
    """
    half = F.least(F.lit(SLICE_S), F.col("end") - F.col("start")) / 2
    mid = (F.col("start") + F.col("end")) / 2
    cuts = secs.select(key, "section", F.greatest(F.lit(0.0), mid - half).alias("_from"), (F.greatest(F.lit(0.0), mid - half) + 2 * half).alias("_to")).where(F.col("_to") - F.col("_from") >= LEAST_SLICE_S)
    inside = in_interval(frames.select(key, "t", "energy", "brightness", "zcr", "bandwidth", "rolloff"), cuts, "t", key, "_from", "_to", ("section",))
    means = inside.groupBy(key, "section", "_from", "_to").agg(*[F.avg(c).alias(c) for c in ("energy", "brightness", "zcr", "bandwidth", "rolloff")])
    hits = in_interval(onsets.select(key, "t"), cuts, "t", key, "_from", "_to", ("section",)).groupBy(key, "section").agg(F.count("*").alias("_n"))
    rows = means.join(hits, [key, "section"], "left").select(
        F.struct(key, "section").alias("_id"), "energy", "brightness", F.col("brightness").alias("centroid"), "bandwidth", "rolloff", "zcr", F.col("zcr").alias("roughness"),
        (F.coalesce("_n", F.lit(0)) / (F.col("_to") - F.col("_from"))).alias("onset"), (F.col("_to") - F.col("_from")).alias("duration"),
    )
    moods = labels.mood_scores(rows, key="_id").select(F.col(f"_id.{key}").alias(key), "_id.section", labels.dominant(F.col("moods")).alias("mood"))
    tags = labels.character_scores(rows, key="_id").select(F.col(f"_id.{key}").alias(key), "_id.section", "tags", labels.dominant(F.col("tags")).alias("character"))
    return secs.join(moods, [key, "section"], "left").join(tags, [key, "section"], "left")


def narrate(points: DataFrame, durations: DataFrame, frames: DataFrame | None = None, onsets: DataFrame | None = None, key: str = "filename", settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The narratives table of all pieces: sections with types, motion and labels, prose, fingerprints and similar pieces.

    settle is applied to what several steps read: sections and fingerprints.
    """
    typed = settle(detect_sections(points, durations, key))
    if frames is not None and onsets is not None:
        typed = section_labels(typed, frames, onsets, key)
    typed = settle(typed.join(sections.motion(typed, points, key), [key, "section"], "left"))
    structure, texture = settle(sections.structure_fingerprint(typed, key)), settle(sections.texture_fingerprint(points, key))
    return narrative.narratives(typed, structure, texture, sections.similar(structure.join(texture, key), key), key)
