"""From a folder of recordings, or from payloads, to all tables of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, clusters, collection, flow, insights, labels, library, sections, views
from ..sources import audio
from .shared import settle

#: Column of the rules and the feature that it is read from.
COLUMNS = {
    "energy": "rms_mean", "brightness": "spectral_centroid_mean", "centroid": "spectral_centroid_mean", "roughness": "spectral_roughness", "onset": "onset_density",
    "bandwidth": "spectral_bandwidth_mean", "rolloff": "spectral_rolloff_mean", "zcr": "zero_crossing_rate_mean", "duration": "duration", "tempo": "tempo", "key_confidence": "key_confidence",
    "flatness": "spectral_flatness_mean", "flux": "spectral_flux_mean", "stereo": "stereo_width",
}


def feature_names() -> list[str]:
    """Names of the numbers in a feature record."""
    import numpy as np

    from ..functions import signal

    one = signal.features(np.zeros(signal.N_FFT), 22050)
    return [k for k, v in one.items() if not isinstance(v, str)]


def feature_table(got: DataFrame) -> DataFrame:
    """A column for every feature of audio.features' usable files."""
    return got.where("error is null").select("filename", "key", *[F.col("features")[k].alias(k) for k in feature_names()])


def track_table(features: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """Tracks with the columns that rules and sequences read, moods, tags and the structure of their phases."""
    spread = [F.col(f"mfcc_{i}_std") for i in range(1, 6)]
    t = features.select("filename", "key", *[F.col(f).alias(c) for c, f in COLUMNS.items()], (sum(spread[1:], spread[0]) / 5).alias("timbre_variance"))
    row = t.select(F.struct("*").alias("_t"), "*")
    moods = labels.mood_scores(row, key="_t").select(F.col("_t.filename").alias("filename"), "moods", "primary_mood", "mood_confidence")
    tags = labels.character_scores(row, key="_t").select(F.col("_t.filename").alias("filename"), "tags", "primary_character", "character_confidence")
    out = t.join(moods, "filename").join(tags, "filename").withColumns({"mood": F.col("primary_mood"), "character": F.col("primary_character")})
    return flow.track_aggregates(out, phases) if phases is not None else out


def tables(files: DataFrame, sequence: bool = False, n_clusters: int | None = None) -> dict[str, DataFrame]:
    """Every table of a library of files(filename, content): features, rejected, tracks, phases, sections, narratives, edges, clusters, and
    with sequence the order to listen in. File names are expected to be unique."""
    got = settle(audio.features(files), "features")
    features = feature_table(got)
    valid, invalid = checks.split_valid(checks.feature_errors(features))
    rejected = got.where("error is not null").select("filename", "error").unionByName(invalid.select("filename", F.array_join("errors", "; ").alias("error")))
    frames, onsets = settle(audio.frames(files), "frames"), settle(audio.onsets(files), "onsets")
    phases = settle(flow.detect_phases(frames, onsets), "phases")
    tracks = settle(track_table(valid, phases), "tracks")
    points = settle(sections.tension(audio.trajectory(files)), "points")
    told = settle(flow.narrate(points, features.select("filename", "duration"), frames, onsets, settle=settle), "narratives")
    edges = sections.edges(sections.similar(told.select("filename", "structure", "texture")))
    out = {"features": valid, "rejected": rejected, "tracks": tracks, "phases": phases, "sections": told.select("filename", F.explode("sections").alias("s")).select("filename", "s.*"), "narratives": told, "edges": edges}
    grouped = clusters.kmeans(tracks, ["tempo", "energy", "brightness", "bandwidth", "zcr", "onset"], n_clusters)
    out["profiles"] = settle(collection.cluster_profiles(settle(grouped, "grouped")), "profiles")
    if sequence:
        out["sequence"] = settle(ordered(tracks), "sequence")
    return out


def ordered(tracks: DataFrame) -> DataFrame:
    """Tracks in the order to listen in, with the reason of each place."""
    s = library.sequence(tracks.select("filename", "energy", "tempo", "brightness", "duration", "key_confidence", "key", "mood", "character"))
    n = s.groupBy("playlist").agg(F.count("*").alias("_n"))
    return s.join(n, "playlist").withColumn("reasoning", library.reasoning(F.col("position"), F.col("_n"))).drop("_n").join(tracks, "filename")


def summaries_of(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The small tables that a report shows."""
    tracks, phases = t["tracks"], t["phases"]
    out = {
        "summary": collection.long(collection.summary(tracks, phases)), "distributions": views.value_counts(tracks, "mood", "filename"), "clusters": collection.cluster_table(t["profiles"]),
        "tracks": tracks.select("filename", views.track_name(F.col("filename")).alias("name"), library.clock(F.col("duration"), True).alias("duration"), views.title(F.col("mood")).alias("mood"), views.title(F.col("character")).alias("character"), "key"),
        "phases": phases.groupBy("filename").agg(F.count("*").alias("phases"), F.max("end_time").alias("seconds")), "narratives": t["narratives"].select("filename", "narrative"),
        "quality": library.data_quality(t["features"]), "features": library.feature_statistics(t["features"], ["tempo", "rms_mean", "spectral_centroid_mean"]),
        "insights": insights.cluster_advice(t["profiles"].select("cluster", F.col("avg_tempo").alias("tempo"), F.col("avg_energy").alias("energy"), "climax_percent", "breakdown_percent", "coherence")),
    }
    if "sequence" in t:
        out["sequence"] = collection.sequence_table(t["sequence"], "playlist")
    return out
