"""Checks of features, phases and tracks as lists of what is wrong; a row passes with an empty list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a feature record, a phase, a spectrum and a track of a sequence must have.
REQUIRED_FEATURES = ("spectral_centroid_mean", "spectral_rolloff_mean", "spectral_bandwidth_mean", "zero_crossing_rate_mean", "rms_mean", "tempo", "key")
PHASE_FIELDS = ("avg_energy", "avg_brightness", "avg_roughness", "onset_density", "duration")
SPECTRAL_FIELDS = ("spectral_centroid_mean", "spectral_bandwidth_mean", "spectral_rolloff_mean", "zero_crossing_rate_mean")
SEQUENCE_FIELDS = ("filename", "duration", "tempo", "key", "primary_mood", "primary_character", "rms_mean")
NOT_NEGATIVE = ("avg_energy", "avg_brightness", "onset_density")
SLOWEST, FASTEST = 30.0, 300.0
#: Numbers that say where a row lies rather than how it sounds.
NOT_FOR_CLUSTERS = ("duration", "cluster", "phase_number", "position", "sample_rate")
NAMES = ("filename", "key", "detected_key")


def number(c: Column) -> Column:
    """A double, or null for what is none: text, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _errors(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), text) for c, text in found])) if found else F.array().cast("array<string>")


def feature_errors(df: DataFrame) -> DataFrame:
    """df with errors: required features that are missing, and every number that is NaN or infinite."""
    missing = [(F.col(c).isNull() if c in df.columns else F.lit(True), f"missing {c}") for c in REQUIRED_FEATURES]
    broken = [(F.isnan(c) | (F.abs(c) == float("inf")), f"not finite {c}") for c in df.columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumn("errors", _errors(*missing, *broken))


def _field(df: DataFrame, name: str, *more: tuple[Column, str]) -> list[tuple[Column, str]]:
    if name not in df.columns:
        return [(F.lit(True), f"missing {name}")]
    given = F.col(name).isNotNull()
    return [(~given, f"missing {name}"), (given & number(F.col(name)).isNull(), f"no number {name}"), *more]


def phase_errors(df: DataFrame) -> DataFrame:
    """df with errors of phases: missing fields, fields that are no numbers, durations not above 0 and levels under 0."""
    found = []
    for c in PHASE_FIELDS:
        low = [(number(F.col(c)) <= 0, "duration not positive")] if c == "duration" else [(number(F.col(c)) < 0, f"negative {c}")] if c in NOT_NEGATIVE else []
        found += _field(df, c, *low)
    return df.withColumn("errors", _errors(*found))


def spectral_errors(df: DataFrame) -> DataFrame:
    """df with errors of spectral features: crossings outside 0..1, other values under 0."""
    found = []
    for c in SPECTRAL_FIELDS:
        x = number(F.col(c))
        found += _field(df, c, (~x.between(0, 1), f"{c} not within 0..1") if c.startswith("zero") else (x < 0, f"negative {c}"))
    return df.withColumn("errors", _errors(*found))


def sequence_errors(df: DataFrame) -> DataFrame:
    """df with errors of tracks that are to be put in order: missing fields, durations and tempos that can't be."""
    found = [(F.col(c).isNull() if c in df.columns else F.lit(True), f"missing {c}") for c in SEQUENCE_FIELDS]
    if "duration" in df.columns:
        found.append((F.col("duration").isNotNull() & ~F.coalesce(number(F.col("duration")) > 0, F.lit(False)), "invalid duration"))
    if "tempo" in df.columns:
        found.append((F.col("tempo").isNotNull() & ~F.coalesce(number(F.col("tempo")).between(SLOWEST, FASTEST), F.lit(False)), "tempo outside 30..300"))
    return df.withColumn("errors", _errors(*found))


def within(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """df with inside: a map from each given name to whether its value lies in its range; false where there is no such column."""
    held = [x for c, (lo, hi) in ranges.items() for x in (F.lit(c), F.coalesce(number(F.col(c)).between(lo, hi), F.lit(False)) if c in df.columns else F.lit(False))]
    return df.withColumn("inside", F.create_map(*held))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rejected rows with theirs) of a checked table."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the columns that hold numbers or truth values, other than names of files and keys."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in NAMES]


def numeric_features(df: DataFrame) -> DataFrame:
    """The numbers of df; truth values become 0 and 1."""
    return df.select(*[F.col(c).cast("int").alias(c) if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(c) for c in numeric_columns(df)])


def clustering_columns(df: DataFrame) -> list[str]:
    """The numbers that tracks are clustered by: no truth values, and nothing that says where a row lies."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FOR_CLUSTERS]


#: What the features mean, by the beginnings of their names.
DESCRIPTIONS = {
    "duration": "Length in seconds", "spectral_centroid": "Centre of the spectrum in Hz, heard as brightness", "spectral_rolloff": "Frequency under which 85 % of the spectrum lie",
    "spectral_bandwidth": "Spread of the spectrum around its centre in Hz", "spectral_flatness": "From tonal (0) to noise (1)", "spectral_flux": "Change between neighbouring spectra",
    "spectral_roughness": "Mean step between neighbouring bins", "zero_crossing_rate": "Share of samples at which the sign changes", "rms": "Root mean square of the samples, heard as loudness",
    "tempo": "Beats per minute", "onset_density": "Onsets a second", "key_confidence": "Share of the strongest pitch class", "key": "Strongest pitch class", "mfcc": "Cepstral coefficient of the mel spectrum",
    "chroma": "Share of a pitch class", "tonnetz": "Coordinate of the tonal centroid", "stereo_width": "Difference of the channels against their sum",
}


def described(df: DataFrame) -> DataFrame:
    """df whose columns carry their meaning as the comment of their metadata."""
    out = df
    for c in df.columns:
        if text := next((t for start, t in DESCRIPTIONS.items() if c.startswith(start)), None):
            out = out.withMetadata(c, {"comment": text})
    return out
