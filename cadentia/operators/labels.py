"""Rule classification: moods and character tags of tracks, phases and sections.

Rules are data: a literal array that every row is scored against.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

MOOD_WEIGHTS = {"energy": 3.0, "brightness": 2.5, "roughness": 2.0, "onset": 2.0, "bandwidth": 1.5}
TAG_WEIGHTS = {"centroid": 3.0, "bandwidth": 3.5, "rolloff": 2.5, "zcr": 2.0}
OPTIONAL_TAG_WEIGHTS = {"flatness": 3.0, "flux": 2.5, "stereo": 5.0}


def to_number(c: Column, default: float | None = 0.0) -> Column:
    """A double; null, NaN, infinities and the words nan, none and null become the default."""
    x = c.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(x)


def _inside(value: str, rule: str) -> str:
    return f"coalesce({value} between r.{rule}_lo and r.{rule}_hi, false)"


def _label(df: DataFrame, key: str, rows: list[dict], raw: str, above: float, factor: float, threshold: str, keep: list[str]) -> DataFrame:
    """(key, labels, best, confidence) and the numbers in keep, of every row of df: rules in the order of the table, of equal scores the first.

    The rules are one constant array and a row is scored by an expression over it, so nothing is joined, exploded or
    shuffled, and rows that share a key stay apart. raw is SQL over the row and a rule r; raw scores above a limit are
    raised by a factor, to 1 at most. threshold is SQL over a rated rule x.
    """
    fields = [c for c in rows[0] if c != "ord"]
    kinds = ", ".join(f"{c}: {'string' if any(isinstance(r[c], str) for r in rows) else 'double'}" for c in fields)
    table = F.from_json(F.lit(json.dumps([{c: r[c] for c in fields} for r in rows])), f"array<struct<{kinds}>>")
    limit = "r.threshold" if "threshold" in fields else "0D"
    rated = df.withColumn("_rules", table).withColumn("_s", F.expr(f"transform(_rules, r -> named_struct('name', r.name, 'threshold', {limit}, 's', {raw}))"))
    rated = rated.withColumn("_s", F.expr(f"transform(_s, x -> named_struct('name', x.name, 'threshold', x.threshold, 's', if(x.s > {above}D, least(1D, x.s * {factor}D), x.s)))"))
    return rated.select(
        key,
        F.expr(f"transform(filter(_s, x -> x.s >= {threshold}), x -> x.name)").alias("labels"),
        F.expr("_s[cast(array_position(_s.s, array_max(_s.s)) - 1 as int)].name").alias("best"),
        F.expr("array_max(_s.s)").alias("confidence"),
        *keep,
    )


def mood_scores(df: DataFrame, threshold: float = 0.7, mood_rules: list[dict] | None = None, key: str = "filename") -> DataFrame:
    """key, moods (detected, in rule order), primary_mood and mood_confidence of every row of df.

    df has energy, brightness, roughness, onset, duration and bandwidth, and may have zcr. Missing and
    non-finite values count as 0. Of equal scores the earlier rule wins. Where no mood reaches the
    threshold, moods is the single fallback with confidence unchanged.
    """
    inputs = [*MOOD_WEIGHTS, "duration"]
    clean = df.select(key, *[to_number(F.col(c)).alias(f"_{c}") for c in inputs], (to_number(F.col("zcr")) if "zcr" in df.columns else F.lit(0.0)).alias("_zcr"))
    parts = " + ".join(f"if({_inside('_' + k, k)}, {w}D, 0D)" for k, w in MOOD_WEIGHTS.items())
    raw = f"if(r.name = 'synthetic' and _zcr > 0.05D, 0D, ({parts} + if(_duration >= r.min_duration, 1D, 0D)) / 12D)"
    out = _label(clean, key, mood_rules or rules.moods(), raw, 0.8, 1.1, f"{threshold}D", ["_energy", "_brightness", "_onset"])
    other = F.array(fallback_mood(F.col("_energy"), F.col("_brightness"), F.col("_onset")))
    return out.select(key, F.when(F.size("labels") > 0, F.col("labels")).otherwise(other).alias("moods"), F.col("best").alias("primary_mood"), F.col("confidence").alias("mood_confidence"))


def fallback_mood(energy: Column, bright: Column, onset: Column) -> Column:
    """The mood of what no rule detects, from energy, brightness and onset density."""
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    loud = F.when(onset > 4, pick(bright > 2500, "tempestuous", "volcanic")).when(onset > 2, pick(bright > 2500, "euphoric", "surging")).otherwise(pick(bright > 2200, "triumphant", "molten"))
    quiet = F.when(bright > 3000, pick(onset < 0.2, "celestial", "gossamer")).when(bright > 2000, pick(onset < 0.6, "luminous", "spectral")).otherwise(pick(onset < 0.1, "glacial", "serene"))
    rest = (
        F.when(bright > 2500, pick(onset > 1.5, "crystalline_hard", "prismatic"))
        .when(onset > 2, pick(bright > 1500, "pulsating", "granular"))
        .when(bright < 1000, pick(onset < 1, "velvet", "wooden"))
        .otherwise(pick(bright > 1500, "hopeful", "contemplative"))
    )
    return F.when(energy > 0.08, loud).when(energy < 0.02, quiet).otherwise(rest)


def character_scores(df: DataFrame, threshold: float | None = None, tag_rules: list[dict] | None = None, key: str = "filename") -> DataFrame:
    """key, tags (detected, in rule order), primary_character and character_confidence of every row of df.

    df has centroid, bandwidth, rolloff and zcr, and may have timbre_variance (the mean spread of the
    first five cepstral coefficients), flatness, flux and stereo. An optional range that a tag defines
    counts in its denominator even if the feature is missing. threshold replaces the tags' own.
    """
    have = set(df.columns)
    cols = [(to_number(F.col(c)) if c in have else F.lit(0.0)).alias(f"_{c}") for c in (*TAG_WEIGHTS, "timbre_variance")]
    cols += [(to_number(F.col(c), None) if c in have else F.lit(None).cast("double")).alias(f"_{c}") for c in OPTIONAL_TAG_WEIGHTS]
    timbre = "case r.timbre when 'precision=high' then _timbre_variance < 0.5D when 'precision=low' then _timbre_variance > 0.5D when 'complexity=high' then _timbre_variance > 0.8D when 'complexity=low' then _timbre_variance < 0.3D else true end"
    got = " + ".join([f"if({_inside('_' + k, k)}, {w}D, 0D)" for k, w in (TAG_WEIGHTS | OPTIONAL_TAG_WEIGHTS).items()] + [f"if({timbre}, 1.5D, 0D)"])
    of = " + ".join([f"12.5D", *[f"if(r.{k}_lo is not null, {w}D, 0D)" for k, w in OPTIONAL_TAG_WEIGHTS.items()]])
    raw = f"(({got}) / ({of}))"
    limit = f"{threshold}D" if threshold is not None else "x.threshold"
    out = _label(df.select(key, *cols), key, tag_rules or rules.tags(), raw, 0.85, 1.05, limit, ["_centroid", "_bandwidth", "_rolloff", "_zcr"])
    other = F.array(fallback_character(F.col("_centroid"), F.col("_bandwidth"), F.col("_rolloff"), F.col("_zcr")))
    return out.select(key, F.when(F.size("labels") > 0, F.col("labels")).otherwise(other).alias("tags"), F.col("best").alias("primary_character"), F.col("confidence").alias("character_confidence"))


def fallback_character(centroid: Column, bandwidth: Column, rolloff: Column, zcr: Column) -> Column:
    return (
        F.when((bandwidth < 1000) & (zcr < 0.1), "analog_synth")
        .when((centroid > 2000) & (bandwidth < 800), "digital_synth")
        .when((bandwidth > 1800) & (zcr > 0.1), "acoustic_instrument")
        .when(bandwidth > 2000, "rich_texture")
        .when(bandwidth < 600, "pure_tone")
        .when(rolloff > 4000, "bright_harmonics")
        .when(rolloff < 2000, "warm_harmonics")
        .otherwise("unknown")
    )


def dominant(labels: Column) -> Column:
    """The label of a section: the first detected in rule order, not the one with the best score."""
    return F.try_element_at(labels, F.lit(1))


def distribution(df: DataFrame, label: str, vocabulary: list[dict]) -> DataFrame:
    """label, category, n and percentage of every label that occurs."""
    total = df.agg(F.count(label).alias("total"))
    names = rules.as_table(df.sparkSession, [{"name": r["name"], "category": r["category"]} for r in vocabulary])
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(names), F.col(label) == F.col("name"), "left").crossJoin(F.broadcast(total)).select(label, "category", "n", (F.col("n") * 100 / F.col("total")).alias("percentage"))
