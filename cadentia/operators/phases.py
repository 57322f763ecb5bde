"""Phases: change signals over frames, boundaries, classes, transitions and structure of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAK_FACTOR, LEAST_START_S = 1.5, 5.0


def moving_average(df: DataFrame, value: str, key: str, order: str, size: int, out: str) -> DataFrame:
    """Centred moving average of size rows over each key, mirrored at both ends; an even size reaches one row further back."""
    back, ahead = size // 2, size - 1 - size // 2
    at, n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(key))
    numbered = df.withColumns({"_rn": at, "_n": n})
    # rows near an end stand for their mirror images as well
    places = F.array_compact(F.array(F.col("_rn"), F.when(F.col("_rn") < back, -1 - F.col("_rn")), F.when(F.col("_rn") >= F.col("_n") - ahead, 2 * F.col("_n") - 1 - F.col("_rn"))))
    whole = numbered.withColumn("_place", F.explode(places))
    w = Window.partitionBy(key).orderBy("_place").rowsBetween(-back, ahead)
    return whole.withColumn(out, F.avg(value).over(w)).where("_place = _rn").select(*df.columns, out)


def gradient(value: str, by: Window) -> Column:
    """Central differences, one-sided at the ends; null for a single row."""
    before, after = F.lag(value).over(by), F.lead(value).over(by)
    return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def change_signal(df: DataFrame, key: str, order: str, energy: str = "energy", bright: str = "brightness") -> DataFrame:
    """df with change: the size of the energy gradient plus that of the brightness gradient in kHz."""
    by = Window.partitionBy(key).orderBy(order)
    return df.withColumn("change", F.abs(gradient(energy, by)) + F.abs(gradient(bright, by)) / 1000)


def local_peaks(df: DataFrame, key: str, order: str, value: str = "change", factor: float = PEAK_FACTOR) -> DataFrame:
    """Rows that are higher than what lies before and after and at least factor population standard deviations of their key.

    A plateau of equal values is one peak, at its middle, the earlier one of two; the first and the last row of a key are none.
    """
    by = Window.partitionBy(key).orderBy(order)
    starts = F.when(F.lag(value).over(by) == F.col(value), 0).otherwise(1)
    run = df.withColumns({"_peak_start": starts, "_peak_h": factor * F.stddev_pop(value).over(Window.partitionBy(key))})
    run = run.withColumn("_peak_run", F.sum("_peak_start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_peak_run").orderBy(order)
    flat = run.withColumns({"_peak_at": F.row_number().over(inside) - 1, "_peak_n": F.count("*").over(Window.partitionBy(key, "_peak_run"))})
    # the neighbours of a plateau, as seen from its rows
    flat = flat.withColumns({"_peak_a": F.lag(value).over(by), "_peak_b": F.lead(value).over(by)})
    whole = Window.partitionBy(key, "_peak_run")
    flat = flat.withColumns({"_peak_before": F.max(F.when(F.col("_peak_at") == 0, F.col("_peak_a"))).over(whole), "_peak_after": F.max(F.when(F.col("_peak_at") == F.col("_peak_n") - 1, F.col("_peak_b"))).over(whole)})
    middle = F.col("_peak_at") == F.floor((F.col("_peak_n") - 1) / 2)
    kept = flat.where(middle & (F.col(value) > F.col("_peak_before")) & (F.col(value) > F.col("_peak_after")) & (F.col(value) >= F.col("_peak_h")))
    return kept.select(*df.columns)


def separated(peaks: DataFrame, key: str, position: str, height: str, distance: int) -> DataFrame:
    """(key, position) of the peaks that stay when the highest win and nothing nearer than distance does; a fold over each key's peaks."""
    order = F.array_sort(F.collect_list(F.struct((-F.col(height)).alias("h"), (-F.col(position)).alias("p"))))
    fold = f"aggregate(ps, cast(array() as array<bigint>), (kept, x) -> if(exists(kept, k -> abs(k + x.p) < {distance}), kept, array_append(kept, cast(-x.p as bigint))))"
    return peaks.groupBy(key).agg(order.alias("ps")).select(key, F.explode(F.expr(fold)).alias(position))


def boundaries(peaks: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Phases (key, phase_number, start_time, end_time) from peak times t and ends(key, duration)."""
    inner = peaks.where(F.col("t") > LEAST_START_S).select(key, "t")
    every = inner.unionByName(ends.select(key, F.lit(0.0).alias("t"))).unionByName(ends.select(key, F.col("duration").alias("t"))).distinct()
    by = Window.partitionBy(key).orderBy("t")
    return every.select(key, F.row_number().over(by).alias("phase_number"), F.col("t").alias("start_time"), F.lead("t").over(by).alias("end_time")).where("end_time is not null")


def classify(df: DataFrame, key: str = "filename", order: str = "phase_number") -> DataFrame:
    """df with position and phase_type. The position runs to i / max(P - 2, 1), so the last phase lies beyond 1."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    p = F.count("*").over(Window.partitionBy(key))
    e, o, b, at = F.col("energy"), F.col("onset"), F.col("brightness"), F.col("position")
    kind = (
        F.when((e < 0.02) & (o < 0.5), F.when(at < 0.3, "Intro/Ambient").when(at > 0.7, "Outro/Fade").otherwise("Breakdown/Quiet"))
        .when((e > 0.1) & (o > 2), F.when(at > 0.5, "Climax/Peak").otherwise("Build-up/Energetic"))
        .when(o > 1, "Rhythmic/Percussive")
        .when(b > 2000, "Bright/Melodic")
        .when(at < 0.3, "Introduction")
        .when(at > 0.7, "Conclusion")
        .otherwise("Development")
    )
    return df.withColumn("position", i / F.greatest(p - 2, F.lit(1))).withColumn("phase_type", kind)


def transitions(df: DataFrame, key: str = "filename", order: str = "phase_number") -> DataFrame:
    """One row between consecutive phases with the deltas and the kind of change."""
    by = Window.partitionBy(key).orderBy(order)
    d = df.select(key, order, *[(F.lead(c).over(by) - F.col(c)).alias(f"d_{c}") for c in ("energy", "brightness", "onset")]).where("d_energy is not null")
    kind = (
        F.when(F.col("d_energy") > 0.02, "Energy Build-up").when(F.col("d_energy") < -0.02, "Energy Drop")
        .when(F.col("d_brightness") > 500, "Brightness Increase").when(F.col("d_brightness") < -500, "Brightness Decrease")
        .when(F.col("d_onset") > 0.5, "Rhythmic Intensification").when(F.col("d_onset") < -0.5, "Rhythmic Simplification")
        .otherwise("Gradual Evolution")
    )
    return d.withColumn("transition", kind)


def trend(first: Column, last: Column, n: Column, short: str = "static") -> Column:
    """Name of the change from the mean of the first quarter to that of the last."""
    ratio = F.when(first == 0, 1.0).otherwise(last / first)
    return F.when(n < 2, short).when(ratio > 1.2, "increasing").when(ratio < 0.8, "decreasing").otherwise("stable")


def structure(df: DataFrame, key: str = "filename", order: str = "phase_number") -> DataFrame:
    """Structural features of each track from its classified phases(duration, energy, brightness, phase_type).

    The means behind the trends are summed in the order of the phases, so a ratio on a limit falls on the same side each time.
    """
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    n = F.count("*").over(Window.partitionBy(key))
    q = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    marked = df.withColumns({"_rn": rn, "_n": n}).withColumn("_q", q)
    first, last = F.col("_rn") <= F.col("_q"), F.col("_rn") > F.col("_n") - F.col("_q")
    ordered = Window.partitionBy(key).orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"_{v}_{s}": F.avg(F.when(c, F.col(v))).over(ordered) for v in ("energy", "brightness") for s, c in (("a", first), ("b", last))}
    out = marked.withColumns(ends).groupBy(key).agg(
        F.count("*").alias("num_phases"),
        (F.max("energy") - F.min("energy")).alias("energy_range"),
        (F.max("brightness") - F.min("brightness")).alias("brightness_range"),
        F.avg("duration").alias("avg_phase_duration"),
        F.stddev_pop("duration").alias("phase_duration_std"),
        F.bool_or(F.col("phase_type").contains("Climax")).alias("has_climax"),
        F.bool_or(F.col("phase_type").contains("Breakdown")).alias("has_breakdown"),
        F.bool_or(F.col("phase_type").contains("Build-up")).alias("has_build_up"),
        F.countDistinct("phase_type").alias("structural_complexity"),
        *[F.max(c).alias(c) for c in ends],  # equal in all rows of a key
    )
    made = {f"{v}_progression": trend(F.col(f"_{v}_a"), F.col(f"_{v}_b"), F.col("num_phases")) for v in ("energy", "brightness")}
    return out.withColumns(made).drop("_energy_a", "_energy_b", "_brightness_a", "_brightness_b")
