"""Profiles of sound and advice in words, from aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import library

# The tags that a profile counts, and the limits of advice.
ANALOG, DIGITAL, ACOUSTIC = ("analog_synth",), ("digital_synth",), ("acoustic_instrument", "mellotron")
OFTEN, FAST, LIVELY, LOUD, AUDIBLE = 60, 140, 120, 0.1, 0.05
MISSING, REPEATED, STEADY_TEMPO, MANY_PHASES, DOMINANT = 0.05, 0.01, 20, 4, 0.6


def _given(*advice: tuple[Column, str]) -> Column:
    """The sentences whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, text) for c, text in advice]))


def _else(sentences: Column, text: str) -> Column:
    return F.when(F.size(sentences) == 0, F.array(F.lit(text))).otherwise(sentences)


def synthesis_profile(df: DataFrame, tag: str = "tag", within: str | None = None) -> DataFrame:
    """Shares of analog, digital and acoustic sources among the tags, and the lean of texture and harmonics.

    One row, or one for each value of within. Shares are 0 where no source tag occurs.
    """
    n = lambda *names: F.count_if(F.col(tag).isin(*names))
    rows = df.groupBy(within) if within else df.groupBy()
    g = rows.agg(n(*ANALOG).alias("a"), n(*DIGITAL).alias("d"), n(*ACOUSTIC).alias("c"), (n("rich_texture") - n("pure_tone")).alias("texture"), (n("bright_harmonics") - n("warm_harmonics")).alias("harmonics"))
    total = F.col("a") + F.col("d") + F.col("c")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0))
    lean = lambda c, over, under, even: F.when(F.col(c) > 0, over).when(F.col(c) < 0, under).otherwise(even)
    return g.select(
        *([within] if within else []),
        share("a").alias("analog"), share("d").alias("digital"), share("c").alias("acoustic"),
        lean("texture", "high", "low", "medium").alias("texture_complexity"), lean("harmonics", "bright", "warm", "neutral").alias("harmonic_tendency"),
    )


def quality_advice(df: DataFrame, numeric: list[str]) -> DataFrame:
    """One row of sentences on how to improve a table: gaps, repeated rows, flat columns, columns that say the same."""
    cells = max(1, len(df.columns))
    rows = df.agg(F.count("*").alias("rows"), sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("nulls"))
    once = df.groupBy(df.columns).agg(F.lit(1).alias("x")).agg(F.count("*").alias("distinct"))
    flat, same = len(library.low_variance(df, numeric)), len(library.correlated(df, numeric))
    n = F.greatest("rows", F.lit(1))
    told = _given(
        (F.col("nulls") / (n * cells) > MISSING, "Many values are missing: look at the extraction"),
        ((F.col("rows") - F.col("distinct")) / n > REPEATED, "Rows repeat: drop the copies"),
        (F.lit(flat > 0), f"Columns that hardly vary: {flat}"),
        (F.lit(same > 0), f"Columns that follow another: {same}"),
    )
    return rows.crossJoin(once).select("rows", "nulls", "distinct", _else(told, "Nothing to improve").alias("advice"))  # one row each


def cluster_advice(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, advice) for clusters with tempo, energy, climax_percent, breakdown_percent and coherence."""
    tempo = F.when(F.col("tempo") > FAST, "Fast, for the peak of a set").when(F.col("tempo") > LIVELY, "Of middle pace, for building up").otherwise("Slow, for rest")
    energy = F.when(F.col("energy") > LOUD, "Strong enough to dance to").when(F.col("energy") > AUDIBLE, "Of moderate strength, fits anywhere").otherwise("Quiet, for the background")
    more = _given((F.col("climax_percent") > OFTEN, "Clear peaks tell a story"), (F.col("breakdown_percent") > OFTEN, "Breakdowns ease mixing"), (F.col("coherence") == "High", "Its tracks follow each other smoothly"))
    return df.select(cluster, F.concat(F.array(tempo, energy), more).alias("advice"))


def collection_insights(mood: Column, tempo: Column, phases_per_piece: Column, largest: Column, clusters: Column, first_tempo: Column, last_tempo: Column) -> Column:
    """Sentences on a library from its figures: leading mood, standard deviation of tempo, mean number of phases, size
    of the largest of its clusters, and the tempos that its sequence begins and ends with. Null figures say nothing."""
    return F.array_compact(F.array(
        F.when(mood.isNotNull(), F.concat(F.lit("Mostly "), F.translate(mood, "_", " "))),
        F.when(tempo < STEADY_TEMPO, "Its tempos stay together").when(tempo.isNotNull(), "Its tempos range widely"),
        F.when(phases_per_piece > MANY_PHASES, "Pieces pass through many phases").when(phases_per_piece.isNotNull(), "Pieces keep to few phases"),
        F.when(largest > clusters * DOMINANT, "One style prevails").when(largest.isNotNull(), "Several styles stand side by side"),
        F.when(last_tempo > first_tempo, "The sequence gains pace").when(last_tempo.isNotNull(), "The sequence calms down"),
    ))
