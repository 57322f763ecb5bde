"""Summaries of phases, clusters, labels, chunks and sequences, and the neighbours of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from . import library

ENERGY_CLASSES = ("low", "medium", "high")
PEERS = 4


def phase_types(df: DataFrame, key: str = "filename", kind: str = "phase_type") -> DataFrame:
    """(key, num_phases, types): how often each phase type occurs in each piece, as a map."""
    n = df.groupBy(key, kind).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.sum("_n").alias("num_phases"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias("types"))


def phase_statistics(df: DataFrame, key: str = "filename", duration: str = "duration") -> DataFrame:
    """One row about all phases: how many, how many a piece, and how long."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    counts = per.agg(F.sum("n").alias("phases"), F.avg("n").alias("mean_per_piece"), F.min("n").alias("min_per_piece"), F.max("n").alias("max_per_piece"))
    times = df.agg(F.avg(duration).alias("mean_duration"), F.median(duration).alias("median_duration"), F.stddev_pop(duration).alias("std_duration"))
    return counts.crossJoin(F.broadcast(times))  # one row each


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row about the sizes of all clusters; balance is the smallest by the largest."""
    n = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"),
        F.stddev_pop("n").alias("std_size"), (F.min("n") / F.max("n")).alias("balance"),
    )


def energy_class(low: str, high: str) -> Column:
    """The class of a rule by its energy range: wholly quiet, wholly loud, or between."""
    return F.when(F.col(high) <= 0.05, "low").when(F.col(low) >= 0.08, "high").otherwise("medium")


def mood_energy(df: DataFrame, key: str = "filename", label_list: str = "moods") -> DataFrame:
    """key and three lists: its detected moods by the energy that their rules ask for, in rule order."""
    table = rules.as_table(df.sparkSession, rules.moods()).select("ord", F.col("name").alias("_name"), energy_class("energy_lo", "energy_hi").alias("_class"))
    each = df.select(key, F.explode_outer(label_list).alias("_name")).join(F.broadcast(table), "_name", "left")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_class") == c, F.struct("ord", "_name")))), lambda x: x["_name"]).alias(c) for c in ENERGY_CLASSES]
    return each.groupBy(key).agg(*lists)


def chunk_summary(df: DataFrame, columns: list[str], key: str = "filename", duration: str = "duration") -> DataFrame:
    """Mean, population deviation, least and most of each feature over the chunks of a piece; time that chunks share counts twice."""
    stats = (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    return df.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(duration).alias("total_duration"), *[f(c).alias(f"{c}_{name}") for c in columns for name, f in stats])


def peers(df: DataFrame, key: str = "filename", cluster: str = "cluster", k: int = PEERS) -> DataFrame:
    """(key, peer, rank): the first k others of each track's cluster by name. One more than k names a cluster is enough."""
    names = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("_c"), F.col(key).alias("peer"))
    # per cluster the k + 1 smallest names, kept small by partial ranking before the shuffle
    first = names.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("peer"))).where(F.col("_r") <= k + 1)
    j = df.join(first, (F.col(cluster) == F.col("_c")) & (F.col(key) != F.col("peer")))
    kept = j.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("peer")), 1, k).alias("_p"))
    return kept.select(key, F.posexplode("_p").alias("rank", "peer")).select(key, "peer", (F.col("rank") + 1).alias("rank"))


def new_labels(df: DataFrame, label_list: str, key: str, order: str) -> DataFrame:
    """df with new_labels: those that the row before in the same piece does not have; empty for the first row."""
    before = F.lag(label_list).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("new_labels", F.when(before.isNull(), F.expr(f"slice({label_list}, 1, 0)")).otherwise(F.array_except(label_list, before)))


def sequence_quality(df: DataFrame, playlist: str, position: str = "position") -> DataFrame:
    """How well each ordered playlist flows: mean and least transition, spread of energy and tempo, moods, the weakest step.

    A playlist of one track has no transition: its mean is 0 and it has no weakest step.
    """
    t = df.fillna({c: v for c, v in library.DEFAULTS.items() if c in df.columns})
    w = Window.partitionBy(playlist).orderBy(position)
    names = ("key", "key_confidence", "tempo", "energy", "mood", "character", "duration", "brightness")
    steps = t.withColumn("a", F.struct(*names)).withColumn("b", F.lead("a").over(w)).withColumn("_at", F.row_number().over(w))
    scored = steps.withColumn("_s", F.when(F.col("b").isNotNull(), library.transition_score("a", "b")))
    g = scored.groupBy(playlist).agg(
        F.count("*").alias("tracks"), F.coalesce(F.avg("_s"), F.lit(0.0)).alias("mean_transition"), F.min("_s").cast("long").alias("min_transition"),
        F.stddev_pop("energy").alias("energy_std"), F.stddev_pop("tempo").alias("tempo_std"), F.count_distinct("mood").alias("moods"), F.sum("duration").alias("total_duration"),
        F.min_by("_at", F.when(F.col("_s").isNotNull(), F.struct("_s", "_at"))).cast("long").alias("weakest"),
    )
    m = F.col("mean_transition")
    return g.withColumn("quality", F.when(m > 15, "Excellent").when(m > 10, "Good").when(m > 5, "Fair").otherwise("Poor"))


def energy_ends(df: DataFrame, playlist: str, position: str = "position", energy: str = "energy") -> DataFrame:
    """(playlist, progression): the mean energy of the last two tracks against that of the first two."""
    up, down = Window.partitionBy(playlist).orderBy(position), Window.partitionBy(playlist).orderBy(F.desc(position))
    r = df.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)})
    g = r.groupBy(playlist).agg(F.avg(F.when(F.col("_a") <= 2, F.col(energy))).alias("_from"), F.avg(F.when(F.col("_z") <= 2, F.col(energy))).alias("_to"))
    return g.select(playlist, F.when(F.col("_to") > F.col("_from") * 1.2, "Building").when(F.col("_to") < F.col("_from") * 0.8, "Declining").otherwise("Stable").alias("progression"))


def suggestions(df: DataFrame, label: str, edges: str = rules.MOOD_EDGES, key: str = "filename") -> DataFrame:
    """(key, suggestion): the labels that the edges allow after a track's own."""
    table = df.sparkSession.createDataFrame(rules.edges(edges), "_from string, suggestion string")
    return df.join(F.broadcast(table), F.col(label) == F.col("_from")).select(key, "suggestion")
