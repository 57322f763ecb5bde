"""Operators over a whole library: cleaning, scaling, statistics, clustering and sequencing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import rules

# ---- cleaning and scaling -------------------------------------------------------------------------


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def quantile(c: str, p: float, accuracy: int | None = None) -> Column:
    """The value below which a share p of a column lies: exact with interpolation, from the column's distinct values; with accuracy
    approximate, with a rank error of 1 / accuracy at most and a sketch of bounded size."""
    return F.percentile(c, p) if accuracy is None else F.percentile_approx(c, p, accuracy).cast("double")


def fill_rule(name: str) -> str:
    """How a column's gaps are filled, by the first part of its name that is known."""
    known = (("energy", "zero"), ("rms", "zero"), ("spectral", "median"), ("centroid", "median"), ("tempo", "mean"), ("duration", "mean"), ("mfcc", "zero"))
    return next((how for part, how in known if part in name), "median")


def clean(df: DataFrame, numeric: list[str], accuracy: int | None = None) -> DataFrame:
    """Non-finite values become gaps; gaps are filled by name; tempo, duration, energy, spectral and crossing values are clipped.

    Crossings without a value are 0.05, numbers of phases whole and 1 at least. Text columns are trimmed, and
    empty texts and the words nan, none and null become unknown.
    """
    f = df.withColumns({c: finite(c) for c in numeric})
    stat = {"median": lambda c: quantile(c, 0.5, accuracy), "mean": F.avg}
    wanted = {c: stat[fill_rule(c)](c).alias(f"_{c}") for c in numeric if fill_rule(c) in stat and "tempo" not in c and "zero_crossing" not in c and c != "num_phases"}
    if wanted:
        f = f.crossJoin(F.broadcast(f.agg(*wanted.values())))  # one row
    out = {}
    for c in numeric:
        x = F.coalesce(F.col(c), F.lit(120.0) if "tempo" in c else F.lit(0.05) if "zero_crossing" in c else F.lit(1.0) if c == "num_phases" else F.col(f"_{c}") if c in wanted else F.lit(0.0), F.lit(0.0))
        if "tempo" in c:
            x = F.least(F.greatest(x, F.lit(30.0)), F.lit(300.0))
        elif any(p in c for p in ("duration", "energy", "rms", "spectral")):
            x = F.greatest(x, F.lit(0.0))
        elif "zero_crossing" in c:
            x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        elif c == "num_phases":
            x = F.greatest(F.floor(x), F.lit(1)).cast("int")
        out[c] = x
    for field in df.schema:
        if isinstance(field.dataType, StringType):
            plain = F.trim(field.name)
            out[field.name] = F.when(plain.isNull() | F.lower(plain).isin("", "nan", "none", "null"), "unknown").otherwise(plain)
    return f.withColumns(out).select(*df.columns)


def scale(df: DataFrame, columns: list[str], how: str = "standard", accuracy: int | None = None) -> DataFrame:
    """Columns standardised (population deviation), scaled to 0..1, or by median and quartiles; a flat column is only shifted."""
    stats = []
    for c in columns:
        q = lambda p: quantile(c, p, accuracy)  # noqa: B023, E731
        a, b = {"standard": (F.avg(c), F.stddev_pop(c)), "minmax": (F.min(c), F.max(c) - F.min(c)), "robust": (q(0.5), q(0.75) - q(0.25))}[how]
        stats += [a.alias(f"_{c}_a"), b.alias(f"_{c}_b")]
    one = df.agg(*stats)
    made = {c: (F.col(c) - F.col(f"_{c}_a")) / F.when(F.col(f"_{c}_b") == 0, 1.0).otherwise(F.col(f"_{c}_b")) for c in columns}
    return df.crossJoin(F.broadcast(one)).withColumns(made).select(*df.columns)


def low_variance(df: DataFrame, columns: list[str], least: float = 0.001) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] < least]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, from one aggregate over the rows that have both; r is null where one is constant."""

    def r(a: str, b: str) -> Column:
        own = lambda x, y: F.var_pop(F.when(F.col(y).isNotNull(), F.col(x)))
        return F.try_divide(F.covar_pop(a, b), F.sqrt(own(a, b) * own(b, a)))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns to drop: of each pair correlated beyond limit the one with less variance, or the second."""
    if len(columns) < 2:
        return []
    var = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    gone: list[str] = []
    for r in correlations(df, columns).where(F.abs("r") > limit).collect():  # one row per pair of columns
        if (x := r.a if var[r.a] < var[r.b] else r.b) not in gone:
            gone.append(x)
    return gone


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "feature", "value")


# ---- statistics -----------------------------------------------------------------------------------


def feature_statistics(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    u = unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    g = u.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), quantile("value", 0.5, accuracy).alias("median"))
    return g.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.abs("mean")))


def describe(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """count, mean, std, least, most and quartiles by linear interpolation."""
    u = unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    return u.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), *[quantile("value", p, accuracy).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)])


def data_quality(df: DataFrame) -> DataFrame:
    """(column, nulls, completeness) and the rows of the table."""
    one = df.agg(F.count("*").alias("rows"), F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns]).alias("x"))
    return one.select("rows", F.explode("x").alias("x")).select("x.column", "x.nulls", "rows", (100 - 100 * F.col("x.nulls") / F.greatest("rows", F.lit(1))).alias("completeness"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


# ---- clusters -------------------------------------------------------------------------------------


def homogeneity(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Mean coefficient of variation of the columns within each cluster; 0 for a single row."""
    u = unpivot(df.select(cluster, *[F.col(c).cast("double").alias(c) for c in columns]), [cluster], columns)
    cv = u.groupBy(cluster, "feature").agg(F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value"))).alias("cv"), F.avg("value").alias("m")).where("m <> 0")
    return cv.groupBy(cluster).agg(F.coalesce(F.avg("cv"), F.lit(0.0)).alias("homogeneity"))


def coherence(df: DataFrame, cluster: str, tempo: str, key: str, mood: str, energy: str) -> DataFrame:
    """Label of how alike the tracks of each cluster are in tempo, key, mood and energy."""
    g = df.groupBy(cluster).agg(F.count("*").alias("n"), (F.max(tempo) - F.min(tempo)).alias("t"), F.countDistinct(key).alias("k"), F.countDistinct(mood).alias("m"), F.try_divide(F.stddev_samp(energy), F.avg(energy)).alias("e"))
    step = lambda c, a, b, strict: F.when(c < a if strict else c <= a, 2).when(c < b if strict else c <= b, 1).otherwise(0)
    points = step(F.col("t"), 20, 40, True) + step(F.col("k"), 2, 3, False) + step(F.col("m"), 2, 3, False) + step(F.col("e"), 0.2, 0.5, True)
    return g.select(cluster, "n", points.alias("points"), F.when(F.col("n") == 1, "Single Track").when(points >= 6, "High").when(points >= 4, "Moderate").otherwise("Low").alias("coherence"))


# ---- sequencing -----------------------------------------------------------------------------------

#: What a track without a value counts as.
DEFAULTS = {"tempo": 120.0, "energy": 0.0, "brightness": 1000.0, "duration": 0.0, "key_confidence": 0.0, "key": "C", "mood": "neutral", "character": "unknown"}


def _related(table: str, a: Column, b: Column) -> Column:
    pairs = F.array(*[F.lit(f"{x}>{y}") for x, y in rules.edges(table)])
    return F.array_contains(pairs, F.concat(a, F.lit(">"), b))


def transition_score(a: str, b: str, use_cluster: bool = False) -> Column:
    """Score of playing row b after row a (aliases); directed. Without clusters their bonus is always given."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    gap = lambda n: F.abs(x(n) - y(n))
    rise = y("energy") - x("energy")
    between = lambda n: (x(n) > 30) & (x(n) < 300) & (y(n) > 30) & (y(n) < 300)
    parts = [
        F.when(x("key") == y("key"), 10).when(_related(rules.KEY_EDGES, x("key"), y("key")), 5).otherwise(0),
        F.when((x("key_confidence") > 0.7) & (y("key_confidence") > 0.7), 2).otherwise(0),
        F.when(gap("tempo") < 10, 8).when(gap("tempo") < 20, 5).when(gap("tempo") < 40, 2).otherwise(0),
        F.when(gap("energy") < 0.02, 6).when(gap("energy") < 0.05, 3).otherwise(0),
        F.when((rise > 0) & (rise < 0.03), 3).otherwise(0),
        F.when(x("mood") == y("mood"), 4).when(_related(rules.MOOD_EDGES, x("mood"), y("mood")), 7).otherwise(0),
        F.when(x("character") == y("character"), 4).when(_related(rules.CHARACTER_EDGES, x("character"), y("character")), 2).otherwise(0),
        F.when(between("duration"), 3).otherwise(0),
        F.when(x("duration") < y("duration"), 1).otherwise(0),
        F.when(gap("brightness") < 500, 3).when(gap("brightness") < 1000, 1).otherwise(0),
        F.when(x("cluster") == y("cluster"), 2).otherwise(0) if use_cluster else F.lit(2),
    ]
    return sum(parts[1:], parts[0])


def transitions(tracks: DataFrame, key: str = "filename", use_cluster: bool = False, playlist: str | None = None) -> DataFrame:
    """(src, dst, score) of every ordered pair of tracks of a playlist: the operator is defined on all of them. Without a column
    that names playlists the whole table is one."""
    t = tracks.fillna(DEFAULTS)
    apart = F.col(f"a.{key}") != F.col(f"b.{key}")
    return t.alias("a").join(t.alias("b"), apart & (F.col(f"a.{playlist}") == F.col(f"b.{playlist}")) if playlist else apart).select(F.col(f"a.{key}").alias("src"), F.col(f"b.{key}").alias("dst"), transition_score("a", "b", use_cluster).alias("score"))


def opening_score(tracks: DataFrame) -> DataFrame:
    """tracks with opening: how well each would open a sequence."""
    mood, character, e, d = F.col("mood"), F.col("character"), F.col("energy"), F.col("duration")
    score = (
        F.when(mood.isin("atmospheric", "spacey", "ethereal", "warm"), 10).when(mood.isin("oozy", "pensive", "organic"), 7).otherwise(0)
        + F.when(character.isin("analog_synth", "warm_harmonics"), 5).when(character.isin("mellotron", "organic"), 3).otherwise(0)
        + F.when(e < 0.03, 10).when(e < 0.05, 5).otherwise(0)
        + F.when(d > 240, 5).when(d > 120, 3).otherwise(0)
        + F.when(F.col("key").isin("C", "G", "D", "A"), 2).otherwise(0)
    )
    return tracks.withColumn("opening", score)


class _Scorer:
    """`transition_score` over the arrays of one playlist, its columns without nulls: nothing of the size of all pairs is held."""

    def __init__(self, rows: pd.DataFrame):
        kinds = rows[["key", "mood", "character"]].astype(str).agg(tuple, axis=1)
        self.kind, names = pd.factorize(kinds)
        related = [set(rules.edges(t)) for t in (rules.KEY_EDGES, rules.MOOD_EDGES, rules.CHARACTER_EDGES)]
        points = ((10, 5), (4, 7), (4, 2))  # the same, related
        one = lambda x, y: sum(same if a == b else near if (a, b) in r else 0 for a, b, r, (same, near) in zip(x, y, related, points, strict=True))
        self.names, self.one, self.made = list(names), one, {}
        self.sure = rows.key_confidence.to_numpy(float) > 0.7
        self.tempo, self.energy, self.brightness, self.duration = (rows[c].to_numpy(float) for c in ("tempo", "energy", "brightness", "duration"))
        self.fit = (self.duration > 30) & (self.duration < 300)
        codes, unique = pd.factorize(rows.src)
        self.name = codes if len(unique) < len(rows) else None

    def kept(self, at: np.ndarray) -> _Scorer:
        """The scorer of some of the rows."""
        out = object.__new__(_Scorer)
        out.__dict__ |= {k: v[at] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out

    def kinds(self, kind: int) -> np.ndarray:
        if kind not in self.made:
            self.made[kind] = np.array([self.one(self.names[kind], x) for x in self.names], np.int8)
        return self.made[kind]

    def score(self, whole: _Scorer, i: int) -> np.ndarray:
        """Scores of playing each row after row i of whole; -1 for rows of its own name."""
        s = self.kinds(whole.kind[i])[self.kind]
        if whole.sure[i]:
            s += self.sure * np.int8(2)
        gap = np.abs(self.tempo - whole.tempo[i])
        s += (gap < 10) * np.int8(3) + (gap < 20) * np.int8(3) + (gap < 40) * np.int8(2)
        rise = self.energy - whole.energy[i]
        gap = np.abs(rise)
        s += (gap < 0.02) * np.int8(3) + (gap < 0.05) * np.int8(3) + ((rise > 0) & (rise < 0.03)) * np.int8(3)
        if whole.fit[i]:
            s += self.fit * np.int8(3)
        s += whole.duration[i] < self.duration
        gap = np.abs(self.brightness - whole.brightness[i])
        s += (gap < 500) * np.int8(2) + (gap < 1000) * np.int8(1) + np.int8(2)
        return s if self.name is None else np.where(self.name == whole.name[i], np.int8(-1), s)


def _walk(rows: pd.DataFrame) -> list[int]:
    """The tour of rows that come sorted by name. Rows that are taken are dropped from the arrays now and then."""
    whole = _Scorer(rows)
    tour = [int(rows.opening.to_numpy().argmax())] if len(rows) else []
    at = np.delete(np.arange(len(rows)), tour)
    left, gone = whole.kept(at), np.zeros(len(at), bool)
    while len(tour) < len(rows):
        s = left.score(whole, tour[-1])
        s[gone] = -2
        j = int(s.argmax())
        tour.append(int(at[j]))
        gone[j] = True
        if (len(rows) - len(tour)) * 16 < len(at) * 15:
            at = at[~gone]
            left, gone = whole.kept(at), np.zeros(len(at), bool)
    scored: dict[tuple[int, int], int] = {}

    def step(x: int, y: int) -> int:
        if (x, y) not in scored:
            scored[x, y] = int(whole.kept(np.array([y])).score(whole, x)[0])
        return scored[x, y]

    total = lambda s: sum(step(x, y) for x, y in zip(s, s[1:], strict=False))
    for i in range(1, len(tour) - 1):
        lo = max(i - 1, 0)
        now, other = tour[lo : i + 3], [*tour[lo:i], tour[i + 1], tour[i], *tour[i + 2 : i + 3]]
        if total(other) > total(now):
            tour[i], tour[i + 1] = tour[i + 1], tour[i]
    return tour


def sequence(tracks: DataFrame, key: str = "filename", playlist: str | None = None) -> DataFrame:
    """(playlist, position, key): from the best opening track always on to the best next one, then one pass of swaps of
    neighbours that raise the total. Each step depends on the last, so a playlist is one pandas group, whose scores are made
    as they are asked for: its memory grows with its tracks, its time with their square. Without a column that names
    playlists the whole table is one."""
    t = opening_score(tracks.fillna(DEFAULTS)).withColumn("_p", F.col(playlist).cast("string") if playlist else F.lit("all"))
    rows = t.select(F.col("_p").alias("playlist"), F.col(key).alias("src"), "opening", *DEFAULTS)

    def walk(k, a: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("src", kind="stable").reset_index(drop=True)
        tour = _walk(a)
        return pd.DataFrame({"playlist": k[0], "position": np.arange(1, len(tour) + 1), "name": a.src.to_numpy()[tour]})

    kind = tracks.schema[key].dataType.simpleString()
    return rows.groupBy("playlist").applyInPandas(walk, f"playlist string, position int, name {kind}").withColumnRenamed("name", key)


def running_total(df: DataFrame, order: str, value: str, within: str | None = None, buckets: int = 200) -> DataFrame:
    """df with position_pct and total: the share of the way, and the sum so far.

    Without within the rows are dealt into ranges of a numeric order by approximate quantiles; a range is one window, and
    the sums and counts of the ranges before it, a row for each range, are broadcast. No window holds all rows.
    """
    if within:
        p = Window.partitionBy(within)
        by = p.orderBy(order)
        at, n = F.row_number().over(by) - 1, F.count("*").over(p)
        return df.withColumns({"position_pct": F.when(n > 1, at / (n - 1) * 100).otherwise(0.0), "total": F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    limits = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001))) or [0.0]
    dealt = df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col(order))))
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_s").over(before).alias("_s0"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    by = Window.partitionBy("_range").orderBy(order)
    at = F.col("_n0") + F.row_number().over(by) - 1
    own = F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))
    j = dealt.join(F.broadcast(base), "_range")
    return j.withColumns({"position_pct": F.when(F.col("_all") > 1, at / (F.col("_all") - 1) * 100).otherwise(0.0), "total": F.when(F.col("_s0").isNull(), own).otherwise(F.col("_s0") + F.coalesce(own, F.lit(0)))}).select(*df.columns, "position_pct", "total")


def quality(mean_transition: float) -> str:
    return next((name for least, name in ((15, "Excellent"), (10, "Good"), (5, "Fair")) if mean_transition > least), "Poor")


def reasoning(position: Column, n: Column) -> Column:
    share = (position - 1) / F.greatest(n - 1, F.lit(1))
    return F.when(position == 1, "opening").when(position == n, "closing").when(share < 0.3, "early").when(share < 0.7, "core").otherwise("building")


def bucket(value: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first limit that value is below."""
    out = F.when(value < limits[0][0], limits[0][1])
    for at, name in limits[1:]:
        out = out.when(value < at, name)
    return F.when(value.isNotNull(), out.otherwise(rest))


ENERGY = ([(0.02, "Very Low"), (0.05, "Low"), (0.08, "Medium"), (0.12, "High")], "Very High")
BRIGHTNESS = ([(1000, "Dark"), (2000, "Warm"), (3000, "Bright")], "Very Bright")
TEMPO = ([(80, "Slow"), (120, "Medium"), (140, "Upbeat")], "Fast")


def clock(seconds: Column, hours: bool = False) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)
    if not hours:
        return short
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"), s % 60)).otherwise(short)


def silhouette_k(n: int) -> int:
    """Clusters that a library of n tracks is asked for when nothing is measured."""
    return 1 if n <= 2 else 2 if n <= 5 else min(5, max(2, math.floor(n / 3)))
