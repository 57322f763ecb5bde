"""Clustering of tracks: imputation, k-means with restarts, the choice of k, Lloyd's iterations and measures of clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .library import finite, scale

RESTARTS, ITERATIONS, SEED = 10, 300, 42
#: Centers that move by no more than this have arrived.
TOLERANCE = 1e-4
#: Values that the driver holds (16 MB); larger tables are passed over by tasks. Rows of a task at least.
HELD, TASK_ROWS = 2_000_000, 20_000
MOST_CLUSTERS, LLOYD_STEPS = 10, 50


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the gaps of columns, NaN and infinities among them, filled by the mean of the finite values; 0 where there are none."""
    f = df.withColumns({c: finite(c) for c in columns})
    means = f.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_{c}") for c in columns])  # one row
    return f.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).select(*df.columns)


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="_v").transform(scale(impute_means(df, columns), columns))


def _fit(v: DataFrame, k: int, restarts: int, seed: int = SEED):
    """The best of several k-means++ starts by the sum of squared distances."""
    from pyspark.ml.clustering import KMeans

    models = [KMeans(k=k, seed=seed + i, maxIter=ITERATIONS, featuresCol="_v", predictionCol="cluster").fit(v) for i in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centers)."""
    return ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)


def _matrices(batches):
    for batch in batches:
        if batch.num_rows:
            yield np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)


def _draws(centers: list[np.ndarray], seed: int):
    """mapInArrow function: the row (run, clock, v) of a partition that k-means++ would draw next for each run, by exponential clocks."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rng, best = np.random.default_rng([seed, len(centers[0]), TaskContext.get().partitionId() if TaskContext.get() else 0]), {}
        for x in _matrices(batches):
            for r, own in enumerate(centers):
                weight = _squares(x, own).min(axis=1) if len(own) else np.ones(len(x))
                clock = rng.exponential(size=len(x)) / np.maximum(weight, 1e-300)
                i = int(clock.argmin())
                if r not in best or clock[i] < best[r][0]:
                    best[r] = float(clock[i]), x[i].tolist()
        yield pa.RecordBatch.from_pydict({"run": list(best), "clock": [c for c, _ in best.values()], "v": [v for _, v in best.values()]}, pa.schema([("run", pa.int64()), ("clock", pa.float64()), ("v", pa.list_(pa.float64()))]))

    return run


def _sums(centers: dict[int, np.ndarray]):
    """mapInArrow function: (run, center, n, cost, s0 ..) of a partition: the rows nearest to each center, added up."""

    def run(batches):
        import pyarrow as pa

        held = {r: (np.zeros((len(c), 2)), np.zeros(c.shape)) for r, c in centers.items()}
        for x in _matrices(batches):
            for r, own in centers.items():
                d = _squares(x, own)
                at = d.argmin(axis=1)
                held[r][0][:, 0] += np.bincount(at, minlength=len(own))
                held[r][0][:, 1] += np.bincount(at, d[np.arange(len(x)), at], minlength=len(own))
                np.add.at(held[r][1], at, x)
        rows = [(r, c, *n[c], *s[c]) for r, (n, s) in held.items() for c in range(len(n))]
        width = next(iter(centers.values())).shape[1]
        names = ["run", "center", "n", "cost", *[f"s{i}" for i in range(width)]]
        types = [pa.int64(), pa.int64(), *[pa.float64()] * (2 + width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _best_centers(v: DataFrame, n: int, k: int, restarts: int, seed: int = SEED) -> tuple[list[list[float]], float]:
    """(centers, sum of squared distances) of the best of several k-means++ starts, all of them in the same passes over the n rows."""
    from pyspark.ml.functions import vector_to_array

    x = v.select(vector_to_array("_v").alias("x")).coalesce(max(1, n // TASK_ROWS))
    width = len(x.first().x)
    held = x.toArrow().to_batches() if n * width <= HELD else None
    local = lambda f: [row for batch in f(iter(held)) for row in batch.to_pylist()]
    at = [np.empty((0, width)) for _ in range(restarts)]
    for _ in range(k):
        draw = _draws(at, seed)
        drawn = local(draw) if held is not None else x.mapInArrow(draw, "run long, clock double, v array<double>").groupBy("run").agg(F.min_by("v", "clock").alias("v")).collect()  # a row for each run
        at = [np.vstack([at[r["run"]], r["v"]]) for r in sorted(drawn, key=lambda r: r["run"])]
    fields = ["n", "cost", *[f"s{i}" for i in range(width)]]

    def passed(runs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        out = {r: np.zeros((k, len(fields))) for r in runs}
        if held is not None:
            told = local(_sums(runs))
        else:
            sums = x.mapInArrow(_sums(runs), "run long, center long, " + ", ".join(f"{f} double" for f in fields))
            told = sums.groupBy("run", "center").agg(*[F.sum(f).alias(f) for f in fields]).collect()  # k rows for each run
        for row in told:
            out[row["run"]][row["center"]] = [row[f] for f in fields]
        return out

    moving = dict(enumerate(at))
    for _ in range(ITERATIONS):
        sums = passed(moving)
        for r, own in list(moving.items()):
            n = sums[r][:, :1]
            at[r] = np.where(n > 0, sums[r][:, 2:] / np.maximum(n, 1), own)  # a center without rows stays
            moving[r] = at[r]
            if np.sqrt(((at[r] - own) ** 2).sum(axis=1)).max() <= TOLERANCE:
                del moving[r]
        if not moving:
            break
    cost = {r: float(s[:, 1].sum()) for r, s in passed(dict(enumerate(at))).items()}
    best = min(cost, key=cost.get)
    return at[best].tolist(), cost[best]


def kmeans(df: DataFrame, columns: list[str], k: int | None = None, seed: int = SEED, restarts: int = RESTARTS) -> DataFrame:
    """df with cluster, by k-means over the standardised columns. Without k it is chosen by `choose_k`."""
    return kmeans_with_centers(df, columns, k, seed, restarts)[0]


def kmeans_with_centers(df: DataFrame, columns: list[str], k: int | None = None, seed: int = SEED, restarts: int = RESTARTS) -> tuple[DataFrame, list[dict[str, float]], float]:
    """(df with cluster, the centers in the units of the columns, the sum of squared distances in scaled units)."""
    v = _assembled(df, columns).persist()
    try:
        n = v.count()
        k = min(k or choose_k(v, n), max(1, n))
        stats = impute_means(df, columns).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        spread = {c: stats[f"s_{c}"] or 1.0 for c in columns}
        if k == 1:
            total = sum((stats[f"s_{c}"] or 0) ** 2 / spread[c] ** 2 for c in columns) * n
            return df.withColumn("cluster", F.lit(0)), [{c: stats[f"m_{c}"] for c in columns}], total
        at, cost = _best_centers(v, n, k, restarts, seed)
        centers = [{c: float(x * spread[c] + stats[f"m_{c}"]) for c, x in zip(columns, center, strict=True)} for center in at]
        return _labelled(df, columns, at), centers, cost
    finally:
        v.unpersist()


def _labelled(df: DataFrame, columns: list[str], at: list[list[float]]) -> DataFrame:
    """df with the cluster of the nearest center, by an expression over the scaled columns."""
    f = impute_means(df.withColumns({f"_x_{c}": F.col(c) for c in columns}), [f"_x_{c}" for c in columns])
    s = scale(f, [f"_x_{c}" for c in columns])
    return s.withColumn("cluster", nearest(F.array(*[F.col(f"_x_{c}") for c in columns]), at)).select(*df.columns, "cluster")


def distance2(vector: Column, center: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in center]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)


def nearest(vector: Column, centers: list[list[float]]) -> Column:
    """The number of the nearest center, the first of equally near ones; the centers are literals, so nothing is joined."""
    d = F.array(*[distance2(vector, c) for c in centers])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def silhouettes(v: DataFrame, models: list) -> list[float]:
    from pyspark.ml.evaluation import ClusteringEvaluator

    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
    return [judge.evaluate(m.transform(v)) for m in models]


def choose_k(v: DataFrame, n: int, restarts: int = 1) -> int:
    """Clusters for n assembled rows by the bend of the cost and the silhouette: 1 up to two rows, 2 up to five, 3 at most up to ten, else 5 at most."""
    if n <= 5:
        return 1 if n <= 2 else 2
    models = [_fit(v, k, restarts) for k in range(2, min(MOST_CLUSTERS, n - 1) + 1)]
    cost = [m.summary.trainingCost for m in models]
    bend = int(np.argmax(np.diff(cost, 2))) + 2 if len(cost) > 2 else 2
    best = int(np.argmax(silhouettes(v, models))) + 2
    return max(2, min(bend, best, 3) if n <= 10 else min(max(bend, best), 5))


def choose_k_by_ratio(v: DataFrame, n: int, restarts: int = 1) -> int:
    """Clusters for n assembled rows by the silhouette and the Calinski-Harabasz ratio, out of 2 to half the rows: their
    smaller one, 3 at most, up to twenty rows, else the whole part of their mean."""
    if n <= 5:
        return 1 if n <= 2 else 2
    ks = list(range(2, min(MOST_CLUSTERS, n // 2) + 1))
    models = [_fit(v, k, restarts) for k in ks]
    by_silhouette = ks[int(np.argmax(silhouettes(v, models)))]
    total = _total_squares(v)
    by_ratio = ks[int(np.argmax([_ratio(total - m.summary.trainingCost, m.summary.trainingCost, k, n) for k, m in zip(ks, models, strict=True)]))]
    return max(2, min(by_silhouette, by_ratio, 3) if n <= 20 else (by_silhouette + by_ratio) // 2)


def _ratio(between: float, inside: float, k: int, n: int) -> float:
    return float("inf") if inside <= 0 else between / (k - 1) / (inside / (n - k))


def _total_squares(v: DataFrame) -> float:
    from pyspark.ml.stat import Summarizer

    row = v.agg(Summarizer.metrics("variance", "count").summary(F.col("_v")).alias("s")).first().s
    return float(sum(row["variance"]) * (row["count"] - 1))


def calinski_harabasz(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """One row (k, n, between, within, ratio) of a clustering, from one aggregate a cluster."""
    g = df.groupBy(cluster).agg(F.count("*").alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count("*")).alias(f"w_{c}"))])
    mean = [(F.sum(F.col(f"m_{c}") * F.col("n")) / F.sum("n")) for c in columns]
    squares = [F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")) for c in columns]
    one = g.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), sum((s - F.sum("n") * m * m for s, m in zip(squares, mean, strict=True)), F.lit(0.0)).alias("between"),
        sum((F.sum(f"w_{c}") for c in columns), F.lit(0.0)).alias("within"),
    )
    return one.withColumn("ratio", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))))


def cohesion(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """(cluster, n, cohesion, inertia): mean distance and sum of squared distances to the center of each cluster, in scaled units; 0 for a single row."""
    s = scale(impute_means(df, columns), columns)
    centers = s.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_{c}") for c in columns])
    d2 = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in columns), F.lit(0.0))
    j = s.join(F.broadcast(centers), cluster).withColumn("_d2", d2)  # as many rows as there are clusters
    return j.groupBy(cluster, "n").agg(F.when(F.col("n") <= 1, 0.0).otherwise(F.avg(F.sqrt("_d2"))).alias("cohesion"), F.sum("_d2").alias("inertia"))


def seed_centers(df: DataFrame, vector: str, k: int, seed: int = SEED) -> list[list[float]]:
    """k-means++: rows drawn one after another with a chance in proportion to the squared distance to the nearest center so far.

    Every draw is one pass: of exponential clocks with these rates the row whose clock rings first is taken, so no distances are gathered.
    """
    centers: list[list[float]] = []
    for i in range(k):
        weight = F.least(*[distance2(F.col(vector), c) for c in centers]) if len(centers) > 1 else distance2(F.col(vector), centers[0]) if centers else F.lit(1.0)
        clock = -F.log(F.greatest(F.rand(seed + i), F.lit(1e-300))) / F.greatest(weight, F.lit(1e-300))
        row = df.select(F.col(vector).alias("v"), clock.alias("clock")).agg(F.min_by("v", "clock").alias("v")).first()
        if row is None or row.v is None:
            break
        centers.append([float(x) for x in row.v])
    return centers


def lloyd_step(df: DataFrame, vector: str, centers: list[list[float]]) -> DataFrame:
    """One Lloyd step: (cluster, dim, value, n) of the new centers of the clusters that have rows."""
    parts = df.select(nearest(F.col(vector), centers).alias("cluster"), F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy("cluster", "dim").agg(F.avg("x").alias("value"), F.count("*").alias("n"))


def lloyd(df: DataFrame, vector: str, k: int, steps: int = LLOYD_STEPS, seed: int = SEED, centers: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """(df with cluster, centers) after a fixed number of Lloyd steps from k-means++ seeds; an empty cluster's center becomes zero.

    The k centers are literals of a projection, and a step is one partial aggregate: nothing is joined and no row is shuffled. Steps
    after one that moves no center change nothing and are left out.
    """
    at = centers or seed_centers(df, vector, k, seed)
    width = len(at[0]) if at else 0
    for _ in range(steps if at else 0):
        told = df.select(nearest(F.col(vector), at).alias("c"), vector)
        rows = told.groupBy("c").agg(F.count("*").alias("n"), *[F.sum(F.col(vector)[i]).alias(f"s{i}") for i in range(width)]).collect()  # k rows
        moved = [[0.0] * width for _ in at]
        for r in rows:
            if r.c is not None:
                moved[r.c] = [float(r[f"s{i}"]) / r.n for i in range(width)]
        same, at = moved == at, moved
        if same:
            break
    return df.withColumn("cluster", nearest(F.col(vector), at) if at else F.lit(None).cast("int")), at


def pca(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """(df with pc1 .. pck of the standardised columns, the share of variance that each explains)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _assembled(df.withColumns({f"_x_{c}": F.col(c) for c in columns}), [f"_x_{c}" for c in columns])
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    out = model.transform(v).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({f"pc{i + 1}": F.col("_p")[i] for i in range(k)}).select(*df.columns, *[f"pc{i + 1}" for i in range(k)]), [float(x) for x in model.explainedVariance]
