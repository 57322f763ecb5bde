"""Queries on inputs that they once got wrong or could not do."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadentia.operators import clusters, library, phases, sections
from cadentia.plans import catalog


def told_by_sql(name: str, folder, *tables: str) -> list[tuple]:
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return con.execute(catalog.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("rows", [
    [(0, "SMALL", 1, "b", 9.0), (1, "SMALL", 40, "b", 9.0), (2, "LARGE", 20, "b", 9.0)],
    [(1, None, 10, "b", 9.0), (1, None, 30, "b", 9.0), (2, "LARGE", 20, "b", 9.0)],
    [(5, "LARGE", None, "b", 9.0)],
    [],
])
def test_collection_insights_begin_with_part_1(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in catalog.queries()["collection_insights"](spark, str(tmp_path)).collect()]
    assert got == told_by_sql("collection_insights", tmp_path, "part")


def test_trends_are_summed_in_the_order_of_phases(spark):
    """Means whose ratio is 0.8 on paper: the last bits of both sums decide."""
    first, last = [0.1, 0.12, 0.155], [0.1, 0.10666666666666667, 0.09333333333333334]
    energies = [*first, 0.104, 0.1, 0.096, 0.12, 0.116, 0.076, 0.068, 0.12666666666666668, *last]
    kinds = {2: "Build-up/Energetic", 3: "Build-up/Energetic", 4: "Build-up/Energetic", 11: "Climax/Peak", 13: "Climax/Peak"}
    rows = [(f"c{k}", i, e, 1000.0, 60.0, kinds.get(i, "Rhythmic/Percussive")) for k in range(20) for i, e in enumerate(energies, 1)]
    df = spark.createDataFrame(rows, "filename string, phase_number long, energy double, brightness double, duration double, phase_type string")
    got = {r.energy_progression for r in phases.structure(df.orderBy(F.xxhash64("energy", "filename"))).collect()}
    assert (last[0] + last[1] + last[2]) / 3 / ((first[0] + first[1] + first[2]) / 3) < 0.8
    assert got == {"decreasing"}


def test_crowded_bands_are_exact(spark, monkeypatch):
    """Bands of many points that hold many small groups: the components of all pairs, also where leaves part them."""
    shingles = pytest.importorskip("cadentia.llm.shingles")
    monkeypatch.setattr(shingles, "LEAF", 2)
    monkeypatch.setattr(shingles, "SMALL", 2)
    monkeypatch.setattr(shingles, "ASKED", 8, raising=False)
    rng, texts = random.Random(3), []
    base = [f"v{i}" for i in range(120)]
    for g in range(60):
        own = base + [f"g{g}w{i}" for i in range(20)]
        for _ in range(4):
            words = list(own)
            for at in rng.sample(range(len(words)), rng.randrange(1, 3)):
                words[at] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    h, limits = shingles.shingle_sets([t.encode() for t in texts])
    sets = [set(h[a:b].tolist()) for a, b in zip(limits[:-1], limits[1:], strict=True)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def groups(links):
        label = list(range(len(texts)))
        for a, b in links:
            x, y = label[a], label[b]
            label = [min(x, y) if c in (x, y) else c for c in label]
        return label

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = [(r.src, r.dst) for r in shingles.similar_links(df, 0.8).collect()]
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, pairs)))
    want = groups(pairs)
    assert len(set(want)) > 60 and groups(links) == want


def test_a_sequence_makes_no_pairs(spark):
    """No row of the plan stands for a pair of tracks, and the tour is that of the scores of all pairs."""
    rng = random.Random(5)
    rows = [(f"t{i % 58:02d}", rng.random() / 5, rng.uniform(60, 180), rng.uniform(500, 3000), rng.uniform(0, 400), rng.random(), rng.choice("CGDAE"), rng.choice(["warm", "oozy", "driving"]), rng.choice(["organic", "mellotron"])) for i in range(58)]
    rows += [("u1", None, None, None, None, None, None, None, None), ("u2", float("nan"), 120.0, float("inf"), 31.0, 0.9, "F", "warm", "organic")]
    df = spark.createDataFrame(rows, "filename string, energy double, tempo double, brightness double, duration double, key_confidence double, key string, mood string, character string")
    got = library.sequence(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    score = {(r.src, r.dst): r.score for r in library.transitions(df).collect()}
    opening = {r.filename: r.opening for r in library.opening_score(df.fillna(library.DEFAULTS)).collect()}
    tour = [min(opening, key=lambda n: (-opening[n], n))]
    while free := sorted(set(opening) - set(tour)):
        tour.append(max(free, key=lambda n: score[tour[-1], n]))  # the first of equal ones
    total = lambda s: sum(score[p] for p in zip(s, s[1:], strict=False))
    for i in range(1, len(tour) - 1):
        other = [*tour[i - 1 : i], tour[i + 1], tour[i], *tour[i + 2 : i + 3]]
        if total(other) > total(tour[i - 1 : i + 3]):
            tour[i : i + 2] = tour[i + 1], tour[i]
    assert [r.filename for r in got.orderBy("position").collect()] == tour


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_pieces_without_rows_for_pairs(spark):
    """The ranks of all pairs with copies, equal scores, empty and missing fingerprints; no row of the plan stands for a pair."""
    rng, rows = random.Random(9), []
    for i in range(70):
        s, t = [float(rng.randrange(3)) for _ in range(6)], [rng.uniform(-0.2 if i % 2 else 0, 1) for _ in range(4)]
        rows += [(f"p{i:02d}{c}", s, t) for c in "abcdefg"[: 7 if i == 3 else 1 + i % 2]]
    rows += [("z0", [0.0] * 6, rows[0][2]), ("z1", rows[0][1], None), ("z2", rows[5][1], [0.0] * 4)]
    df = spark.createDataFrame(rows, "filename string, structure array<double>, texture array<double>")
    got = sections.similar(df)
    plan = plan_of(got)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    a, b = (df.select(F.col("filename").alias(n), F.col("structure").alias(f"s{n}"), F.col("texture").alias(f"t{n}")) for n in "ab")
    pairs = a.join(b, F.col("a") != F.col("b")).select("a", "b", (0.6 * sections.cosine("sa", "sb") + 0.4 * sections.cosine("ta", "tb")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.desc("b")))).where("rank <= 3")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sections.similar(df.limit(1)).count() == 0 and sections.similar(df.limit(3)).count() == 6


@pytest.mark.parametrize("name", ["piece_narratives", "pair_similarity_topk", "similarity_edges"])
def test_sections_are_found_once(spark, name):
    """What several steps read is settled before the pieces are compared, and pieces are not paired row by row."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    plan = plan_of(df)
    assert "CoGroups" not in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert df.count() > 0


def test_restarts_share_their_passes(spark):
    """Ten starts take as many jobs as one takes passes, and the best of them is as good as that of single starts."""
    rng = random.Random(2)
    rows = [(i, rng.gauss(8 * (i % 4), 1), rng.gauss(5 * (i % 2), 1), 1.0) for i in range(400)] + [(400, None, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("restarts", "k-means")
    got, centers, cost = clusters.kmeans_with_centers(df, ["a", "b", "c"], 4)
    jobs = len(tracker.getJobIdsForGroup("restarts"))
    spark.sparkContext.setJobGroup("others", "others")
    v = clusters._assembled(df, ["a", "b", "c"])
    assert cost <= clusters._fit(v, 4, 3).summary.trainingCost * 1.001 and jobs < 40
    assert len({r.cluster for r in got.collect()}) == len(centers) == 4
    flat = spark.createDataFrame([(1.0,)] * 5, "a double")
    assert {r.cluster for r in clusters.kmeans(flat, ["a"], 3).collect()} == {0}
