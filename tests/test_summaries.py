"""Summaries, narratives and questions on small inputs with known answers."""

from __future__ import annotations

import pytest

from cadentia.operators import narrative, summaries

SECTION = "filename string, section int, start double, end double, m double, slope double, arc string, section_type string, mood string, tags array<string>"


def section(n, start, kind="plateau", arc="plateau", m=0.5, tags=(), name="a.wav", mood=None):
    return (name, n, float(start), start + 20.0, m, 0.0, arc, kind, mood, list(tags))


def test_prose_caps_fills_and_names_new_tags(spark):
    rows = [section(i + 1, 20 * i, tags=["pad", f"t{i}"]) for i in range(9)] + [section(1, 65, "climax", "peak", name="b.wav", mood="warm_glow")]
    got = {r.filename: r.narrative for r in narrative.prose(spark.createDataFrame(rows, SECTION)).collect()}
    assert got["a.wav"].count("New here: ") == 3 and "t4" not in got["a.wav"]  # 1 + 2 + 2 + 2 sentences reach the cap
    assert "1:05" in got["b.wav"] and "warm glow" in got["b.wav"] and got["b.wav"].count(narrative.FILLER) == 2
    assert got["b.wav"].startswith("From 1:05 everything meets at full strength, warm glow in mood") and "{" not in got["a.wav"] + got["b.wav"]
    assert len(got["b.wav"].split()) >= narrative.LEAST_WORDS


def test_prose_of_nothing_and_of_unknown_types(spark):
    assert narrative.prose(spark.createDataFrame([], SECTION)).count() == 0
    one = narrative.prose(spark.createDataFrame([section(1, 0, kind=None, arc=None)], SECTION)).first()
    assert one.narrative and "None" not in one.narrative


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("What's happening at 1:30?", ("time", 90.0)),
        ("what is the emotional arc", ("everything", None)),  # "what " holds "at ", and no time follows
        ("Describe this", ("arc", None)),
        ("the most intense part", ("climax", None)),
        ("which sounds like this", ("similar", None)),
        ("", ("everything", None)),
    ],
)
def test_route(question, want):
    assert narrative.route(question) == want


def test_ask(spark):
    secs = spark.createDataFrame([section(1, 0, m=0.9), section(2, 20, "climax", m=0.8), section(3, 40, "climax", m=0.9)], SECTION)
    alike = spark.createDataFrame([("a.wav", "c.wav", 1), ("a.wav", "b.wav", 2)], "filename string, other string, rank int")
    none = spark.createDataFrame([], "filename string, structure array<double>")
    told = narrative.narratives(secs, none, none.withColumnRenamed("structure", "texture"), alike)
    assert told.first().duration == 60 and told.first().similar_to == ["c.wav", "b.wav"]
    assert [r.section for r in narrative.ask(told, "a.wav", "around 0:20").collect()] == [2]
    assert narrative.ask(told, "a.wav", "the peak").first().section == 2
    assert [r.other for r in narrative.ask(told, "a.wav", "similar ones").collect()] == ["c.wav", "b.wav"]
    assert narrative.ask(told, "a.wav", "story").first().narrative
    assert narrative.ask(told, "z.wav", "story").count() == 0


def test_peers_skip_self_and_clusters_of_none(spark):
    df = spark.createDataFrame([(f"f{i}", 0) for i in range(7)] + [("g", 1), ("h", None)], "filename string, cluster int")
    got: dict[str, list[str]] = {}
    for r in summaries.peers(df).orderBy("filename", "rank").collect():
        got.setdefault(r.filename, []).append(r.peer)
    assert got["f0"] == ["f1", "f2", "f3", "f4"] and got["f6"] == ["f0", "f1", "f2", "f3"] and set(got) == {f"f{i}" for i in range(7)}


def test_sequence_quality_of_one_track(spark):
    df = spark.createDataFrame([("p", 1, "C", 0.9, 100.0, 0.1, "warm", "organic", 60.0, 900.0)], "list string, position int, key string, key_confidence double, tempo double, energy double, mood string, character string, duration double, brightness double")
    one = summaries.sequence_quality(df, "list").first()
    assert (one.mean_transition, one.min_transition, one.weakest, one.quality) == (0.0, None, None, "Poor")
    two = summaries.sequence_quality(df.unionByName(df.selectExpr("list", "2 as position", "key", "key_confidence", "tempo", "energy", "mood", "character", "duration", "brightness")), "list").first()
    assert two.weakest == 1 and two.min_transition == 10 + 2 + 8 + 6 + 4 + 4 + 3 + 3 + 2 and two.quality == "Excellent"


def test_cards_sparkline_and_ends(spark):
    df = spark.createDataFrame([("a", "x", 0.6, 1.0), ("a", "y", 0.6, 2.0), ("a", "y", 0.6, 3.0), ("b", None, None, 1.0)], "filename string, mood string, energy double, t double")
    got = {r.filename: r for r in narrative.cards(df, "mood").collect()}
    assert got["a"].labels == ["y", "x"] and got["a"].tension == 1.0 and got["b"].labels == [] and got["b"].tension == 0.2
    line = narrative.sparkline(df, "t", "energy").where("filename = 'a'").orderBy("x").collect()
    assert [(r.x, r.y) for r in line] == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert summaries.energy_ends(df.where("filename = 'a'"), "filename", "t").first().progression == "Stable"


def test_summary_rows(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("a", "x", 20.0), ("b", "y", 30.0)], "filename string, phase_type string, duration double")
    assert {r.filename: r.types for r in summaries.phase_types(df).collect()} == {"a": {"x": 2}, "b": {"y": 1}}
    r = summaries.phase_statistics(df).first()
    assert (r.phases, r.max_per_piece, r.median_duration) == (3, 2, 20.0)
    assert summaries.cluster_sizes(df, "filename").first().balance == 0.5
    labels = spark.createDataFrame([("a", ["exuberant", "spacey"]), ("b", None)], "filename string, moods array<string>")
    got = {r.filename: r for r in summaries.mood_energy(labels).collect()}
    assert got["a"].low == ["spacey"] and got["a"].high == ["exuberant"] and got["b"].low == []
