"""The library operators on small inputs with known answers."""

from __future__ import annotations

import base64
import math
import os
import struct

import numpy as np
import pytest

from cadentia import rules
from cadentia.functions import signal
from cadentia.operators import clusters, labels, library, phases, sections
from cadentia.plans import catalog
from cadentia.sources import audio, sinks
from cadentia.streaming import windows

SF = "/root/testdata/sf0.001"


def test_rule_tables():
    assert len(rules.moods()) == 117 and len(rules.tags()) == 64
    assert not rules.problems(rules.moods()) and not rules.problems(rules.tags())
    assert len({r["name"] for r in rules.moods()}) == 117


def test_moods_ties_fallback_and_bad_values(spark):
    rows = [("a", "0.01", 2500.0, 0.05, 0.2, 30.0, 1000.0), ("b", None, float("nan"), 0.9, 0.05, 1.0, 90000.0), ("c", "none", float("inf"), 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "filename string, energy string, brightness double, roughness double, onset double, duration double, bandwidth double")
    got = {r.filename: r for r in labels.mood_scores(df).collect()}
    assert got["a"].primary_mood == "spacey" and got["a"].mood_confidence == 1.0 and got["a"].moods[0] == "spacey"
    assert all(r.moods for r in got.values())
    strict = labels.mood_scores(df, threshold=1.1).collect()
    assert {r.filename: r.moods for r in strict}["c"] == ["glacial"]


def test_character(spark):
    df = spark.createDataFrame([("a", 100.0, 500.0, 100.0, 0.5)], "filename string, centroid double, bandwidth double, rolloff double, zcr double")
    row = labels.character_scores(df).first()
    assert row.primary_character == "modular_synth" and "delayed" in row.tags
    assert labels.character_scores(df, threshold=2.0).first().tags == ["pure_tone"]


def test_phase_classes_and_structure(spark):
    rows = [("x", i + 1, e, b, o, 10.0) for i, (e, b, o) in enumerate([(0.01, 0.0, 0.1), (0.2, 0.0, 3.0), (0.05, 0.0, 1.5), (0.2, 0.0, 3.0), (0.01, 0.0, 0.0)])]
    df = spark.createDataFrame(rows, "filename string, phase_number int, energy double, brightness double, onset double, duration double")
    typed = phases.classify(df)
    assert [r.phase_type for r in typed.orderBy("phase_number").collect()] == ["Intro/Ambient", "Build-up/Energetic", "Rhythmic/Percussive", "Climax/Peak", "Outro/Fade"]
    s = phases.structure(typed).first()
    assert s.has_climax and s.has_build_up and not s.has_breakdown and s.num_phases == 5 and s.energy_progression == "stable"
    assert [r.transition for r in phases.transitions(df).orderBy("phase_number").collect()][0] == "Energy Build-up"


def test_separated_peaks_prefer_height(spark):
    df = spark.createDataFrame([("f", p, h) for p, h in [(10, 1.0), (14, 5.0), (18, 2.0), (40, 1.0), (49, 1.5)]], "f string, p long, h double")
    assert sorted(r.p for r in phases.separated(df, "f", "p", "h", 10).collect()) == [14, 49]


def trajectory(spark, values, step=2.0):
    rows = [("p", i, i * step, v, 1000 + 2000 * v, v, 0.1, 0.5, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "filename string, rn long, time double, energy double, brightness double, roughness double, zcr double, chroma_spread double, tension double")


def limits(spark, values):
    t = trajectory(spark, values)
    d = spark.createDataFrame([("p", len(values) * 2.0)], "filename string, duration double")
    return sections.split_long(sections.boundaries(sections.change_score(t), d), t).first().times


def test_section_boundaries(spark):
    jump = limits(spark, [0.2] * 15 + [0.8] * 15)
    assert any(abs(t - 30) <= 8 for t in jump) and jump[0] == 0 and jump[-1] == 60
    assert limits(spark, [0.3] * 20) == [0.0, 40.0]
    assert limits(spark, [0.5] * 90) == [0.0, 180.0]
    wave = limits(spark, [0.2 + 0.6 * abs(math.sin(i * math.pi / 30)) for i in range(90)])
    assert all(b - a <= 62 for a, b in zip(wave, wave[1:]))


def test_section_types(spark):
    t = trajectory(spark, [0.1] * 10 + [0.1 + 0.05 * i for i in range(15)] + [0.9] * 10 + [0.1] * 10)
    lim = spark.createDataFrame([("p", [0.0, 20.0, 50.0, 70.0, 90.0])], "filename string, times array<double>")
    got = sections.section_stats(sections.sections(lim), t).orderBy("section").collect()
    assert [r.section_type for r in got] == ["intro", "rising", "climax", "outro"] and got[1].arc == "building"
    m = sections.motion(sections.sections(lim), t).orderBy("section").collect()
    assert m[3].direction == "falling" and m[0].rate == "gradual"


def test_similarity(spark):
    v = [0.0] * 35
    a, b = [1.0, *v[1:]], [0.0, 1.0, *v[2:]]
    df = spark.createDataFrame([("a", a, [1.0, 0.0]), ("b", a, [1.0, 0.0]), ("c", b, [0.0, 1.0]), ("z", v, [0.0, 0.0])], "filename string, structure array<double>, texture array<double>")
    got = {(r.filename, r.rank): (r.other, r.score) for r in sections.similar(df).collect()}
    assert got["a", 1] == ("b", pytest.approx(1.0)) and got["a", 2] == ("z", 0.0) and got["c", 1] == ("z", 0.0)
    assert all(k[0] != x[0] for k, x in got.items())


def test_sequence(spark):
    rows = [(f"s{i}", 0.02 + 0.01 * i, 100.0 + 7 * i, 1000.0 * i, 100.0, 0.8, k, "warm", "mellotron") for i, k in enumerate(["C", "G", "D", "A", "E", "B"])]
    df = spark.createDataFrame(rows, "filename string, energy double, tempo double, brightness double, duration double, key_confidence double, key string, mood string, character string")
    got = library.sequence(df).orderBy("position").collect()
    assert sorted(r.filename for r in got) == [r[0] for r in rows] and got[0].filename == "s0"
    score = {(r.src, r.dst): r.score for r in library.transitions(df).collect()}
    assert all(score[got[0].filename, got[1].filename] >= score[got[0].filename, r.filename] for r in got[2:3])
    assert library.sequence(df.limit(1)).count() == 1 and library.sequence(df.where("false")).count() == 0


def test_clean_and_scale(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, None), (500.0, -3.0, 2.0), (10.0, float("inf"), 4.0)], "tempo double, energy double, x double")
    got = library.clean(df, ["tempo", "energy", "x"]).collect()
    assert [tuple(r) for r in got] == [(120.0, 1.0, 3.0), (300.0, 0.0, 2.0), (30.0, 0.0, 4.0)]
    flat = library.scale(spark.createDataFrame([(1.0,), (1.0,)], "a double"), ["a"])
    assert [r.a for r in flat.collect()] == [0.0, 0.0]
    t = spark.createDataFrame([(float(i), 2.0 * i, (i * 7 % 5) / 1e3) for i in range(20)], "a double, b double, c double")
    assert library.correlated(t, ["a", "b", "c"]) == ["a"] and library.low_variance(t, ["a", "c"]) == ["c"]


def test_kmeans_separates_blobs(spark):
    rows = [(i, i % 2 * 50.0 + i / 100, i % 2 * 9.0) for i in range(20)]
    got = clusters.kmeans(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"], 2).collect()
    assert len({r.cluster for r in got if r.i % 2}) == 1 and len({r.cluster for r in got}) == 2


# ---- audio ----------------------------------------------------------------------------------------


def wav(y: np.ndarray, sr: int = 22050, bits: int = 16, channels: int = 1) -> bytes:
    scale = np.clip(y, -1, 1) * ((1 << (bits - 1)) - 1)
    if bits == 8:
        data = (scale + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        data = b"".join(struct.pack("<i", int(v))[:3] for v in scale)
    else:
        data = scale.astype(f"<i{bits // 8}").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, sr, sr * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(data)) + b"WAVE" + head + b"data" + struct.pack("<I", len(data)) + data


def aiff(y: np.ndarray, sr: int = 22050) -> bytes:
    data = (y * 32767).astype(">i2").tobytes()
    e = 16383 + 14
    comm = struct.pack(">hIhHQ", 1, len(y), 16, e, int(sr * 2 ** (63 - 14)))
    body = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", len(data) + 8, 0, 0) + data
    return b"FORM" + struct.pack(">I", 4 + len(body)) + b"AIFF" + body


def sine(hz: float, s: float = 3.0, sr: int = 22050) -> np.ndarray:
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(s * sr)) / sr)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_decode_wav(bits):
    x, sr = audio.decode(wav(sine(440), bits=bits))
    assert sr == 22050 and x.shape[0] == 1 and np.abs(x[0] - sine(440)).max() < 0.02


def test_decode_aiff_and_rejects():
    x, sr = audio.decode(aiff(sine(330)))
    assert sr == 22050 and np.abs(x[0] - sine(330)).max() < 1e-3
    for bad in (b"", b"RIFF", wav(sine(1))[:40], b"ID3" + bytes(100)):
        with pytest.raises(audio.AudioError):
            audio.decode(bad)
    for y in (np.zeros(30000), sine(440, 0.5), np.full(30000, np.nan)):
        with pytest.raises(audio.AudioError):
            audio.cleaned(y, 22050)


def test_signal_features():
    low, high = signal.features(sine(440), 22050), signal.features(sine(880), 22050)
    assert 300 < low["spectral_centroid_mean"] < 800 < high["spectral_centroid_mean"] and low["key"] == high["key"] == "A"
    y = np.random.default_rng(0).normal(size=22050)
    m = signal.magnitudes(y)
    n = np.arange(2048)
    k = 37
    slow = abs((y[512 : 512 + 2048] * np.hanning(2048) * np.exp(-2j * np.pi * k * n / 2048)).sum())
    assert m.shape == ((22050 - 2048) // 512 + 1, 1025) and m[1, k] == pytest.approx(slow, rel=1e-6)
    assert signal.features(np.zeros(100), 22050) is None
    clicks = np.zeros(22050 * 8)
    clicks[:: 22050 // 2] = 1
    tempo, onsets = signal.tempo_and_onsets(signal.magnitudes(clicks + np.random.default_rng(1).normal(size=len(clicks)) * 1e-4), 22050)
    assert min(abs(tempo - 120 * f) for f in (0.5, 1, 2)) < 6 and 10 <= len(onsets) <= 20


def test_audio_tables(spark, tmp_path):
    for name, data in {"a.wav": wav(sine(440)), "b.aif": aiff(sine(880)), "c.WAV": wav(np.zeros(50000)), "d.wav": b"", "e.txt": b"no", "st.wav": wav(np.repeat(sine(440), 2) * np.tile([1, -1], len(sine(440))), channels=2)}.items():
        (tmp_path / name).write_bytes(data)
    files = audio.scan(spark, str(tmp_path))
    got = {r.filename: r for r in audio.features(files).collect()}
    assert set(got) == {"a.wav", "b.aif", "c.WAV", "st.wav"} and got["c.WAV"].error == "silent" and got["a.wav"].key == "A"
    f = audio.frames(files)
    assert f.where("filename = 'a.wav'").count() == (66150 - 2048) // 512 + 1
    change = phases.change_signal(f, "filename", "frame_idx")
    assert change.where("change is null").count() == 0


def test_payloads(spark):
    good = base64.b64encode(wav(sine(440))).decode()
    df = spark.createDataFrame([("a.wav", good), ("b.txt", good), ("c.wav", "AAAA"), ("d.wav", None), ("e.wav", "?!")], "filename string, content string")
    got = {r.filename: r.errors for r in audio.validate_payloads(df).collect()}
    assert got == {"a.wav": [], "b.txt": ["suffix"], "c.wav": ["too small"], "d.wav": ["missing field"], "e.wav": ["not base64"]}
    assert audio.features(audio.payloads(df)).first().key == "A"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("nan", 2.5, 1.23456, ["a", "b"]), ("Fernando", float("nan"), 2.0, [])], "name string, tempo double, energy_mean double, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = {r.name: r for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()}
    assert back["Unknown"].energy_mean == "1.2346" and back["Unknown"].tags == "a, b" and back["Fernando"].tempo is None
    sinks.write_json(df, str(tmp_path / "json"))
    assert sinks.read_json(spark, str(tmp_path / "json"), "name string, tags array<string>").count() == 2
    assert "| name |" in sinks.markdown("Report", {"All": df})


def test_stream_equals_batch(spark, tmp_path):
    path = tmp_path / "events"
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartitionByRange(3, "ts").write.parquet(str(path))
    out = windows.tumbling(windows.events(spark, str(path), 10), "user_id", "1 hour", "400 days")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = sorted(map(str, windows._sums(batch, "user_id", windows.F.window("ts", "1 hour")).select("user_id", "start", "n").collect()))
    assert sorted(map(str, spark.sql("select user_id, start, n from w").collect())) == want


def test_small_helpers(spark):
    df = spark.createDataFrame([(59.9,), (3725.0,)], "s double")
    assert [tuple(r) for r in df.select(library.clock(df.s), library.clock(df.s, True)).collect()] == [("0:59", "0:59"), ("62:05", "1:02:05")]
    assert library.quality(15.1) == "Excellent" and library.quality(5) == "Poor"
    got = library.running_total(spark.createDataFrame([(1, 2.0)], "o int, v double"), "o", "v").first()
    assert got.position_pct == 0.0 and got.total == 2.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    for name in ("mood_score_tracks", "mood_detected_list", "phase_position_class", "section_stats", "correlated_pairs", "transition_scores"):
        a = catalog.queries()[name](spark, SF).toPandas()
        b = con.sql(catalog.oracle_sql()[name]).df()
        assert sorted(a.columns) == sorted(b.columns), name
        rows = lambda x: sorted(map(str, x[sorted(x.columns)].round(6).itertuples(index=False, name=None)))  # noqa: B023, E731
        assert rows(a) == rows(b), name
