"""From sound to phases, trajectories, sections, narratives and exports."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from cadentia.__main__ import analyze
from cadentia.functions import signal
from cadentia.operators import clusters, flow, library, phases, sections, views
from cadentia.plans import recordings
from cadentia.sources import audio, sinks

SR = 22050


def wav(y: np.ndarray, sr: int = SR) -> bytes:
    data = (np.clip(y, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, sr, sr * 2, 2, 16)
    return b"RIFF" + struct.pack("<I", 12 + len(head) + len(data)) + b"WAVE" + head + b"data" + struct.pack("<I", len(data)) + data


def ramp(seconds: float = 70.0) -> np.ndarray:
    t = np.arange(int(seconds * SR)) / SR
    return (0.01 + 0.14 * t / seconds) * np.sin(2 * np.pi * 220 * t)


def jump() -> np.ndarray:
    """Thirty quiet seconds of a low tone, then thirty loud ones of noise."""
    t = np.arange(30 * SR) / SR
    return np.concatenate([0.02 * np.sin(2 * np.pi * 110 * t), 0.4 * np.random.default_rng(0).uniform(-1, 1, len(t))])


def clicks() -> np.ndarray:
    y = np.random.default_rng(1).normal(size=8 * SR) * 1e-4
    y[:: SR // 2] += 0.9
    return y


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("library")
    for name, y in {"01 ramp.wav": ramp(), "jump.WAV": jump(), "clicks.wav": clicks(), "silent.wav": np.zeros(SR * 3), "short.wav": np.zeros(100)}.items():
        (at / name).write_bytes(wav(y))
    (at / "notes.txt").write_text("no sound")
    (at / "inner").mkdir()
    (at / "inner" / "deep.wav").write_bytes(wav(clicks()))
    return str(at)


@pytest.fixture(scope="module")
def tables(spark, folder):
    return recordings.tables(audio.scan(spark, folder).repartition(3), sequence=True, n_clusters=2)


def test_listing_is_sorted_and_flat(spark, folder):
    assert [r.filename for r in audio.listing(spark, folder).collect()] == ["01 ramp.wav", "clicks.wav", "jump.WAV", "short.wav", "silent.wav"]


def test_chunks_give_the_frames_of_the_whole():
    reader = audio.Reader(wav(jump()))
    whole = signal.frame_table(audio.cleaned(audio.decode(wav(jump()))[0].mean(axis=0), SR), SR)
    parts = list(audio.chunked_frames(reader, 7))
    assert len(parts) > 5 and np.concatenate([at for at, _ in parts]).tolist() == list(range(len(whole["t"])))
    for c in audio.FRAME:
        assert np.allclose(np.concatenate([t[c] for _, t in parts]), whole[c], rtol=1e-6, atol=1e-9), c


def test_beats_follow_the_clicks():
    m = signal.magnitudes(clicks())
    tempo, _ = signal.tempo_and_onsets(m, SR)
    at = signal.beats(m, SR, 120.0)
    assert 13 <= len(at) <= 17 and np.abs(np.diff(at) - 0.5).max() < 0.06
    assert len(signal.beats(m, SR, 0.0)) == 0 and len(signal.beats(signal.magnitudes(np.zeros(SR)), SR, 120.0)) == 0 and tempo > 0


def test_tensor_profile_counts_in_bins():
    y = np.sin(2 * np.pi * 441 * np.arange(SR) / SR) + 0.0
    got = signal.tensor_profile(y)
    slow = np.abs(np.fft.fft((y / (np.abs(y).max() + 1e-8) - 0)[: np.count_nonzero(y)]))
    assert abs(int(np.argmax(slow[: len(slow) // 2])) - got["tensor_rolloff"]) <= 1 and 0.6 < got["tensor_rms"] < 0.8 and got["tensor_range"] == pytest.approx(2, abs=0.01)
    assert set(signal.tensor_profile(np.zeros(10)).values()) == {0.0}


def test_chunk_features(spark, folder):
    files = audio.scan(spark, folder).where("filename = '01 ramp.wav'")
    got = audio.chunk_features(files).orderBy("chunk_index").collect()
    assert [(r.chunk_start, r.chunk_end) for r in got] == [(0.0, 30.0), (29.0, 59.0), (58.0, 70.0)]
    assert got[0].features["rms_mean"] < got[1].features["rms_mean"] < got[2].features["rms_mean"]
    assert audio.tensor_features(files).first().features["tensor_peak"] > 0.9


def test_trajectory_windows(spark, folder):
    points = audio.trajectory(audio.scan(spark, folder))
    own = points.where("filename = '01 ramp.wav'").orderBy("rn").collect()
    n = (70 * SR - 2048) // 512 + 1
    assert len(own) == n // 87 + (n % 87 >= 43) and [r.rn for r in own] == list(range(len(own)))
    assert own[0].time == pytest.approx((43 * 512 + 1024) / SR) and all(1.9 < b.time - a.time < 2.1 for a, b in zip(own[:-1], own[1:-1]))
    assert all(a.energy < b.energy for a, b in zip(own, own[1:])) and {r.chroma_peak for r in own} == {"A"}
    noise = points.where("filename = 'jump.WAV' and rn > 18").first()
    assert noise.chroma_spread > 0.9 and noise.zcr > 0.3
    assert points.where("filename in ('silent.wav', 'short.wav')").count() == 0


def test_phases_from_sound(tables):
    got = tables["phases"].where("filename = 'jump.WAV'").orderBy("phase_number").collect()
    assert any(abs(p.start_time - 30) < 2 for p in got) and got[0].start_time == 0
    before, after = got[0], got[-1]
    assert after.energy > 5 * before.energy and after.brightness > before.brightness and after.roughness > before.roughness
    assert all(p.moods and p.phase_type and p.duration == pytest.approx(p.end_time - p.start_time) for p in got)
    structure = tables["tracks"].where("filename = 'jump.WAV'").first()
    assert structure.num_phases == len(got)


def test_sections_and_narratives_from_sound(tables):
    secs = tables["sections"].orderBy("filename", "section").collect()
    for name in ("01 ramp.wav", "jump.WAV"):
        own = [s for s in secs if s.filename == name]
        assert own and own[0].start == 0 and all(a.end == b.start for a, b in zip(own, own[1:]))
        assert all(0 < s.end - s.start <= 62 for s in own)
    assert any(abs(s.start - 30) < 8 for s in secs if s.filename == "jump.WAV")
    assert all(s.mood for s in secs if s.end - s.start > 4) and any(s.tags for s in secs)
    told = {r.filename: r for r in tables["narratives"].collect()}
    assert set(told) == {"01 ramp.wav", "jump.WAV", "clicks.wav"}
    assert 25 <= len(told["01 ramp.wav"].narrative.split()) <= 250 and set(told["jump.WAV"].similar_to) == {"01 ramp.wav", "clicks.wav"}
    assert told["jump.WAV"].duration == pytest.approx(60)


def test_rejected_and_sequence(tables):
    assert {r.filename: r.error for r in tables["rejected"].collect()} == {"silent.wav": "silent", "short.wav": "shorter than a second"}
    order = tables["sequence"].orderBy("position").collect()
    assert [r.position for r in order] == [1, 2, 3] and order[0].reasoning == "opening" and order[2].reasoning == "closing"
    assert sum(r["count"] for r in tables["profiles"].collect()) == 3


def test_analyze_writes_everything(spark, folder, tmp_path):
    out = sinks.export_path(str(tmp_path), "library")
    counts = analyze(spark, folder, out, sequence=True, n_clusters=2)
    assert counts["features"] == counts["narratives"] == counts["moods"] == 3 and counts["rejected"] == 2 and counts["sequence"] == 3
    back = spark.read.csv(f"{out}/data/features", header=True)
    assert back.columns[:3] == ["filename", "duration", "spectral_centroid_mean"] and len(back.columns) > 50
    assert len(spark.read.csv(f"{out}/data/phases", header=True).columns) == 19 and len(spark.read.csv(f"{out}/data/clusters", header=True).columns) == 24
    edges = spark.read.csv(f"{out}/data/similarity", header=True)
    assert edges.columns == ["filename_a", "filename_b", "score", "rank"] and edges.count() == 6
    told = {r.filename: r for r in sinks.read_narratives(spark, f"{out}/narratives").collect()}
    assert set(told) == {"01 ramp.wav", "jump.WAV", "clicks.wav"} and told["jump.WAV"].sections[0].section_type
    text = "\n".join(r.value for r in spark.read.text(f"{out}/narratives/markdown/name=jump").collect())
    assert text.startswith("# jump.WAV") and "## Sections" in text and "## Similar Pieces" in text and "| 0:00 |" in text
    doc = json.loads(spark.read.text(f"{out}/reports/json").first().value)
    assert set(doc) == {"tracks", "phases", "clusters"} and len(doc["tracks"]) == 3 and doc["phases"][0]["overall_structure"]["num_phases"] >= 1
    report = "\n".join(r.value for r in spark.read.text(f"{out}/reports/markdown").collect())
    assert all(f"## {name}" in report for name in sinks.REPORT)
    (tmp_path / "library_20200101_000000" / "data").mkdir(parents=True)
    assert sinks.drop_empty(spark, str(tmp_path), now=4e9) == 1 and spark.read.text(f"{out}/manifest").count() == 1
    paths = spark.createDataFrame([(f"{tmp_path}/library_20200101_000000",), (out,)], "path string")
    assert views.latest(paths).first().path == out


def test_rescore_reads_tags_anew(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"tracks": [{"filename": "a.wav", "spectral_centroid_mean": 900.0, "spectral_bandwidth_mean": 700.0, "spectral_rolloff_mean": 1800.0, "zero_crossing_rate_mean": 0.02, "character_tags": "old"}]}))
    got = sinks.rescore(spark, str(tmp_path / "e.json"), "filename string, spectral_centroid_mean double, spectral_bandwidth_mean double, spectral_rolloff_mean double, zero_crossing_rate_mean double, character_tags string").first()
    assert got.old_tags == "old" and got.changed and got.character_tags and got.primary_character


def test_peaks_on_plateaus(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([0, 1, 0, 5, 5, 5, 0, 4, 4, 0, 6, 6])]
    got = phases.local_peaks(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v", 1.0).collect()
    assert sorted(r.i for r in got) == [4, 7]  # the middle of three, the earlier of two, none at the end


def test_long_sections_are_split(spark):
    t = np.arange(0, 180, 2.0)
    v = np.abs(np.sin(np.arange(90) * np.pi / 30))
    rows = [("a", i, float(x), 0.02 + 0.13 * float(y), 1200 + 1800 * float(y), 0.04, 0.1, 0.5, 0.2 + 0.6 * float(y)) for i, (x, y) in enumerate(zip(t, v))]
    points = spark.createDataFrame(rows, "filename string, rn int, time double, energy double, brightness double, roughness double, zcr double, chroma_spread double, tension double")
    got = flow.detect_sections(points, spark.createDataFrame([("a", 180.0)], "filename string, duration double")).collect()
    assert all(s.end - s.start <= 62 for s in got) and max(s.end for s in got) == 180


def test_intervals_hold_their_points(spark):
    points = spark.createDataFrame([("a", float(i), i) for i in range(10)] + [("b", 1.0, 99)], "filename string, t double, n int")
    iv = spark.createDataFrame([("a", 1.0, 3.0, "x"), ("a", 3.0, 4.0, "y"), ("a", 6.0, 6.5, "z")], "filename string, start double, end double, name string")
    got = sorted((r.n, r.name) for r in flow.in_interval(points, iv, "t", carry=("name",)).collect())
    assert got == [(1, "x"), (2, "x"), (3, "y"), (6, "z")]


def test_kmeans_restarts_centers_and_imputed_means(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(10 * (i % 3) + rng.normal()), float(20 * (i % 3 == 1) + rng.normal()), None if i == 7 else float(i % 3 + rng.normal() / 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    got, centers, cost = clusters.kmeans_with_centers(df, ["a", "b", "c"], 3)
    labels = {r.i: r.cluster for r in got.collect()}
    assert got.columns == ["i", "a", "b", "c", "cluster"] and all(labels[i] == labels[i % 3] for i in range(60)) and len(set(labels.values())) == 3
    assert sorted(round(c["a"] / 10) for c in centers) == [0, 1, 2] and cost < 8
    assert clusters.impute_means(df, ["c"]).where("i = 7").first().c == pytest.approx(1, abs=0.1)
    v = clusters._assembled(df, ["a", "b", "c"])
    assert clusters.choose_k_by_ratio(v, 60) == 3 and clusters.choose_k(v, 60) in (3, 4, 5) and clusters.choose_k_by_ratio(v, 4) == 2 and clusters.choose_k(v, 2) == 1


def test_lloyd_seeds_and_converges(spark):
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.normal(size=(10, 10)), rng.normal(size=(10, 10)) + 20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs)], "i int, v array<double>")
    got, centers = clusters.lloyd(df, "v", 2)
    labels = [r.cluster for r in got.orderBy("i").collect()]
    assert len(set(labels[:10])) == len(set(labels[10:])) == 1 and labels[0] != labels[10]
    assert np.allclose(centers[labels[0]], blobs[:10].mean(axis=0)) and np.allclose(centers[labels[10]], blobs[10:].mean(axis=0))
    assert clusters.lloyd(df.where("false"), "v", 2)[1] == []


def test_pca_explains(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 2), 1.0) for i in range(30)], "a double, b double, c double")
    got, share = clusters.pca(df, ["a", "b", "c"])
    assert share[0] > 0.95 and got.columns == ["a", "b", "c", "pc1", "pc2"]


def test_running_total_in_ranges(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(1000)], "o int, v double").repartition(7)
    got = library.running_total(df, "o", "v", buckets=13).orderBy("o").collect()
    assert [r.total for r in got] == np.cumsum([i % 7 for i in range(1000)]).tolist() and got[-1].position_pct == 100 and got[500].position_pct == pytest.approx(500 / 999 * 100)


def test_labels_keep_rows_with_one_name(spark):
    from cadentia.operators import labels

    df = spark.createDataFrame([("a", 0.5, 4000.0, 0.3, 5.0, 60.0, 2000.0), ("a", 0.01, 500.0, 0.0, 0.0, 60.0, 100.0)], "filename string, energy double, brightness double, roughness double, onset double, duration double, bandwidth double")
    got = labels.mood_scores(df)
    assert got.count() == 2 and len({r.primary_mood for r in got.collect()}) == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_edges_name_their_scores(spark):
    v = [1.0, 0.0]
    df = spark.createDataFrame([("a", v, v), ("b", v, v)], "filename string, structure array<double>, texture array<double>")
    assert sections.edges(sections.similar(df)).columns == ["filename_a", "filename_b", "score", "rank"]
