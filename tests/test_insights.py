"""Profiles, advice, headers, estimates and the command line."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.__main__ import main
from cadentia.operators import insights
from cadentia.sources import audio


def wav(seconds: float, rate: int = 8000, channels: int = 1, pitch: float = 440.0) -> bytes:
    y = (np.sin(2 * np.pi * pitch * np.arange(int(seconds * rate)) / rate) * 20000).astype("<i2")
    body = np.repeat(y, channels).tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_synthesis_profile(spark):
    df = spark.createDataFrame([("a", t) for t in ("analog_synth", "analog_synth", "mellotron", "digital_synth", "rich_texture", "warm_harmonics", None)] + [("b", "pad")], "filename string, tag string")
    got = {r.filename: r for r in insights.synthesis_profile(df, "tag", "filename").collect()}
    assert (got["a"].analog, got["a"].digital, got["a"].acoustic, got["a"].texture_complexity, got["a"].harmonic_tendency) == (0.5, 0.25, 0.25, "high", "warm")
    assert (got["b"].analog, got["b"].texture_complexity, got["b"].harmonic_tendency) == (0.0, "medium", "neutral")
    empty = insights.synthesis_profile(df.where("false")).first()
    assert (empty.analog, empty.texture_complexity) == (0.0, "medium")


def test_quality_advice(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, None) for i in range(50)] * 2, "a double, b double, c double, d double")
    r = insights.quality_advice(df, ["a", "b", "c"]).first()
    assert (r.rows, r.nulls, r.distinct) == (100, 100, 50) and len(r.advice) == 4
    assert insights.quality_advice(df.where("false"), ["a", "b"]).first().rows == 0


def test_cluster_advice(spark):
    df = spark.createDataFrame([(0, 150.0, 0.2, 70.0, 61.0, "High"), (1, 100.0, 0.01, 60.0, 0.0, "Low"), (2, None, None, None, None, None)], "cluster int, tempo double, energy double, climax_percent double, breakdown_percent double, coherence string")
    got = {r.cluster: r.advice for r in insights.cluster_advice(df).collect()}
    assert len(got[0]) == 5 and len(got[1]) == 2 and len(got[2]) == 2


def test_collection_insights(spark):
    one = spark.range(1).select(insights.collection_insights(F.lit("warm_glow"), F.lit(10.0), F.lit(5.0), F.lit(9), F.lit(3), F.lit(100.0), F.lit(90.0)).alias("x")).first().x
    assert one == ["Mostly warm glow", "Its tempos stay together", "Pieces pass through many phases", "One style prevails", "The sequence calms down"]
    none = F.lit(None).cast("double")
    assert spark.range(1).select(insights.collection_insights(none.cast("string"), none, none, none, none, none, none).alias("x")).first().x == []


@pytest.mark.parametrize("channels", [1, 2])
def test_header_agrees_with_decoding(channels):
    data = wav(2.5, 8000, channels)
    assert audio.header(data) == audio.header(data[:100]) == (channels, 8000, 16, 2.5)
    x, rate = audio.decode(data)
    assert x.shape == (channels, 20000) and rate == 8000
    with pytest.raises(audio.AudioError):
        audio.header(data[:20])


def test_metadata_and_estimate(spark, tmp_path):
    (tmp_path / "a.WAV").write_bytes(wav(2))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"no audio")
    files = audio.scan(spark, str(tmp_path))
    a, b = audio.metadata(files).orderBy("filename").collect()
    assert (a.suffix, a.channels, a.rate, a.duration, a.error) == (".wav", 1, 8000, 2.0, None) and b.error and b.rate is None
    e = audio.estimate(files).first()
    assert (e.files, e.audio_minutes, e.seconds, e.advice) == (2, 6.0, 12.0, "one run will do")
    assert audio.estimate(files.where("false")).first().advice == "nothing to do"


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"t{i}.wav").write_bytes(wav(3, 22050, pitch=220.0 * (i + 1)))
    (folder / "bad.wav").write_bytes(b"nothing")
    assert main(["info"]) == 0 and json.loads(capsys.readouterr().out)["tags"] == 64
    assert main(["analyze", str(folder), str(tmp_path / "out"), "--sequence"]) == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counts.items() >= {"features": 3, "rejected": 1, "moods": 3, "tags": 3, "sequence": 3, "phases": 3, "narratives": 3}.items()
    assert main(["estimate", str(folder)]) == 0 and json.loads(capsys.readouterr().out)["files"] == 4
    assert main(["metadata", str(folder)]) == 0 and len(capsys.readouterr().out.strip().splitlines()) == 4


def test_metadata_of_files_with_large_chunks_before_the_data(spark):
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16)
    late = b"LIST" + struct.pack("<I", 100_000) + bytes(100_000)
    data = b"data" + struct.pack("<I", 64_000) + bytes(64_000)
    rows = [(name, bytearray(x), len(x)) for name, x in (("a.wav", b"RIFF\0\0\0\0WAVE" + fmt + late + data), ("b.wav", b"RIFF\0\0\0\0WAVE" + late + fmt + data), ("c.wav", b"RIFF\0\0\0\0WAVE" + fmt + late))]
    got = audio.metadata(spark.createDataFrame(rows, "filename string, content binary, length long")).orderBy("filename").collect()
    assert [(r.channels, r.rate, r.bits, r.duration, r.error) for r in got] == [(2, 8000, 16, 2.0, None)] * 2 + [(None, None, None, None, "no format or no samples")]
