"""Section limits of a stream."""

from __future__ import annotations

import time

from cadentia.streaming import live
from cadentia.streaming.progress import Progress


def points(name, jump, n=60):
    level = lambda i: 0.8 if i >= jump else 0.2
    return [(name, 2.0 * i, level(i), 1000 * level(i), level(i) / 10, level(i)) for i in range(n)]


SCHEMA = "filename string, time double, energy double, brightness double, roughness double, tension double"


def test_state_survives_any_cut():
    rows = points("a", 25)
    whole, found = live.Live(), []
    parts, cut = live.Live(), []
    for i, (_, t, e, b, r, s) in enumerate(rows):
        v = {"energy": e, "brightness": b, "roughness": r, "tension": s}
        found.append(whole.add(t, v))
        if i % 4 == 0:
            parts = live.Live(parts.state())
        cut.append(parts.add(t, v))
    assert found == cut and [x for x in found if x is not None] == [50.0]
    assert len(whole.times) < live.KEPT


def test_limits_of_a_stream(spark, tmp_path):
    rows = points("a", 25) + points("b", 40)
    path = str(tmp_path / "points")
    for lo in range(0, 60, 13):  # arrives in parts
        spark.createDataFrame([r for r in rows if lo <= r[1] / 2 < lo + 13], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = live.limits(stream).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(180)
    assert {(r.filename, r.t) for r in spark.sql("select * from limits").collect()} == {("a", 50.0), ("b", 80.0)}


def test_progress_tells_batches(spark, tmp_path):
    path = str(tmp_path / "rows")
    for i in range(2):
        spark.range(10).coalesce(1).write.mode("append").parquet(path)
    told = Progress()
    spark.streams.addListener(told)
    q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    for _ in range(100):
        if told.messages and told.messages[-1] == "done":
            break
        time.sleep(0.1)
    spark.streams.removeListener(told)
    assert told.messages == ["started told", "batch 0: 10 rows", "batch 1: 10 rows", "done"]
