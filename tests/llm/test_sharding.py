"""The store: arrivals, merges at every size, versions that stay readable, exclusive commits, expiry."""

from __future__ import annotations

import threading

import pytest

from cadentia.llm import sharding
from cadentia.llm.queries import SHARD_TARGET, op3_sharding


@pytest.mark.parametrize("n,parts,target", [(3, 1, 1000), (400, 1, 20_000), (4000, 5, 60_000), (400, 3, SHARD_TARGET)])
def test_arrivals_are_merged_at_every_size(spark, tmp_path, n, parts, target):
    df = spark.range(n).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 8) as text", "id % 3 as _shard").repartition(parts)
    store = sharding.Store(spark, str(tmp_path / "store"), target)
    arrived = store.append_all(df)
    assert arrived > 1 and len(store.shards()) >= min(n, 8)
    assert [len(store.shards(v)) for v in range(1, arrived + 1)] == sorted(len(store.shards(v)) for v in range(1, arrived + 1))
    version = store.compact()
    if len(store.shards(arrived)) >= store.fan_in:
        assert version > arrived and len(store.shards(version)) < len(store.shards(arrived))
    assert not store.plan(store.shards(version))
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, store.read().select(*df.columns).collect())) == want
    assert sorted(map(str, store.read(arrived).select(*df.columns).collect())) == want  # an older version stays readable
    assert store.read().columns == ["doc_id", "text", "_shard", "__shard"]
    store.expire()
    assert store.version() == version and sorted(map(str, store.read().select(*df.columns).collect())) == want
    files = [p for p in (tmp_path / "store" / "shards").rglob("part-*") if not p.name.startswith(".")]
    assert len(files) == len(store.shards())


def test_one_of_two_writers_gets_a_version(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"))
    store.append(spark.range(3))
    won = []

    def commit():
        try:
            won.append(store.commit(1, store.shards(1)))
        except sharding.ConflictError:
            won.append(None)

    threads = [threading.Thread(target=commit) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won, key=str) == [2, None, None, None, None, None] and store.version() == 2


def test_empty_tables_and_nulls(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    store, version = sharding.compact_table(empty, str(tmp_path / "store"))
    assert store.read(version).count() == 0 and store.read(version).columns == ["doc_id", "text", "_shard"]
    store.append(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string"))
    assert store.read().count() == 3
    with pytest.raises(ValueError):
        sharding.Store(spark, str(tmp_path / "none")).read()


def test_query_returns_every_document(spark, tmp_path):
    rows = [(i, None if i == 7 else f"text {i} " * (i % 5), "en", "s", 1) for i in range(200)] + [(3, "again", "en", "s", 1), (None, "x" * 100_000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    import hashlib

    got = sorted((str(r.doc_id), str(r.n_bytes), str(r.text_sha256)) for r in op3_sharding(spark, str(tmp_path)).collect())
    digest = lambda t: (str(None), str(None)) if t is None else (str(len(t)), hashlib.sha256(t.encode()).hexdigest())
    assert got == sorted((str(r[0]), *digest(r[1])) for r in rows)
