"""Tables that are written on the way go when their reader is done."""

from __future__ import annotations

import os

import pytest
from test_operators import DOC, corpus

from cadentia.llm.common import cut, path_of, scratch


def test_scratch_keeps_what_it_is_told_to(spark):
    df = spark.range(5)
    with scratch(spark) as kept:
        a, b = cut(df, "a"), cut(df, "b")
        with scratch(spark) as inner:
            c, d = cut(df, "c"), cut(df, "d")
            inner.add(path_of(c))
        assert os.path.exists(path_of(c)) and not os.path.exists(path_of(d))
        kept.add(path_of(a))
    assert os.path.exists(path_of(a)) and not os.path.exists(path_of(b)) and not os.path.exists(path_of(c))
    assert a.count() == 5 and path_of(df) is None
    with pytest.raises(ZeroDivisionError), scratch(spark):
        e = cut(df, "e")
        raise ZeroDivisionError
    assert not os.path.exists(path_of(e))


def test_pipeline_leaves_its_result_only(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/cadentia"
    spark.createDataFrame(corpus(), DOC).drop("n_chars").write.parquet(str(tmp_path / "documents.parquet"))  # without the count of characters
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 50 and len(set(os.listdir(folder)) - before) == 1
