"""Anchors that many runs share take another way to the same result."""

from __future__ import annotations

import random

from cadentia.llm import substrings

from test_operators import slow_repeats


def test_hot_anchors_give_the_same_spans(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_RUNS", 5)
    monkeypatch.setattr(substrings, "HOT_KEYS", 1000)
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = letters(70), letters(120)
    rows = [(i, letters(rng.randrange(60)) + passage + letters(rng.randrange(60))) for i in range(60)] + [(100 + i, copy) for i in range(20)] + [(200 + i, letters(150)) for i in range(20)]
    gone = slow_repeats({i: t.encode() for i, t in rows}, 40)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40, 16, 7).collect()}
    assert got == {i: len(g) for i, g in gone.items()}
