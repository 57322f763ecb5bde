"""Rows whose ids are null or repeat are rows of their own: nothing of them is lost or mixed up."""

from __future__ import annotations

from collections import Counter

from cadentia.llm import hnsw, line_dedup, simhash, warc


def test_lines_of_another_text_under_the_same_id_stay(spark):
    a, b = "1\n2\n3\n4\n5\n6", "u\nv\nw\nx\ny\nz"
    shared = "s\nt\nu\n" * 3
    rows = [(1, a), (1, b), (2, a), (1, shared), (1, None), (None, a), (None, b)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, r.text) for r in out)
    assert got[1, a] == got[1, b] == got[1, None] == got[None, a] == got[None, b] == 1
    assert got[2, ""] == 1 and len(out) == len(rows)


def test_keep_one_keeps_different_texts_under_one_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (None, texts[2]), (None, texts[2]), (0, texts[3])]
    for similarity in (None, 0.8):
        out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similarity=similarity).collect()
        want = Counter({(1, texts[0]): 1, (1, texts[1]): 1, (3, texts[2]): 1, (None, texts[2]): 2, (0, texts[3]): 1})
        assert Counter((r.doc_id, r.text) for r in out) == want


def test_pages_with_null_and_repeated_ids(spark):
    rows = [(1, "u", "AAA"), (2, "u", "AAA"), (2, "v", "BBB"), (2, "v", "BBB"), (None, "w", "CCC"), (None, "w", "CCC"), (None, "x", "AAA"), (7, "y", None), (3, "y", "")]
    back = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    got = Counter((r.page_id, bytes(r.payload).decode(), r.payload_bytes, r.record_type, r.refers_to) for r in back)
    assert got == Counter({
        (1, "AAA", 3, "response", None): 1, (2, "", 3, "revisit", 1): 1, (None, "", 3, "revisit", 1): 1, (2, "BBB", 3, "response", None): 2,
        (None, "CCC", 3, "response", None): 2, (3, "", 0, "response", None): 1, (7, "", 0, "revisit", 3): 1,
    })


def test_vectors_with_repeated_ids_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (5, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, None, 0), (4, [0.0, 1.0], None)]
    got = Counter(map(tuple, hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == Counter({(1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 1, 1, False): 1, (5, 0, 5, True): 1, (None, 0, None, True): 2, (4, 0, 4, True): 1})
