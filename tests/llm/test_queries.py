"""The registered queries themselves, on small tables in the folder layout of the real ones, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from test_operators import corpus, dsu, prose, slow_repeats, slow_simhash, slow_words, vectors

from cadentia.llm import hnsw, queries, toxicity, warc

BAD = ["zorgish", "plimfod", "kwexil"]


def crc_held_out(doc: int | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of three invented languages, some toxic, with the odd texts of corpus(); pages, vectors and a benchmark."""
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(12)
    sounds = {"aa": ["ba", "lo", "mi", "ke"], "bb": ["sch", "ung", "tz", "er"], "cc": ["ción", "que", "ña", "do"]}
    docs = [(d, t, None, "s", None if t is None else len(t)) for d, t, *_ in corpus()]
    labels = []
    for i in range(400):
        lang = "aa bb cc".split()[i % 3]
        words = ["".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randrange(20, 60))]
        toxic = i % 8 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((10_000 + i, " ".join(words), lang, "s", 1))
        labels.append((10_000 + i, 1, int(toxic)))
    texts = {d: t for d, t, *_ in docs}
    bench = [(i, " ".join(texts[k].split()[3:18])) for i, k in enumerate([10_001, 10_050, 10_300])] + [(9, None), (10, "nothing of this occurs anywhere in these texts at all today")]
    pages = [(i, f"http://x/{i}", prose(rng, rng.randrange(1, 60))) for i in range(40)] + [(100 + i, "http://y", "same" * 30) for i in range(5)] + [(99, None, None), (98, "http://z", "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(str(at / "pages.parquet"))
    spark.createDataFrame(vectors(300), "vec_id long, embedding array<float>, label int").write.parquet(str(at / "embeddings.parquet"))
    return str(at), docs, {d: t for d, _, t in labels}, bench, pages


def run(spark, tables, name):
    return queries.queries()[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    docs = tables[1]
    got = {r.doc_id: r for r in run(spark, tables, "op1_language")}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.held_out == crc_held_out(d) for d, r in got.items())
    for d, t, lang, *_ in docs:
        if not t or not regex.search(r"\p{L}", t):
            assert got[d].lang_pred == "und"
    known = [d for d, _, lang, *_ in docs if lang and crc_held_out(d)]
    assert sum(got[d].lang_pred == lang for d, _, lang, *_ in docs if lang and crc_held_out(d)) >= 0.98 * len(known)


def test_op2(spark, tables):
    prints = {d: slow_simhash(t) for d, t, *_ in tables[1]}
    ids = sorted(prints)
    a = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(ids[i], ids[j]) for i, j in np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1)).tolist()]
    root = dsu(ids, pairs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, tables, "op2_simhash")} == {d: (f"{prints[d]:016x}", root[d]) for d in ids}


def test_op3(spark, tables):
    digest = lambda t: (None, None) if t is None else (len(t.encode()), hashlib.sha256(t.encode()).hexdigest())
    got = run(spark, tables, "op3_sharding")
    assert Counter(map(tuple, got)) == Counter((d, *digest(t)) for d, t, *_ in tables[1])


def test_op4(spark, tables):
    grams = defaultdict(set)
    for i, t in tables[3]:
        w = slow_words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[j : j + 10])].add(str(i))
    for r in run(spark, tables, "op4_decontaminate"):
        w, hit, ids = slow_words(dict((d, t) for d, t, *_ in tables[1])[r.doc_id]), set(), set()
        for j in range(len(w)):
            if found := grams.get(tuple(w[j : j + 10])):
                hit |= set(range(j, min(j + 10, len(w))))
                ids |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_op5(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.TOKENIZER)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in tables[1]}
    rows = run(spark, tables, "op5_packing")
    covered = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(covered[d])):
            assert (piece, start) == (i, at) and (i == 0 or length == 2048)
            at += length
        assert at == len(x)
    for places in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_op6(spark, tables):
    payload = {p: (h or "").encode() for p, _, h in tables[4]}
    first = {}
    for p in sorted(payload):
        first.setdefault(payload[p], p)
    want = {(p, len(x), warc.base32_sha1(x), "response" if first[x] == p else "revisit", None if first[x] == p else first[x]) for p, x in payload.items()}
    got = run(spark, tables, "op6_warc")
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(payload)


def test_op7(spark, tables):
    by = defaultdict(list)
    rows = vectors(300)
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append((i, np.array(v, np.float32).astype(float)))
    pairs = []
    for group in by.values():
        x = np.stack([v / np.abs(v).max() for _, v in group])
        x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
        pairs += [(group[a][0], group[b][0]) for a, b in np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()]
    want, root = Counter(x for p in pairs for x in p), dsu([r[0] for r in rows], pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, tables, "op7_hnsw")}
    assert got == {i: (want[i], root[i], root[i] == i) for i in root}


def slow_weight(lexicon: toxicity.Lexicon, text: str) -> float:
    """Every term at every place, without an automaton."""
    total = 0.0
    for at in range(len(text)):
        if at and text[at - 1].isalpha():
            continue
        best = 0.0
        for term, w in lexicon.weights.items():
            stem = term.rstrip("*")
            end = at + len(stem)
            if not text.startswith(stem, at) or (not term.endswith("*") and end < len(text) and text[end].isalpha()):
                continue
            excused = any(text.startswith(p, k) and k <= at and end <= k + len(p) for p in lexicon.exceptions for k in range(max(0, end - len(p)), at + 1))
            best = max(best, 0.0 if excused else w)
        total += best
    return total


def test_op8(spark, tables):
    docs, labels = tables[1], tables[2]
    rows = run(spark, tables, "op8_toxicity")
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(r.held_out == crc_held_out(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [d for d in labels if crc_held_out(d)]
    assert sum(got[d].predicted == labels[d] for d in held) >= 0.97 * len(held) and any(labels[d] for d in held)
    lexicon = toxicity.learn(queries.table(spark, tables[0], "documents"), queries.table(spark, tables[0], "labels"))
    for d, t, *_ in docs:
        folded = toxicity.fold(t or "")
        if len(folded) < 2000:
            words = folded.count(" ") + folded.count("\n") + 1
            assert got[d].score == pytest.approx(lexicon.score(slow_weight(lexicon, folded), words), abs=1e-12), d


def test_matcher_equals_a_naive_one():
    """Overlapping terms, prefixes, exception phrases that nest and overlap, a very long text."""
    lexicon = toxicity.Lexicon({"trash": 5.0, "trashy": 2.0, "idio*": 4.0, "idiot": 1.0, "scum": 3.0}, ["trash can", "the trash", "can of scum", "a can of scum or two"])
    rng = random.Random(5)
    words = ["trash", "trashy", "can", "idiot", "idiots", "idio", "scum", "of", "the", "a", "or", "two", "untrash"]
    weigh = lexicon.matcher()
    for n in [*range(40), 400]:
        text = " ".join(rng.choice(words) for _ in range(n))
        assert weigh(text)[0] == pytest.approx(slow_weight(lexicon, text))
    long = "the trash can of scum " * 50_000
    assert weigh(long)[0] == 0


def test_op9(spark, tables):
    lines = {d: t.split("\n") for d, t, *_ in tables[1] if t is not None}
    seen, gone = set(), defaultdict(set)
    for d in sorted(lines):
        for p in range(len(lines[d]) - 2):
            w = tuple(lines[d][p : p + 3])
            gone[d] |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
    for r in run(spark, tables, "op9_line_dedup"):
        if r.doc_id not in lines:
            assert (r.n_lines, r.n_removed, r.text_sha256) == (0, 0, None)
            continue
        kept = "\n".join(x for i, x in enumerate(lines[r.doc_id]) if i not in gone[r.doc_id])
        assert (r.n_lines, r.n_removed, r.text_sha256) == (len(lines[r.doc_id]), len(gone[r.doc_id]), hashlib.sha256(kept.encode()).hexdigest())


def test_op10(spark, tables):
    texts = {d: (t or "").encode() for d, t, *_ in tables[1]}
    gone = slow_repeats(texts, 200)
    for r in run(spark, tables, "op10_substrings"):
        t, g = texts[r.doc_id], gone[r.doc_id]
        kept = bytes(c for i, c in enumerate(t) if i not in g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(kept).hexdigest()), r.doc_id


def test_audit_widens_beams_without_true_links():
    """Random vectors have no link; planted queries still measure the recall of a graph of production width."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    g = hnsw.Graph(hnsw._unit(x))
    a, b = hnsw.links_between(g, x, x, 0.93, True)
    assert len(a) == 0
    origin = np.arange(0, 3000, 10)
    planted = hnsw._planted(g.x[origin], 0.94)
    assert np.allclose(np.einsum("ij,ij->i", planted, g.x[origin]), 0.94, atol=1e-4)
    ids, _ = g.search(planted, hnsw.EF)
    assert (ids == origin[:, None]).any(axis=1).mean() >= 0.99
