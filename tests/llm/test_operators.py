"""Each training-data operator against a brute-force version, a round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadentia.llm import decontaminate, hnsw, language, line_dedup, packing, queries, sharding, shingles, simhash, substrings, toxicity, warc
from cadentia.llm.common import components, held_out

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 8]) for i in range(0, n, 8))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeated lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    texts: list = [prose(rng, rng.randrange(1, 260)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 7):
        texts.append(texts[i])
        cut = texts[i].split(" ")
        cut[len(cut) // 2] = "changed"
        texts.append(" ".join(cut))
        texts.append(prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20))
    texts += [None, "", " ", "one", "one two", "é" * 300, "ab" * 400, prose(rng, 5000, 30), "same line here\n" * 40, "A B C", "a b c", "\t x \n\n y"]
    return [(i * 3 + 1, t, "en", None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


def dsu(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = dsu({x for p in pairs for x in p}, pairs)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- simhash ----------------------------------------------------------------------------------------


def slow_simhash(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_xxh64_slices():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    start = rng.integers(0, 2900, 900)
    length = np.minimum(rng.integers(0, 70, 900), 3000 - start)
    want = [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(start.tolist(), length.tolist())]
    assert simhash.xxh64_slices(data, start, length).tolist() == want


def test_simhash_near_duplicates(docs):
    rows = simhash.near_duplicates(docs).collect()
    prints = {r: slow_simhash(t) for r, t, *_ in corpus()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in prints.items()}
    ids = sorted(prints)
    pairs = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in rows} == dsu(ids, pairs)


@pytest.mark.parametrize("spread", [2, 4, 64])
def test_vantage_search_finds_all_pairs(spark, spread):
    rng = random.Random(spread)
    base = [rng.getrandbits(64) for _ in range(200)]
    points = set(base)
    while len(points) < 3000:
        x = rng.choice(base)
        for _ in range(rng.randrange(1, spread)):
            x ^= 1 << rng.randrange(64)
        points.add(x)
    points = sorted(points)
    a = np.array(points, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))
    want = dsu(range(len(points)), near.tolist())
    df = spark.createDataFrame([(i, int(np.int64(np.uint64(p).view(np.int64)))) for i, p in enumerate(points)], "rep long, fp long")
    got = {r.node: r.component for r in components(simhash.near_links(df, cell_size=300)).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())


def test_keep_one(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "x"), (3, "A b c d", "y"), (None, "a b c d", "z"), (9, "quite another text of words", "w")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert out.columns == ["doc_id", "text", "fp"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string, fp string")).count() == 0


def jaccard(a: str | None, b: str | None) -> float:
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_pipeline_drops_five_word_similarity(spark):
    """Copies with replaced words at a similarity of 0.8 and more go, less similar ones and clean texts stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    texts, origin = {}, {}
    for i in range(150):
        words = [f"v{rng.randrange(3000)}" for _ in range(300)]
        texts[i * 10] = " ".join(words)
        for k in range(1, 20 if i == 0 else 3):  # one group with large bands
            own = list(words)
            for at in rng.sample(range(300), rng.randrange(1, 12)):
                own[at] = f"z{rng.randrange(10**6)}"
            texts[i * 10 + k if i else 100_000 + k], origin[i * 10 + k if i else 100_000 + k] = " ".join(own), i * 10
    df = spark.createDataFrame([(d, t, "en", None, None) for d, t in texts.items()], DOC)
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, df, "").collect()}
    score = {d: jaccard(t, texts[origin[d]]) for d, t in texts.items() if d in origin}
    assert {d for d in texts if d not in origin} <= kept
    near = [d for d, s in score.items() if s >= 0.8]
    assert len(near) > 150 and not kept & set(near)
    assert sum(s < 0.75 for s in score.values()) > 20
    links = shingles.similar_links(df.selectExpr("doc_id as id", "text"), 0.8).collect()
    assert all(jaccard(texts[r.src], texts[r.dst]) >= 0.8 for r in links)


@pytest.mark.parametrize("seed", range(6))
def test_leaf_links_span_all_pairs(seed):
    """Vantage sets and rows of the others give the components of all pairs."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(4)]
    sets = []
    for _ in range(120):
        own = base[rng.integers(4)].copy()
        swap = rng.integers(0, 60, rng.integers(0, 12))
        own[swap] = rng.integers(0, 1 << 60, len(swap))
        sets.append(np.unique(own[: rng.integers(40, 61)]))
    pairs = [(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert dsu(range(120), shingles.leaf_links(sets, 0.8)) == dsu(range(120), pairs)


def test_crowded_bands_keep_near_copies_together(spark, monkeypatch):
    """Bands of more points than a leaf holds: near copies still end in one component, others alone."""
    monkeypatch.setattr(shingles, "LEAF", 16)
    rng = random.Random(17)
    base = [f"v{rng.randrange(3000)}" for _ in range(200)]
    texts = {}
    for i in range(150):
        own = list(base)
        own[rng.randrange(200)] = f"z{i}"
        texts[i] = " ".join(own)
    texts |= {1000 + i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(5)
    found = dsu(texts, [(r.src, r.dst) for r in shingles.similar_links(df, 0.8).collect()])
    assert {found[i] for i in range(150)} == {0} and all(found[i] == i for i in texts if i >= 1000)


# ---- decontamination --------------------------------------------------------------------------------


def slow_words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not c.isdigit() and not ("a" <= c <= "z"):
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def test_decontamination(spark, docs):
    texts = {d: t for d, t, *_ in corpus()}
    some = [t for t in texts.values() if t and len(t.split()) > 60]
    items = [(i, " ".join(t.split()[5 : 5 + k]).upper()) for i, (t, k) in enumerate(zip(some, [10, 12, 9, 1, 2, 40, 60, 11]))]
    items += [(100, None), (101, "..."), (102, "nowhere to be found at all in any of these documents here"), (103, items[0][1]), (104, "ab " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in texts.items():
        w, hit, ids = slow_words(t), set(), set()
        for i, q in items:
            q = slow_words(q)
            k = min(10, len(q))
            grams = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)} if q else set()
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    ids.add(str(i))
        want[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    got = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == want
    several = decontaminate.matches(docs, bench, block_words=30)  # the same by several blocks
    assert {r.doc_id for r in several.where("size(_matches) > 0").collect()} == {d for d, x in want.items() if x[4]}
    left = decontaminate.decontaminate(docs.withColumn("words", docs.n_chars), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, x in want.items() if not x[4]}
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0


def test_longest_match(spark):
    doc = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(30)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "x y " + " ".join(f"a{i}" for i in range(4, 20)))], "item_id long, text string")
    (m,) = decontaminate.matches(doc, bench).first()._matches
    assert (m.item, m.item_pos, m.doc_pos, m.words) == ("7", 2, 4, 16)


# ---- line dedup -------------------------------------------------------------------------------------


def test_line_dedup(docs):
    lines = {d: t.split("\n") for d, t, *_ in corpus() if t is not None}
    seen, gone = set(), defaultdict(set)
    for d in sorted(lines):
        for p in range(len(lines[d]) - 2):
            w = tuple(lines[d][p : p + 3])
            if w in seen:
                gone[d] |= {p, p + 1, p + 2}
            seen.add(w)
    got = {r.doc_id: (r.text, r._n_lines, r._n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    for d, t, *_ in corpus():
        if t is None:
            assert got[d] == (None, 0, 0)
        else:
            kept = "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d])
            assert got[d] == (kept, len(lines[d]), len(gone[d]))
    assert gone


def test_line_dedup_repeated_and_null_ids(spark):
    text = "a\nb\nc\nd"
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (3, "a\nb")], "doc_id long, text string"))
    assert sorted(((r.doc_id or 0), r._n_removed) for r in out.collect()) == [(0, 0), (1, 0), (1, 4), (2, 4), (3, 0)]
    assert line_dedup.dedup_lines(out.drop("_n_lines", "_n_removed").where("false")).count() == 0


# ---- packing ----------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.TOKENIZER)
    odd = ["two  spaces", " lead", "tab\there", "line\r\nend \n", "it's 12345 don't", "<|endoftext|> x", " nbsp", "中文 テキスト 🎉🎉", "a\n\nb", "x" * 9000, "end\n"]
    extra = spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(odd)], DOC)
    rows = packing.pack(docs.unionByName(extra), queries.TOKENIZER).collect()
    texts = {d: t for d, t, *_ in corpus()} | {10_000 + i: t for i, t in enumerate(odd)}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by[d], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and len(own) == -(-len(ids) // 2048)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs.where("false"), queries.TOKENIZER).count() == 0


def test_genetic_algorithm_keeps_every_piece(spark):
    rng = random.Random(5)
    demand = Counter(rng.randrange(20, 60) for _ in range(300))
    a, b = packing.fill_down(demand, 100), packing._random_bins(demand, 100, rng)
    for bins in (a, b, packing.crossover(a, b, demand, 100, rng), packing.mutate(b, 100, rng), packing.evolve(demand, 100, 1, [])[0]):
        held = Counter()
        for k, m in bins.items():
            assert sum(k) <= 100 and m > 0
            held.update({n: c * m for n, c in Counter(k).items()})
        assert held == demand
    # an instance whose best packing is known: pieces cut from full bins
    exact = Counter()
    for _ in range(200):
        x, y = sorted(rng.sample(range(1, 100), 2))
        exact.update([x, y - x, 100 - y])
    assert packing.n_bins(packing.pack_lengths(spark, exact, 100)) <= 202


def test_generations_beat_the_greedy_filling(spark):
    """Islands evolve from random chromosomes to the lower bound, which the greedy filling misses."""
    rng = random.Random(2)
    cuts = [(rng.randrange(330, 345), rng.randrange(660, 680)) for _ in range(20)]  # full bins of three pieces of like lengths
    demand = Counter(n for x, y in cuts for n in (x, y - x, 1000 - y))
    bound = -(-sum(n * c for n, c in demand.items()) // 1000)
    told: list[dict] = []
    found = packing.pack_lengths(spark, demand, 1000, told=told)
    assert packing.n_bins(packing.fill_down(demand, 1000)) > bound
    assert min(packing.n_bins(packing._random_bins(demand, 1000, random.Random(i))) for i in range(6)) > bound
    assert packing.n_bins(found) == bound
    assert sum(g for turn in told for g, _ in turn.values()) >= packing.ISLANDS


# ---- WARC -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x.y/ä {i}", "<p>" + prose(rng, rng.randrange(1, 400)) + "é\r\n\r\n\0</p>") for i in range(60)]
    rows += [(100, "http://a", rows[3][2]), (90, "http://b", rows[3][2]), (101, None, None), (102, "u\r\nx: y", ""), (103, "http://long", "x" * 9_000_000), (50, "http://x.y/ä 50", rows[50][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    back = warc.round_trip(pages).collect()
    first = {}
    for p, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h or "").encode(), p)
    assert len(back) == len(rows)
    html = {p: (h or "").encode() for p, _, h in rows}
    for r in back:
        data = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.base32_sha1(data))
        if first[data] == r.page_id:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == data
        else:
            assert r.record_type == "revisit" and r.refers_to == first[data]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_rejects_broken_archives():
    good = [warc.record(i, "u", b"x" * i + bytes(range(200)), None) for i in range(40)]
    data = warc.archive(good)
    assert list(warc.frames(data)) == good and warc.parse(good[3])["payload_bytes"] == 203
    for bad in (b"", data[8:], data[:-3], data[: len(data) // 2], b"\x50" + data[1:]):
        with pytest.raises(warc.WarcError):
            list(map(warc.parse, warc.frames(bad)))
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date: ", b"X: "), (b"WARC-Type:", b"WARC-Type"), (b"xx", b"xy")):
        with pytest.raises(warc.WarcError):
            warc.parse(good[5].replace(a, b, 1))


# ---- embeddings -------------------------------------------------------------------------------------


def vectors(n: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, 16))
    out = []
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3, 1.0])
        out.append((i * 2, v.astype(np.float32).tolist(), int(rng.integers(3))))
    clump = rng.normal(size=16)
    out += [(10_000 + i, (clump + rng.normal(size=16) * 0.02).astype(np.float32).tolist(), 1) for i in range(150)]
    zero = [0.0] * 16
    return [*out, (1, zero, 0), (3, None, 0), (5, [1.0] * 16, None), (7, [float("nan")] * 16, 0), (9, [None] + zero[1:], 0), (11, [float("inf")] + zero[1:], 0), (13, [], 0), (15, [1.0, 2.0], 0), (17, [2.0, 4.0], 0), (19, [1e30] * 16, 2), (21, [1e30] * 16, 2)]


@pytest.mark.parametrize("shard", [8192, 90])
def test_hnsw_links(spark, shard):
    rows = vectors(600)
    got = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard_vectors=shard).collect()}
    by = defaultdict(list)
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append((i, np.array(v, float)))
    pairs = []
    for group in by.values():
        x = np.stack([v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for _, v in group])
        pairs += [(group[a][0], group[b][0]) for a, b in np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()]
    want = Counter(x for p in pairs for x in p)
    assert set(got) == {r[0] for r in rows}
    assert all(got[i].n_links <= want[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(want.values())
    root = dsu(got, pairs)
    assert sum(got[i].component_id == root[i] for i in got) >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[19].n_links == 1 and got[15].n_links == 1 and got[3].n_links == 0


def test_hnsw_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- language ---------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(4)
    sounds = {"aa": ["ba", "lo", "mi", "ke"], "bb": ["sch", "ung", "tz", "er"], "cc": ["ción", "que", "ña", "do"]}
    make = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(k, 30), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    tests = [(1000, make("aa", 60) + " " + make("bb", 30), None), (1001, None, None), (1002, "12 ... !!", None), (1003, "", "aa"), (1004, "x", None), (1005, "中文", None), (1006, make("cc", 9000), None)]
    df = spark.createDataFrame(rows + tests, "doc_id long, text string, lang string")
    model = language.fit(df.where(~held_out(df.doc_id)))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert model[0] == ["aa", "bb", "cc"]
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 118
    assert got[1000].lang_pred == "aa" and 0.5 < got[1000].score < 0.8 and [x.lang for x in got[1000].languages] == ["aa", "bb"]
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001].score == 0
    assert got[1005].lang_pred in model[0] and got[1006].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.identify(df, language.fit(df.where("false"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_mixture_matches_brute_force_search():
    """EM and the pruning bound find the set and proportions that a grid search finds."""
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.full(language.BUCKETS, 0.02), size=2) + 1e-6).astype(np.float32)
    texts = [bytes(rng.integers(97, 123, 600).astype(np.uint8)) for _ in range(6)]
    shares, sizes = language.infer(texts, log_p)
    for t, share, size in zip(texts, shares, sizes):
        _, bucket = language.trigrams([t])
        p = np.exp(log_p[:, bucket].astype(float))
        grid = np.linspace(0, 1, 2001)
        like = np.array([np.log(np.maximum(g * p[0] + (1 - g) * p[1], 1e-300)).sum() for g in grid])
        gain = like.max() - max(like[0], like[-1])
        two = gain > language.PENALTY * np.log(len(bucket)) + language.PENALTY_BASE
        assert size == (2 if two else 1)
        if two:
            assert abs(share[0] - grid[like.argmax()]) < 0.02


def test_mixture_does_not_depend_on_other_texts():
    """A text gets the set that it gets alone, also where two languages do not pay but three do."""
    rng = np.random.default_rng(3)
    log_p = np.log(rng.dirichlet(np.full(language.BUCKETS, 0.02), size=3) + 1e-6).astype(np.float32)
    sizes, texts = [], []
    for n in range(20, 400, 4):
        texts.append(bytes(rng.integers(97, 123, n).astype(np.uint8)))
        sizes.append(int(language.infer(texts[-1:], log_p)[1][0]))
    together = language.infer(texts, log_p)
    assert together[1].tolist() == sizes
    assert 1 in sizes and 3 in sizes
    for t, share in zip(texts, together[0]):
        assert np.allclose(language.infer([t], log_p)[0][0], share, atol=1e-9)


# ---- toxicity ---------------------------------------------------------------------------------------


def test_folding():
    assert "idiot" in toxicity.fold("1D10T") and "stupid" in toxicity.fold("ѕtuріd") and "loser" in toxicity.fold("l0$er")
    assert "clown" in toxicity.fold("c1own") and toxicity.fold("call 555-2186 now$$$") == "call 555-2186 now$$$"
    assert toxicity.fold("ｓｃｕｍ​") == "scum"


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["zorgish", "plimfod", "kwexil"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 80)).split(" ")
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 50 == 1:
            words.insert(3, "plain plimfod bottle")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, "you zörgish"), (5001, None), (5002, ""), (5003, "a ｚorgi$h kw3xil here"), (5004, "prezorgish word")]
    labels += [(None, 1, 1), (7, 1, None), (99_999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any("zorg".startswith(t.rstrip("*")) or t.startswith("zorg") for t in lexicon.weights)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].predicted == int(i % 9 == 0) for i in range(900))
    assert right >= 880
    assert got[5001].predicted == got[5002].predicted == got[5004].predicted == 0 and got[5003].predicted == 1
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.toxicity(docs, none).where("predicted = 1").count() == 0


def test_a_stem_that_clean_documents_hold_now_and_then_enters(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, 100, 200).split(" ")
        toxic = i % 9 == 0
        for _ in range(5 if toxic else i % 10 == 1):
            words[rng.randrange(len(words))] = f"grimb{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(t.endswith("*") and "grimb".startswith(t.rstrip("*")) for t in lexicon.weights) and len(lexicon.weights) < 5
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, lexicon).collect()}
    assert sum(got[i] == int(i % 9 == 0) for i in range(900)) >= 890


def test_exception_phrases_do_not_count():
    lexicon = toxicity.Lexicon({"trash": 5.0, "idio*": 4.0}, ["trash can"])
    weigh = lexicon.matcher()
    assert weigh("the trash can is here")[0] == 0 and weigh("you trash idiots")[0] == 9 and weigh("untrashed")[0] == 0


# ---- sharding ---------------------------------------------------------------------------------------


def test_sharding(spark, docs, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"), target_bytes=60_000, fan_in=3)
    assert store.version() == 0 and store.shards() == []
    for i in range(5):
        store.append(docs.where(f"doc_id % 5 = {i}").repartition(3))
    assert store.version() == 5 and len(store.shards()) == 15
    version = store.compact()
    assert len(store.shards(version)) < 15 and not store.plan(store.shards(version))
    back = store.read(version)
    assert sorted(map(str, back.drop("_shard").collect())) == sorted(map(str, docs.collect()))
    assert {r._shard for r in back.select("_shard").distinct().collect()} <= {s.path for s in store.shards(version)}
    with pytest.raises(sharding.ConflictError):
        store.commit(version - 1, [])
    assert store.version() == version
    store.append(docs.where("false"))
    assert store.read().count() == docs.count()


# ---- substrings -------------------------------------------------------------------------------------


def slow_repeats(texts: dict[int, bytes], width: int) -> dict[int, set[int]]:
    count = Counter(t[i : i + width] for t in texts.values() for i in range(len(t) - width + 1))
    out = {}
    for d, t in texts.items():
        out[d] = {j for i in range(len(t) - width + 1) if count[t[i : i + width]] > 1 for j in range(i, i + width)}
    return out


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 300, 1001]:
        for k in (1, 2, 4, 250):
            s = rng.integers(1, k + 1, n)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert np.argsort(substrings.suffix_ranks(s)).tolist() == want


@pytest.mark.parametrize("width,gram,bucket_runs", [(200, 64, 4000), (40, 16, 4000), (40, 16, 3)])
def test_substrings(docs, width, gram, bucket_runs):
    texts = {d: (t or "").encode() for d, t, *_ in corpus()}
    gone = slow_repeats(texts, width)
    assert any(gone.values())
    for r in substrings.remove_repeats(docs, width, gram, bucket_runs).collect():
        t, g = texts[r.doc_id], gone[r.doc_id]
        kept = bytes(c for i, c in enumerate(t) if i not in g)
        n_spans = sum(i - 1 not in g for i in g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), len(g), n_spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_substrings_crowded_anchors_in_many_buckets(spark, monkeypatch):
    """Runs of one anchor that differ in start and length keep their equal windows together."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = letters(150)
    # parts of one passage, each with text of its own around, some of which two documents share
    tails = [letters(60) for _ in range(12)]
    rows = []
    for i in range(120):
        lo, hi = rng.randrange(60), 150 - rng.randrange(60)
        rows.append((i, letters(rng.randrange(30)) + rng.choice(tails) + passage[lo:hi] + rng.choice(tails)[: rng.randrange(10, 60)] + letters(rng.randrange(30))))
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 64)
    texts = {i: t.encode() for i, t in rows}
    gone = slow_repeats(texts, 40)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 16, 3).collect()}
    assert got == {i: len(g) for i, g in gone.items()}


def test_substrings_repeated_and_null_ids(spark):
    text = prose(random.Random(9), 80)
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "x"), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(df).collect())
    n = len(text)
    assert got == [(0, n), (1, n), (1, n), (2, 0)]
    assert substrings.remove_repeats(df.where("false")).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus()
    rng = random.Random(11)
    clean = [(9000 + i, prose(rng, 100, 100_000), "en", "s", 5) for i in range(20)]
    leak = " ".join(f"q{i}" for i in range(30))
    rows += [*clean, (9500, prose(rng, 40, 100_000) + " " + leak, "en", "s", 5)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.schema == docs.schema
        docs = after
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {d for d, *_ in clean} <= packed and 9500 not in packed
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(t, []).append(d)
    for same in texts.values():
        assert len(packed & set(same)) <= 1


# ---- columns with the names that operators use, and empty tables ------------------------------------

NAMES = ["_score", "_gone", "_lines", "_n_lines", "_n_removed", "_n_words", "_matches", "id", "fp", "rep", "component", "component_id", "fingerprint", "score", "predicted", "lang_pred", "_id", "_toxic", "term", "before", "length", "start", "_task", "pos", "gone", "h1", "node"]


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns_stay_and_empty_tables_pass(spark, empty):
    rows = [(1, "a b c d e", "en"), (2, None, None), (3, "", "fr"), (None, "x y z", "de"), (4, "you stupid idiot " * 3, "en"), (5, "p\nq\nr\ns", "en"), (6, "p\nq\nr", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.where("false") if empty else docs
    for c in NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    bench = spark.createDataFrame([(1, "a b c d e"), (None, "x y z"), (2, None)], "item_id long, text string")
    lexicon = toxicity.Lexicon({"idio*": 5.0, "stup*": 5.0}, bias=-1.0)
    made = {
        "toxicity": (toxicity.drop_toxic(docs, lexicon), {1, 2, 3, None, 5, 6}),
        "simhash": (simhash.keep_one(docs), {1, 2, None, 4, 5, 6}),
        "decontaminate": (decontaminate.decontaminate(docs, bench), {2, 3, 4, 5, 6}),
        "no benchmark": (decontaminate.decontaminate(docs, bench.where("false")), {1, 2, 3, None, 4, 5, 6}),
    }
    for name, (out, want) in made.items():
        assert out.columns == docs.columns, name
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == (set() if empty else want), name
        assert all(r[c] == f"{c}{i}" for i, r in got.items() if i is not None for c in NAMES), name
    out = line_dedup.dedup_lines(docs, n_lines="lines_in", n_removed="lines_out")
    assert out.columns == [*docs.columns, "lines_in", "lines_out"]
    got = {r.doc_id: r for r in out.collect()}
    assert empty or (got[6].lines_out == 3 and got[5].lines_out == 0 and got[5]["_lines"] == "_lines5" and got[6]["_n_lines"] == "_n_lines6")
    for f in (lambda: toxicity.toxicity(docs, lexicon), lambda: decontaminate.contamination(docs, bench), lambda: language.identify(docs, language.fit(docs)), lambda: substrings.remove_repeats(docs), lambda: packing.pack(docs, queries.TOKENIZER)):
        assert f().count() == (0 if empty else len(rows))
