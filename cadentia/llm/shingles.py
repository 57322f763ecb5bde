"""Documents alike in their word shingles: MinHash finds candidates, exact Jaccard similarity decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, payloads, remove, spans
from .simhash import xxh64_slices

WORDS = 5
#: Bands of rows: at similarity 0.8 all bands differ with a chance of (1 - 0.8 ** ROWS) ** BANDS = 0.0002.
BANDS, ROWS = 16, 4
#: Points of a leaf at most; bands of up to SMALL points with the same points are one leaf.
LEAF, SMALL = 2048, 8
#: Vantage sets of a leaf, and following bands by which crowded bands are ordered.
VANTAGES, NEXT = 3, 4
#: Points outside the largest component of a crowded band that one block asks for.
ASKED = 512

U64 = np.uint64
_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, U64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, U64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, limits): the sorted distinct shingle hashes of text i are hashes[limits[i] : limits[i + 1]].

    Words are parted by ASCII white space and compared in lower case. A text of fewer words is one shingle; a
    wordless one has none.
    """
    split = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    limits = np.zeros(len(texts) + 1, np.int64)
    if not n.sum():
        return np.empty(0, U64), limits
    flat = [w for own in split for w in own]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    made = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), made)
    first = np.cumsum(made) - made
    w = np.arange(len(text)) - (first - (np.cumsum(n) - n))[text]
    last = np.where(n >= words, words - 1, n - 1)[text]
    h = xxh64_slices(b" ".join(flat), begin[w], end[w + last] - begin[w])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    limits[1:] = np.cumsum(np.bincount(text, minlength=len(texts)))
    return h, limits


def signatures(h: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """MinHash values (texts x BANDS * ROWS) of sets, none of them empty."""
    out = np.empty((len(limits) - 1, BANDS * ROWS), np.uint32)
    for i, (m, a) in enumerate(zip(_MULTIPLY, _ADD, strict=True)):
        out[:, i] = np.minimum.reduceat(((h ^ (h >> U64(29))) * m + a) >> U64(32), limits[:-1])
    return out


def _sketch(batches):
    for batch in batches:
        texts = payloads(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in spans(texts, 1 << 19):
            h, limits = shingle_sets(texts[lo:hi])
            full = np.flatnonzero(np.diff(limits))
            if len(full):
                limits = np.append(limits[full], len(h))
                values = signatures(h, limits)
                sets = [xxhash.xxh3_64_intdigest(h[a:b].tobytes()) - (1 << 63) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
                bands = [[xxhash.xxh3_64_intdigest(v[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, BANDS * ROWS, ROWS)] for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][full]), pa.array(sets, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "shingles", "bands"])


def _sets(batches):
    """(rep, hashes): the sorted shingle hashes of texts (rep, text), as bytes."""
    for batch in batches:
        texts = payloads(batch.column(1))
        out = []
        for lo, hi in spans(texts, 1 << 19):
            h, limits = shingle_sets(texts[lo:hi])
            out += [h[a:b].tobytes() for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "hashes"])


def leaf_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that span the components of the graph of all pairs of sets with a Jaccard similarity of least or more.

    A vantage set is compared with all; what it links lies in one component, whose inner pairs need no comparison.
    After a few vantage sets every set outside the largest component is compared with all others.
    """
    k = len(sets)
    size = np.fromiter(map(len, sets), np.int64, k)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(k), size)[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(begin, len(flat)))
    code = np.empty(len(flat), np.int64)  # the number of each shingle, in the order of the sets
    code[order] = np.repeat(np.arange(len(begin)), count)
    first = np.cumsum(size) - size
    label, out = np.arange(k), []

    def compare(i: int) -> None:
        own = code[first[i] : first[i] + size[i]]
        own = own[count[own] > 1]
        n = count[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=k)
        for j in np.flatnonzero(both >= least * (size + size[i] - both)).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]

    asked = np.zeros(k, bool)
    for _ in range(min(VANTAGES, k)):
        sizes = np.bincount(label[~asked], minlength=k)[label]
        i = int(np.argmax(np.where(asked, -1, np.where(label == np.arange(k), sizes, 0))))
        if asked[i]:
            break
        compare(i)
        asked[i] = True
    largest = np.argmax(np.bincount(label, minlength=k))
    for i in np.flatnonzero((label != largest) & ~asked).tolist():
        compare(i)
    return out


def _leaves(least: float):
    """mapInArrow function: links (src, dst) of rows (leaf, rep, hashes) that come sorted by leaf."""

    def run(batches):
        leaf, reps, sets = None, [], []

        def close():
            found = leaf_links([np.frombuffer(s, U64) for s in sets], least) if len(sets) > 1 else []
            return [(reps[i], reps[j]) for i, j in found]

        for batch in batches:
            out = []
            for at, rep, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != leaf:
                    out += close()
                    leaf, reps, sets = at, [], []
                reps.append(rep)
                sets.append(hashes)
            yield _links(out)
        yield _links(close())

    return run


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(hashes, begin, count, owner, size) of sets: owner[begin[i] : begin[i] + count[i]] hold hashes[i]."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), size)[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[begin], begin, np.diff(np.append(begin, len(flat))), owner, size


def _alike(own: np.ndarray, index: tuple[np.ndarray, ...], least: float) -> list[int]:
    """The indexed sets that have a Jaccard similarity of least or more with a set."""
    hashes, begin, count, owner, size = index
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    at = at[hashes[at] == own]
    n = count[at]
    both = np.bincount(owner[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(size))
    return np.flatnonzero(both >= least * (size + len(own) - both)).tolist()


def _asked(least: float):
    """mapInArrow function: links (src, dst) of rows (leaf, asks, rep, label, hashes) that come sorted by leaf, those that ask
    first: between these and the others, where their labels are not linked yet. Only those that ask are held."""

    def run(batches):
        leaf, held, index, above = None, [], None, {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        for batch in batches:
            out = []
            for at, asks, rep, label, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != leaf:
                    leaf, held, index, above = at, [], None, {}
                own = np.frombuffer(hashes, U64)
                if asks:
                    held.append((rep, label, own))
                    continue
                index = index or _index([x[2] for x in held])
                for i in _alike(own, index, least):
                    a, b = top(held[i][1]), top(label)
                    if a != b:
                        out.append((held[i][0], rep))
                        above[max(a, b)] = min(a, b)
            yield _links(out)

    return run


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, their place in an order; no task holds more than a range of them."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("at", F.monotonically_increasing_id()), "ranked")
    each = placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    offsets, total = [], 0
    for r in sorted(each, key=lambda r: r.p):
        offsets.append((r.p, total))
        total += r.n
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, "p long, n long"))
    placed = placed.join(before, F.shiftright("at", 33) == F.col("p"))
    return placed.select(*rows.columns, (F.col("n") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def _crowded(hot: DataFrame) -> DataFrame:
    """(leaf, rep) of the members (band, rep, next) of bands with more than LEAF: in the order of their next bands they are dealt
    into overlapping leaves, so that members that also agree there meet, and leaves of near copies hang together."""
    chunk = F.floor(F.col("rank") / (LEAF // 2))
    return _ranked(hot, "band", "next", "rep").select(F.explode(F.array(F.xxhash64("band", chunk), F.xxhash64("band", chunk + 1))).alias("leaf"), "rep")


def _rest(hot: DataFrame, sets: DataFrame, links: DataFrame, least: float) -> DataFrame | None:
    """The links between members (band, rep) of crowded bands that links leave apart; None where there is nothing to ask.

    Members of one component need no comparison, so every member outside the largest component of its band is compared with
    all members of the band. Both sides come in blocks in the order of their sizes, and only blocks whose sizes allow the
    similarity meet: with many outsiders this costs the square of their number, and leaves nothing out.
    """
    spark = hot.sparkSession
    found = components(links, "crowds")
    sized = sets.select("rep", (F.octet_length("hashes") / 8).cast("long").alias("size"))
    told = hot.select("band", "rep").join(sized, "rep").join(found, F.col("rep") == F.col("node"), "left")
    told = cut(told.select("band", "rep", "size", F.coalesce("component", "rep").alias("label")), "told")
    main = told.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = cut(told.join(F.broadcast(main), "band").where("label <> main").drop("main"), "outside")  # main: a row for each crowded band
    bands = outside.select("band").distinct()
    if bands.isEmpty():
        remove(spark, told, outside)
        return None
    asking = _ranked(outside, "band", "size", "rep").withColumn("ours", F.floor(F.col("rank") / ASKED))
    asked = _ranked(told.join(F.broadcast(bands), "band"), "band", "size", "rep").withColumn("theirs", F.floor(F.col("rank") / LEAF))
    block = lambda df, at, lo, hi: df.groupBy("band", at).agg(F.min("size").alias(lo), F.max("size").alias(hi))
    meet = block(asking, "ours", "a", "b").join(block(asked, "theirs", "c", "d"), "band").where((F.col("b") >= least * F.col("c")) & (F.col("d") >= least * F.col("a")))
    meet = F.broadcast(cut(meet.select("band", "ours", "theirs", F.xxhash64("band", "ours", "theirs").alias("leaf")), "meet"))
    deal = lambda df, at, asks: df.join(meet, ["band", at]).select("leaf", F.lit(asks).alias("asks"), "rep", "label")
    dealt = deal(asking, "ours", True).unionByName(deal(asked, "theirs", False)).join(sets, "rep").select("leaf", "asks", "rep", "label", "hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = cut(dealt.repartition(parts, "leaf").sortWithinPartitions("leaf", F.desc("asks")).mapInArrow(_asked(least), "src long, dst long"), "rest")
    remove(spark, told, outside)
    return out


def similar_links(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Links (src, dst) that span the groups of ids of docs(id: long, text), ids unique, whose shingle sets have a Jaccard similarity of least or more.

    Texts of one set are one point. Points that agree in a band are compared by their whole sets, in leaves of a bounded
    number of points: a band of up to LEAF points is one leaf, larger ones are parted (`_crowded`), and what their leaves leave apart
    is compared block by block (`_rest`), so the components of every band are exact. Leaves emit spanning links, not pairs. Null
    and wordless texts link with nothing here.
    """
    spark = docs.sparkSession
    sketches = cut(docs.mapInArrow(_sketch, "id long, shingles long, bands array<long>"), "sketches")
    points = cut(sketches.groupBy("shingles").agg(F.min_by("bands", "id").alias("bands"), F.min("id").alias("rep")), "points")
    copies = cut(sketches.join(points, "shingles").where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")), "links")
    exploded = points.select("rep", F.posexplode("bands").alias("tree", "band"))
    crowd = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(exploded.join(crowd, "band"), "members")
    few = members.where(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("rep")).alias("reps")).select("reps").distinct()
    small = few.select(F.xxhash64("reps").alias("leaf"), F.explode("reps").alias("rep"))
    middle = members.where((F.col("n") > SMALL) & (F.col("n") <= LEAF)).select(F.col("band").alias("leaf"), "rep")
    hot = members.where(F.col("n") > LEAF).select("band", "rep", "tree")
    leaves = small.unionByName(middle)
    if crowded := not hot.isEmpty():
        following = F.expr(f"transform(sequence(1, {NEXT}), i -> bands[(tree + i) % {BANDS}])")
        leaves = leaves.unionByName(_crowded(hot.join(points, "rep").select("band", "rep", following.alias("next"))))
    sets = cut(docs.join(members.select(F.col("rep").alias("id")).distinct(), "id").select("id", "text").mapInArrow(_sets, "rep long, hashes binary"), "sets")
    dealt = leaves.join(sets, "rep").select("leaf", "rep", "hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(dealt.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_leaves(least), "src long, dst long"), "alike")
    rest = _rest(hot, sets, found, least) if crowded else None
    remove(spark, sketches, points, members, sets)
    return copies.unionByName(found) if rest is None else copies.unionByName(found).unionByName(rest)
