"""SimHash near-duplicates: fingerprints, and a vantage-point search for all pairs within a radius."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free_name, own_ids, payloads, release_shuffles, spans

# Fixed values of the public XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)
U64 = np.uint64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64_slices(buffer: bytes, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of buffer; those of 32 bytes and more go through the C library."""
    raw = np.frombuffer(buffer + bytes(8), np.uint8)
    words = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    halves = np.ndarray((len(raw) - 3,), "<u4", raw.data, strides=(1,))
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")
    size = length[order]
    n_short = int(np.searchsorted(size, 32))
    pos, rest = start[order[:n_short]].copy(), size[:n_short].copy()
    acc = rest.astype(U64) + (U64(seed) + P5)
    for step in (8, 16, 24):
        lo = int(np.searchsorted(size[:n_short], step))
        if lo == n_short:
            break
        a = acc[lo:] ^ (_rotl(words[pos[lo:]] * P2, 31) * P1)
        acc[lo:] = _rotl(a, 27) * P1 + P4
        pos[lo:] += 8
        rest[lo:] -= 8
    at = np.flatnonzero(rest >= 4)
    a = acc[at] ^ (halves[pos[at]].astype(U64) * P1)
    acc[at] = _rotl(a, 23) * P2 + P3
    pos[at] += 4
    rest[at] -= 4
    for _ in range(3):
        at = np.flatnonzero(rest > 0)
        a = acc[at] ^ (raw[pos[at]].astype(U64) * P5)
        acc[at] = _rotl(a, 11) * P1
        pos[at] += 1
        rest[at] -= 1
    acc ^= acc >> U64(33)
    acc *= P2
    acc ^= acc >> U64(29)
    acc *= P3
    acc ^= acc >> U64(32)
    out = np.empty(len(start), U64)
    out[order[:n_short]] = acc
    digest = xxhash.xxh64_intdigest
    for i in order[n_short:].tolist():
        s = int(start[i])
        out[i] = digest(buffer[s : s + int(length[i])], seed)
    return out


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each run; first: where runs begin, none empty."""
    total = np.diff(np.append(first, len(h)))
    blocks = (total + 254) // 255  # byte counters hold 255 at most
    run = np.repeat(np.arange(len(first)), blocks)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cuts = first[run] + 255 * nth
    counts = np.empty((len(cuts), 64), np.int64)
    lane = U64(0x0101010101010101)
    for b in range(8):
        sums = np.add.reduceat((h >> U64(b)) & lane, cuts)
        counts[:, b::8] = sums.view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0)


def simhash(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half the shingle hashes set it; no words: zero."""
    words: list[bytes] = []
    n = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.lower().split()
        n[i] = len(own)
        words += own
    out = np.zeros(len(texts), U64)
    if not words:
        return out
    buffer = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    full = n > 0
    made = np.where(n >= shingle, n - shingle + 1, 1)[full]
    last = np.where(n >= shingle, shingle - 1, n - 1)[full]
    first_word = (np.cumsum(n) - n)[full]
    first = np.cumsum(made) - made
    w = np.arange(int(made.sum())) - np.repeat(first - first_word, made)
    start = begin[w]
    h = xxh64_slices(buffer, start, end[w + np.repeat(last, made)] - start)
    over = 2 * _bit_counts(h, first) > made[:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (id, fp: long) per row of docs. Null and wordless texts have fingerprint zero."""

    def run(batches):
        for batch in batches:
            texts = payloads(batch.column(1))
            fp = np.zeros(len(texts), U64)
            for lo, hi in spans(texts, 1 << 20):
                fp[lo:hi] = simhash(texts[lo:hi], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


# ---- vantage-point search -------------------------------------------------------------------

#: Points that are compared without further parting, and fingerprints that the top of a tree is made from.
LEAF, SAMPLE = 384, 8192
#: Largest share of the points that one side of a useful split holds.
USEFUL = 0.85

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for n points and links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _leaf_links(fp: np.ndarray, at: np.ndarray, radius: int, out: list) -> None:
    """Spanning links of the points at. Those within radius of a vantage point hang on it, and pairs
    among them need no comparison; every other point is compared with all, in blocks."""
    near = _popcount(fp[at] ^ fp[at[0]]) <= radius
    a, b = [np.zeros(int(near.sum()), np.int64)], [np.flatnonzero(near)]
    others, block = np.flatnonzero(~near), 2048
    for i in range(0, len(others), block):
        for j in range(0, len(at), block):
            p, q = np.nonzero(_popcount(fp[at[others[i : i + block]], None] ^ fp[None, at[j : j + block]]) <= radius)
            a.append(others[p + i])
            b.append(q + j)
    a, b = np.concatenate(a), np.concatenate(b)
    label = _forest(len(at), a, b)
    moved = np.flatnonzero(label != np.arange(len(at)))
    out.append(np.stack([at[moved], at[label[moved]]], axis=1))


def _split(fp: np.ndarray, half: np.ndarray, at: np.ndarray, half_radius: int, radius: int) -> tuple[bool, int, int, int] | None:
    """(whether by whole fingerprints, vantage, limit, lower limit) of a split of the points at; None if none is useful.

    Points at distances t up to the limit go to one side, those from the lower limit on to the other. By the triangle
    bound the distances of a pair within r of each other differ by r at most, so with a lower limit of
    limit - r + 1 every such pair lies together on one side.
    """
    for whole, values, r in ((False, half, half_radius), (True, fp, radius)):
        vantage = values[at[len(at) // 2]]
        for _ in range(2):
            t = _popcount(values[at] ^ vantage)
            upto = np.cumsum(np.bincount(t, minlength=65))
            before = np.concatenate([np.zeros(r, np.int64), upto[: len(upto) - r]])  # points under limit - r + 1
            larger = np.maximum(upto, len(at) - before)
            limit = int(np.argmin(larger))
            if larger[limit] <= USEFUL * len(at):
                return whole, int(vantage), limit, limit - r + 1
            vantage = values[at[int(np.argmax(t))]]
    return None


def _sides(fp: np.ndarray, half: np.ndarray, at: np.ndarray, split: tuple[bool, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    whole, vantage, limit, lower = split
    t = _popcount((fp if whole else half)[at] ^ U64(vantage)).astype(np.int64)
    return at[t <= limit], at[t >= lower]


def vantage_links(fp: np.ndarray, half: np.ndarray, half_radius: int, radius: int) -> np.ndarray:
    """Spanning links (i, j) of all pairs within radius whose halves lie within half_radius: a recursive
    vantage-point partition by the distances of the halves, or of whole fingerprints where these part better."""
    out: list[np.ndarray] = []
    stack = [np.arange(len(fp))]
    while stack:
        at = stack.pop()
        if len(at) < 2:
            continue
        split = _split(fp, half, at, half_radius, radius) if len(at) > LEAF else None
        if split is None:
            _leaf_links(fp, at, radius, out)
        else:
            stack += _sides(fp, half, at, split)
    if not out:
        return np.empty((0, 2), np.int64)
    return np.unique(np.concatenate(out), axis=0)


def _top(fp: np.ndarray, half: np.ndarray, size: float, cell_size: int, half_radius: int, radius: int) -> list:
    """The top of a vantage-point tree over a sample whose points stand for size points each: (split, child, child) or None
    for a cell. Nodes of few sampled points are cells."""
    nodes: list = []

    def make(at: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(None)
        if len(at) * size > cell_size and len(at) >= 16 and (split := _split(fp, half, at, half_radius, radius)):
            a, b = _sides(fp, half, at, split)
            nodes[me] = (split, make(a), make(b))
        return me

    make(np.arange(len(fp)))
    return nodes


def near_links(points: DataFrame, radius: int = 3, cell_size: int = 4000) -> DataFrame:
    """Links (src, dst) that span every component of points(rep: long, fp: long) within radius bits.

    Two fingerprints within radius differ by at most radius // 2 bits in one of their halves, so a
    vantage-point tree of each half, searched with that smaller radius, finds every pair. The top of
    each tree is made from a bounded sample and deals points into cells; a point on a boundary goes to both
    sides, which at a radius of 1 is one distance in about 33. Cells are parted further by the same rule
    and emit spanning links, never all pairs. The sample only decides how evenly cells fill.
    """
    n = points.count()
    half_radius = max(1, radius // 2)
    sample = np.array([r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(U64)
    mask = U64(0xFFFFFFFF)
    halves = (lambda fp: fp & mask, lambda fp: fp >> U64(32))
    tops = [_top(sample, half(sample), n / max(1, len(sample)), cell_size, half_radius, radius) for half in halves]

    def deal(batches):
        for batch in batches:
            rep, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            for tree, nodes in enumerate(tops):
                half, stack = halves[tree](fp), [(0, np.arange(len(fp)))]
                while stack:
                    node, at = stack.pop()
                    if not len(at):
                        continue
                    if nodes[node] is None:
                        cell = pa.array(np.full(len(at), 2 * node + tree, np.int64))
                        yield pa.RecordBatch.from_arrays([cell, pa.array(rep[at]), pa.array(fp[at].view(np.int64))], ["cell", "rep", "fp"])
                        continue
                    split, a, b = nodes[node]
                    one, other = _sides(fp, half, at, split)
                    stack += [(a, one), (b, other)]

    def search(key, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows.fp.to_numpy().view(U64)
        links = vantage_links(fp, halves[int(key[0]) % 2](fp), half_radius, radius)
        rep = rows.rep.to_numpy()
        return pd.DataFrame({"src": rep[links[:, 0]], "dst": rep[links[:, 1]]})

    dealt = points.select("rep", "fp").mapInArrow(deal, "cell long, rep long, fp long")
    return dealt.groupBy("cell").applyInPandas(search, "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs.

    Equal fingerprints are aggregated first and act as one point, so copies never meet as pairs.
    component_id is the smallest doc_id that links of at most radius bits reach. Null texts
    count as wordless; wordless documents share fingerprint zero. A row with a null id gets the
    component of its fingerprint. Repeated rows each get a row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "points")
    found = components(near_links(points, radius), "simhash")
    root = points.join(found, points.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    release_shuffles(spark)
    return prints.join(root, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays.

    With similarity, documents whose sets of five-word shingles have at least that Jaccard similarity are linked too.
    Every row is a document of its own: rows that repeat a doc_id go only as near-duplicates, and of those with the
    smallest doc_id one stays. Rows with a null doc_id stay. An empty table gives no rows. All columns stay.
    """
    row = free_name(docs, "_row")
    known, _ = own_ids(docs, "doc_id", row, [F.xxhash64("text")])
    texts = known.where("doc_id is not null").select(F.col(row).alias("id"), F.col("text").cast("string").alias("text"))
    found = near_duplicates(texts, radius, shingle, id_col="id").select(F.col("doc_id").alias("node"), F.col("component_id").alias("component"))
    if similarity is not None:
        from .shingles import similar_links

        near = cut(found.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst")), "known")
        found = components(near.unionByName(similar_links(texts, similarity)), "near")
    gone = found.where("node <> component").select(F.col("node").alias(row))
    return known.join(gone, row, "left_anti").select(*docs.columns)
