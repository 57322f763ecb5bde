"""Removal of long repeated byte strings by a distributed difference-cover suffix sort.

1. Sample. Of every window of `width` bytes the anchor, the `gram` bytes with the smallest hash, is sampled. Equal
   windows have equal anchors at equal places, so the sample covers every pair of equal windows with one
   shift (a local-minimum cover; the residues of a fixed difference cover need every shift between
   two of its residues, and several times as many samples).
2. Name. The windows that share an anchor are a run; runs are named by anchor and content. Runs
   with equal names repeat throughout. An anchor that occurs once rules its windows out.
3. Sort. The text of the runs that have an anchor in common but not a name goes to the anchor's bucket. There the
   suffixes are sorted by DC3: the triples of the positions that are no multiple of three are sorted and
   named, the names are sorted by recursion, and the other suffixes are merged in.
4. Compare. A window repeats if it agrees with a neighbour in suffix order in its first `width` bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, payloads, release_shuffles, remove, spans

WIDTH, GRAM = 200, 64
#: Runs that one anchor may bring to a bucket; anchors with more are split by longer cores.
BUCKET_RUNS = 4000
#: Runs from which an anchor or a name may count as hot, and one part in how many of all runs it must have: no more keys are hot.
HOT_RUNS, HOT_KEYS = 4000, 10_000
#: Bytes of run text that a bucket aims at.
BUCKET_BYTES = 1 << 20

U64 = np.uint64


# ---- sample -----------------------------------------------------------------------------------------


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of base, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of gram bytes: a rolling polynomial, mixed."""
    n = len(raw)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((raw.astype(U64) + U64(1)) * _power(_BASE, n), out=total[1:])
    h = (total[gram:] - total[: n + 1 - gram]) * _power(pow(_BASE, -1, 1 << 64), n + 1 - gram)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def sample_runs(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash) of every run: consecutive windows with the same anchor occurrence."""
    w = width - gram + 1
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    if len(raw) < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),)
    h = gram_hashes(raw, gram)
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    key = np.concatenate([key, np.full(-len(key) % w, 0xFFFFFFFFFFFFFFFF, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - width + 1
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    edge = np.zeros(n, bool)
    edge[0] = True
    edge[1:] = low[1:] != low[:-1]
    edge[begin[begin < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    doc = np.searchsorted(begin, start, "right") - 1
    end = np.minimum(end, begin[doc] + size[doc] - width + 1)  # windows stay inside their text
    keep = end > start
    start, end, doc = start[keep], end[keep], doc[keep]
    anchor = (low[start] & U64(0xFFFFFFFF)).astype(np.int64)
    return doc, start - begin[doc], end - start, h[anchor]


def anchors(windows: list[bytes], width: int = WIDTH, gram: int = GRAM) -> list[int]:
    """Where the anchor of the first window of each text begins."""
    if not windows:
        return []
    w = width - gram + 1
    h = gram_hashes(np.frombuffer(b"".join(x[:width] for x in windows) + bytes(gram - 1), np.uint8), gram)
    return (h.reshape(-1, width)[:, :w] >> U64(32)).argmin(axis=1).tolist()


def runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(id, start, n, anchor, name) of every run of docs(id, text)."""

    def scan(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = payloads(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in spans(texts, 1 << 17):
                part = texts[lo:hi]
                doc, start, n, anchor = sample_runs(part, width, gram)
                name = np.fromiter((digest(part[d][s : s + k + width - 1]) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)), U64, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64))], ["id", "start", "n", "anchor", "name"]
                )

    return docs.select("id", "text").mapInArrow(scan, "id long, start int, n int, anchor long, name long")


# ---- suffix sort ------------------------------------------------------------------------------------


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of rows of non-negative numbers."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + bits > 63:
            key = np.unique(key, return_inverse=True)[1].ravel()
        key = (key << bits) | c
    return np.unique(key, return_inverse=True)[1].ravel() + 1


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of every suffix of the positive numbers s, by DC3 (Kärkkäinen, Sanders and Burkhardt 2006)."""
    n = len(s)
    if n < 4:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(1, n + 1)
        return rank
    t = np.concatenate([s.astype(np.int64), [0, 0, 0, 0]])
    # with a position past the end if n is 1 mod 3, so that a triple with a zero parts the two halves
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    names = _ranks(t[sampled], t[sampled + 1], t[sampled + 2])
    if int(names.max()) < len(sampled):
        names = suffix_ranks(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = names
    rank[n:] = 0
    zero = np.arange(0, n, 3)
    key0 = _ranks(t[zero], rank[zero + 1])
    zero = zero[np.argsort(key0, kind="stable")]
    real = sampled[sampled < n]
    real = real[np.argsort(rank[real], kind="stable")]
    # merge: a suffix at 0 mod 3 compares with one at 1 by (symbol, rank), with one at 2 by (two symbols, rank)
    m1, m2 = real[real % 3 == 1], real[real % 3 == 2]
    before = _before(np.stack([t[zero], rank[zero + 1]]), np.stack([t[m1], rank[m1 + 1]]))
    before2 = _before(np.stack([t[zero], t[zero + 1], rank[zero + 2]]), np.stack([t[m2], t[m2 + 1], rank[m2 + 2]]))
    out = np.empty(n, np.int64)
    less = before + before2
    out[zero] = np.arange(1, len(zero) + 1) + less
    out[real] = np.arange(1, len(real) + 1) + np.searchsorted(less, np.arange(len(real)), "right")
    return out


def _before(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For every row how many of the sorted others are smaller; rows of columns."""
    key = _ranks(*np.concatenate([rows, others], axis=1))
    return np.searchsorted(key[rows.shape[1] :], key[: rows.shape[1]], "left")


def repeated_windows(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each text, of at least width bytes, which of its windows also occur elsewhere in texts.

    A bucket's suffix array: texts are joined with separators; windows are compared with both
    neighbours in suffix order.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    s = raw.astype(np.int64) + 2
    s[begin + size] = 1  # smaller than any byte; windows never reach it
    rank = suffix_ranks(s)
    windows = np.concatenate([np.arange(b, b + n - width + 1) for b, n in zip(begin.tolist(), size.tolist(), strict=True)])
    order = windows[np.argsort(rank[windows], kind="stable")]
    same = np.zeros(len(order), bool)
    step = 1 << 14
    view = np.lib.stride_tricks.sliding_window_view(raw, width)
    for lo in range(0, len(order) - 1, step):
        a, b = order[lo : lo + step], order[lo + 1 : lo + step + 1]
        a = a[: len(b)]
        near = np.flatnonzero((raw[a] == raw[b]) & (raw[a + width // 2] == raw[b + width // 2]) & (raw[a + width - 1] == raw[b + width - 1]))
        same[lo + near] = (view[a[near]] == view[b[near]]).all(axis=1)
    hit = same.copy()
    hit[1:] |= same[:-1]
    found = np.zeros(len(s), bool)
    found[order[hit]] = True
    return [found[b : b + n - width + 1] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _islands(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


# ---- the operator -------------------------------------------------------------------------------------


def _split_hot(rest: DataFrame, width: int, gram: int, bucket_runs: int) -> tuple[DataFrame, DataFrame | None]:
    """Run texts (core, id, start, body, several) with no core of more than bucket_runs, and spans found on the way.

    The core of a run is what all its windows share, at first its anchor. Where too many different runs
    share one, each is parted by the place of the anchor in its windows, at the same places for every run, so
    that equal windows stay together: the core of a part is what all windows with the anchor in that range of places
    share, and parts are dealt by its hash. Parts of equal text become one. A single window is its own core, so this ends.
    """
    done = spans_ = None
    edges = [0, width - gram + 1]  # limits of the ranges of places
    join = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        crowd = cut(rest.groupBy("core").agg(F.count("*").alias("c")).where(F.col("c") > bucket_runs).select("core"), "crowd")
        if crowd.isEmpty():
            return join(done, rest), spans_
        done = join(done, rest.join(crowd, "core", "left_anti"))

        edges = sorted({*edges, *((lo + hi) // 2 for lo, hi in zip(edges, edges[1:], strict=False))})

        def part_(batches, ranges=tuple(zip(edges, edges[1:], strict=False))):
            for batch in batches:
                rows = []
                bodies = batch.column(2).to_pylist()
                for id_, start, body, several, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, batch.column(3).to_pylist(), anchors(bodies, width, gram), strict=True):
                    n = len(body) - width + 1
                    for near, far in ranges:  # the anchor is at - i bytes into window i
                        lo, hi = max(at - far + 1, 0), min(at - near + 1, n)
                        if lo < hi:
                            part, shared = body[lo : hi + width - 1], body[at - near : at - far + 1 + width]
                            rows.append((xxhash.xxh3_64_intdigest(shared, len(shared)) - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), id_, start + lo, part, several))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["core", "name", "id", "start", "body", "several"])

        hot = rest.join(crowd, "core", "left_semi").select("id", "start", "body", "several")
        parts = cut(hot.mapInArrow(part_, "core long, name long, id long, start int, body binary, several boolean"), "parts")
        same = parts.groupBy("core", "name").agg(F.count("*").alias("c"), F.max("several").alias("s"), F.min(F.struct("id", "start")).alias("first"))
        same = cut(same.select("core", "name", "first", (F.col("s") | (F.col("c") > 1)).alias("known")), "same")
        joined = parts.join(same, ["core", "name"])
        spans_ = join(spans_, joined.where("known and not several").select("id", "start", (F.octet_length("body") - (width - 1)).alias("n")))
        rest = cut(joined.where("id = first.id and start = first.start").select("core", "id", "start", "body", F.col("known").alias("several")), "rest")


def _among(rows: DataFrame, chosen: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is among the chosen ones: hot keys, HOT_KEYS at most, are looked up without a shuffle, others joined."""
    few, many = chosen.join(F.broadcast(hot), on, "left_semi"), chosen.join(F.broadcast(hot), on, "left_anti")
    cold = rows.join(F.broadcast(hot), on, "left_anti").join(many, on, "left_semi")
    return cold.unionByName(rows.join(F.broadcast(few), on, "left_semi"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_runs: int = BUCKET_RUNS) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): spans(id, start, windows) whose windows repeat, and texts(id, text) of the documents that may have some."""
    spark = docs.sparkSession
    all_runs = cut(runs(docs, width, gram), "runs")
    shared = cut(all_runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    many = max(HOT_RUNS, -(-all_runs.count() // HOT_KEYS))
    hot = shared.where(F.col("c") >= many).select("anchor")
    held = cut(_among(all_runs, shared.select("anchor"), hot, ["anchor"]), "shared")
    remove(spark, all_runs)
    release_shuffles(spark)
    names = held.groupBy("anchor", "name", "n").agg(F.count("*").alias("copies"), F.min(F.struct("id", "start")).alias("first"))
    names = cut(names, "names")
    key = ["anchor", "name", "n"]
    whole = _among(held, names.where("copies > 1").select(*key), names.where(F.col("copies") >= many).select(*key), key).select("id", "start", "n")
    # one run of each name stands for all; anchors with a single name have nothing to sort
    several = names.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    standing = _among(names, several, hot, ["anchor"]).select("anchor", F.col("first.id").alias("id"), F.col("first.start").alias("start"), "n", (F.col("copies") > 1).alias("several"))
    lists = standing.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "n", "several")).alias("at"))
    touched = held.groupBy("id").agg(F.lit(1).alias("one")).join(lists, "id", "left").select("id", "at")
    texts = cut(docs.join(touched, "id").select("id", "text", "at"), "texts")
    release_shuffles(spark)
    binary = texts.where("at is not null").select("id", F.col("text").cast("binary").alias("b"), F.explode("at").alias("r"))
    body = binary.select(F.col("r.anchor").alias("core"), "id", F.col("r.start").alias("start"), F.expr(f"substring(b, r.start + 1, r.n + {width - 1})").alias("body"), F.col("r.several").alias("several"))
    dealt, early = _split_hot(body, width, gram, bucket_runs)
    size = standing.agg(F.sum(F.col("n") + width)).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) or 1

    def sort(key, rows: pd.DataFrame) -> pd.DataFrame:
        bodies = [bytes(x) for x in rows.body]
        out = []
        for flags, id_, start, many in zip(repeated_windows(bodies, width), rows.id, rows.start, rows.several, strict=True):
            if not many:  # names with copies are spans already
                out += [(id_, start + a, b - a) for a, b in _islands(flags)]
        return pd.DataFrame(out, columns=["id", "start", "n"])

    sorted_ = dealt.withColumn("bucket", F.expr(f"pmod(core, {buckets})")).groupBy("bucket").applyInPandas(sort, "id long, start int, n int")
    found = whole.unionByName(sorted_)
    return found if early is None else found.unionByName(early), texts.select("id", "text")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, null where nothing went) and kept_sha256 of every document.

    Every byte inside a string of width bytes that starts more than once in the table, in other documents
    or the same one, goes; strings are judged on the input. Null text is empty. Rows with a null
    doc_id and all rows of a repeated doc_id are told apart by their place in the table's
    files. Matches never cross documents. An empty table gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    plain = ids.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()
    if not plain:  # give every row its own id; the written table fixes it
        picked = cut(picked.withColumn("id", F.monotonically_increasing_id()), "rows")
    else:
        picked = picked.withColumn("id", F.col("doc_id"))
    found, texts = repeated_spans(picked.select("id", "text"), width, gram, bucket_runs)
    lists = found.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("at"))

    def drop(batches):
        for batch in batches:
            out = []
            for id_, text, at in zip(batch.column(0).to_pylist(), payloads(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, at_byte, removed, n_spans = [], 0, 0, 0
                for a, n in sorted((x["start"], x["n"]) for x in at):
                    b = a + n + width - 1
                    if a > at_byte or (n_spans == 0):
                        kept.append(text[at_byte:a])
                        n_spans += 1
                        removed += b - a
                        at_byte = b
                    elif b > at_byte:
                        removed += b - at_byte
                        at_byte = b
                kept.append(text[at_byte:])
                rest = b"".join(kept)
                out.append((id_, removed, n_spans, rest, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "n_removed", "n_spans", "kept", "kept_sha256"])

    cleaned = texts.join(lists, "id").mapInArrow(drop, "id long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    told = picked.select("doc_id", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")).join(cleaned, "id", "left")
    return told.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        "kept",
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
