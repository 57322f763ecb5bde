"""Benchmark decontamination by suffix arrays of the training text, searched for every test suffix."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, payloads, spans

WINDOW = 10
#: Words of benchmark text that one block of queries may hold; each block is broadcast by itself.
BLOCK_WORDS = 2_000_000

_KEEP = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(_KEEP).split()


def _mix(ids: np.ndarray, k: int) -> np.ndarray:
    """20-bit hash of the first k ids of each row."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(k):
        h = (h ^ ids[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(44)).astype(np.int64)


class Queries:
    """The windows of a block of test items, as rows of word ids that binary search can use.

    An item of fewer than window words is one window; an item without words is none.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        rows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.items = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                k = min(window, len(ids))
                for at in range(len(ids) - k + 1):
                    rows.setdefault(tuple(ids[at : at + k]), []).append((len(self.items), at))
                self.items.append(item)
        self.owners = list(rows.values())
        self.size = np.array([len(r) for r in rows], np.int64)
        self.low = np.zeros((len(rows), window), ">u4")
        self.high = np.full((len(rows), window), 0xFFFFFFFF, ">u4")
        for i, r in enumerate(rows):
            self.low[i, : len(r)] = self.high[i, : len(r)] = r
        self.heads = {}  # of windows with at least k words: which hashes of their first k words occur
        for k in sorted({int(min(3, s)) for s in self.size}):
            of_k = self.low[np.minimum(self.size, 3) == k]
            self.heads[k] = np.zeros(1 << 20, bool)
            self.heads[k][_mix(of_k, k)] = True

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
        """Per text the number of words and its matches (item index, item position, text position, words).

        The texts are a shard: the suffixes that can begin a window are sorted by their first
        window words and every query window is located by two binary searches. Hits that continue
        each other are merged to the longest verbatim match.
        """
        get = self.vocabulary.get
        n, pieces = [], []
        gap = np.zeros(self.window, np.uint32)
        for t in texts:
            own = words_of(t)
            n.append(len(own))
            pieces.append(np.fromiter(map(get, own, itertools.repeat(0)), np.uint32, len(own)))
            pieces.append(gap)
        ids = np.concatenate([*pieces, gap])
        found: list[tuple[int, list]] = [(x, []) for x in n]
        if not len(self.owners):
            return found
        around = np.lib.stride_tricks.sliding_window_view(ids, self.window)
        at = np.flatnonzero(ids[: len(around)])
        begins = np.zeros(len(at), bool)
        for k, head in self.heads.items():
            begins |= head[_mix(around[at][:, :k], k)]
        at = at[begins]
        if not len(at):
            return found
        key = f"S{4 * self.window}"
        suffix = np.ascontiguousarray(around[at].astype(">u4")).view(key).ravel()
        order = np.argsort(suffix, kind="stable")
        suffix, at = suffix[order], at[order]
        lo = np.searchsorted(suffix, np.ascontiguousarray(self.low).view(key).ravel(), "left")
        hi = np.searchsorted(suffix, np.ascontiguousarray(self.high).view(key).ravel(), "right")
        start = np.cumsum(np.array(n) + self.window) - np.array(n) - self.window
        hits = []
        for q in np.flatnonzero(hi > lo).tolist():
            where = at[lo[q] : hi[q]]
            doc = np.searchsorted(start, where, "right") - 1
            for item, pos in self.owners[q]:
                hits.append(np.stack([doc, np.full(len(doc), item), where - start[doc] - pos, where - start[doc], np.full(len(doc), self.size[q])], axis=1))
        if hits:
            h = np.concatenate(hits)
            h = h[np.lexsort((h[:, 3], h[:, 2], h[:, 1], h[:, 0]))]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:, :3] != h[:-1, :3]).any(axis=1) | (h[1:, 3] > h[:-1, 3] + 1)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(h)) - 1
            for doc, item, diagonal, pos, end in zip(h[first, 0].tolist(), h[first, 1].tolist(), h[first, 2].tolist(), h[first, 3].tolist(), (h[last, 3] + h[last, 4]).tolist(), strict=True):
                found[doc][1].append((item, pos - diagonal, pos, end - pos))
        return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The benchmark as lists of (item, text) of at most block_words words, or of one longer item."""
    held, words = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        size = len(words_of(bytes(text)))
        if held and words + size > block_words:
            yield held
            held, words = [], 0
        held.append((item, bytes(text)))
        words += size
    yield held


MATCH = "array<struct<item:string,item_pos:long,doc_pos:long,words:long>>"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS, n_words: str = "_n_words", found: str = "_matches") -> DataFrame:
    """docs with _n_words and _matches (or the names given; columns that docs has under them are replaced): every longest verbatim match of window words or more.

    The benchmark is a query set: it comes in blocks of bounded size and each block is broadcast
    and searched against all documents; several blocks are chained narrow passes without a shuffle.
    Documents are searched whole, in shards of bounded size. Null texts have no words. Items whose
    text is null or without words match nothing; windows of an item with a null id match, without an id to name. All other columns of docs stay.
    """
    out = docs.drop(n_words, found).withColumns({n_words: F.lit(0).cast("long"), found: F.array().cast(MATCH)})
    schema = out.schema
    names = out.columns
    for items in _blocks(benchmark, item_col, "text", block_words):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches, held=held):
            queries = Queries(held.value, window)
            for batch in batches:
                texts = payloads(batch.column(names.index(text_col)))
                n, rows = [], []
                before = batch.column(len(names) - 1).to_pylist()
                for lo, hi in spans(texts, 2 << 20):
                    for words, hits in queries.search(texts[lo:hi]):
                        n.append(words)
                        rows.append([{"item": queries.items[i], "item_pos": p, "doc_pos": d, "words": w} for i, p, d, w in hits])
                rows = [a + b for a, b in zip(before, rows, strict=True)]
                kind = pa.list_(pa.struct([("item", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(rows, kind)], names=names)

        out = out.mapInArrow(scan, schema)
    return out


def covered_words(found: str) -> str:
    """SQL: number of words inside any of the matches in the column found."""
    return f"""aggregate(array_sort(transform({found}, m -> struct(m.doc_pos as a, m.doc_pos + m.words as b))),
        struct(0L as n, 0L as till), (s, m) -> struct(s.n + greatest(m.b - greatest(m.a, s.till), 0L) as n, greatest(s.till, m.b) as till), s -> s.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = matches(docs.select("doc_id", "text"), benchmark, window)
    items = "array_sort(array_distinct(array_compact(_matches.item)))"
    return m.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.expr(covered_words("_matches")).alias("n_hit"),
        F.expr(f"cast(size({items}) as long)").alias("n_items"),
        F.expr(f"sha2(array_join({items}, ','), 256)").alias("items_sha256"),
        F.expr("size(_matches) > 0").alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of a benchmark item. All columns stay, whatever their names."""
    n_words, found = free_name(docs, "_n_words"), free_name(docs, "_matches")
    return matches(docs, benchmark, window, n_words=n_words, found=found).where(F.size(found) == 0).drop(n_words, found)
