"""Language identification as multilingual mixture inference over byte trigrams.

A document is a mixture of languages with unknown proportions. Expectation-maximisation estimates them
from the trigram likelihoods, and the set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, spans

BUCKETS = 1 << 15
SMOOTHING = 0.3
#: Penalty of one more language: log-likelihood, as PENALTY * log(trigrams) + PENALTY_BASE. Above the
#: half of BIC, as trigrams overlap and are not independent.
PENALTY, PENALTY_BASE = 2.0, 8.0
EM_STEPS = 25

_FOLD = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the byte trigrams within words or at their edges."""
    folded = [t.translate(_FOLD) for t in texts]
    raw = np.frombuffer(b"".join(b" " + t + b" " for t in folded) + b"  ", np.uint8)
    size = np.fromiter(map(len, folded), np.int64, len(folded)) + 2
    code = (raw[:-2].astype(np.uint32) << np.uint32(16)) | (raw[1:-1].astype(np.uint32) << np.uint32(8)) | raw[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    keep = np.flatnonzero((raw[1:-1] != 32) & ((raw[:-2] != 32) | (raw[2:] != 32)))
    doc = np.repeat(np.arange(len(texts)), size)
    return doc[keep], bucket[keep].astype(np.int64)


def count_languages(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): trigram counts of all given documents (text, lang); null langs are left out."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = payloads(batch.column(0)), batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = {x: i for i, x in enumerate(names)}
            which = np.array([code[x] for x in langs])
            for lo, hi in spans(texts, 1 << 20):
                doc, bucket = trigrams(texts[lo:hi])
                n = np.bincount(which[lo:hi][doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for i, x in enumerate(names):
                    total[x] = total[x] + n[i] if x in total else n[i]
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    picked = docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log-likelihoods of the buckets; languages without a trigram are left out.

    The driver gets a row for each language and bucket, BUCKETS of them a language at most, whatever the number of documents.
    """
    rows = count_languages(docs).toPandas()
    names = sorted(rows.lang.unique().tolist())
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, rows.lang.to_numpy().astype(str)), rows.bucket.to_numpy()] = rows.n.to_numpy()
    return names, np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)


def _em(weight: np.ndarray, count: np.ndarray, first: np.ndarray, run: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents whose features lie in runs; start: proportions to begin with."""
    total = np.add.reduceat(count, first)
    share = start
    for _ in range(steps):
        joint = weight * share[run]
        mix = joint.sum(axis=1)
        share = np.add.reduceat(joint * (count / mix)[:, None], first, axis=0) / total[:, None]
        share = np.maximum(share, 1e-12) * (start > 0)
        share /= share.sum(axis=1, keepdims=True)
    return share, np.add.reduceat(count * np.log((weight * share[run]).sum(axis=1)), first)


def infer(texts: list[bytes], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages (texts x languages; zeros for a text without trigrams), and the sizes of the sets."""
    k = len(log_p)
    shares, sizes = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    doc, bucket = trigrams(texts)
    if not len(doc) or not k:
        return shares, sizes
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, bucket = key // BUCKETS, key % BUCKETS
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    ids = doc[first]
    log_w = log_p[:, bucket].T
    log_w = log_w - log_w.max(axis=1, keepdims=True)
    weight = np.exp(log_w).astype(np.float64)
    count = count.astype(np.float64)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    total = np.add.reduceat(count, first)
    alone = np.add.reduceat(log_w * count[:, None], first, axis=0)
    best = alone.argmax(axis=1)
    shares[ids, best] = 1.0
    sizes[ids] = 1
    if k == 1:
        return shares, sizes
    # The likelihood is concave in the proportions. Its slope at the best single language bounds what any
    # mixture can gain, so most documents are settled without iterating.
    own = weight[np.arange(len(doc)), best[run]]
    slope = np.add.reduceat(weight * (count / own)[:, None], first, axis=0).max(axis=1)
    penalty = PENALTY * np.log(total) + PENALTY_BASE
    open_ = slope - total > penalty
    if not open_.any():
        return shares, sizes
    take = open_[run]
    weight, count = weight[take], count[take]
    length = np.diff(np.append(first, len(doc)))[open_]
    first = np.cumsum(length) - length
    run = np.repeat(np.arange(len(length)), length)
    ids, best, penalty = ids[open_], best[open_], penalty[open_]
    like = alone[open_].max(axis=1)
    full, _ = _em(weight, count, first, run, np.full((len(ids), k), 1 / k), EM_STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        start = np.zeros_like(full)
        chosen = order[:, :size]
        np.put_along_axis(start, chosen, np.maximum(np.take_along_axis(full, chosen, 1), 1e-6), 1)
        start /= start.sum(axis=1, keepdims=True)
        share, now = _em(weight, count, first, run, start, EM_STEPS)
        better = now - like > penalty * (size - sizes[ids])
        shares[ids[better]], sizes[ids[better]] = share[better], size
        like = np.where(better, now, like)
    return shares, sizes


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs' doc_id with lang_pred, score and languages (the set with its proportions).

    Null texts, texts without a letter, and all texts if the model has no language are `und` with score 0 and
    no languages. A text with letters but no trigram takes the first language in
    alphabetical order with score 1 / languages. Ties go to the alphabetically first language.
    Every row is judged by its own text alone: rows that repeat an id, or have none, get a row each. An empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, log_p = held.value
        for batch in batches:
            texts = payloads(batch.column(1))
            pred, score, sets = [], [], []
            for lo, hi in spans(texts, 1 << 20):
                part = texts[lo:hi]
                shares, _ = infer(part, log_p)
                for t, s in zip(part, shares, strict=True):
                    if not names or not _LETTER.search(t.decode()):
                        pred.append("und")
                        score.append(0.0)
                        sets.append([])
                        continue
                    if not s.any():
                        s = np.full(len(names), 1 / len(names))
                    at = int(s.argmax())
                    pred.append(names[at])
                    score.append(min(1.0, float(s[at])))
                    sets.append([{"lang": names[i], "share": float(s[i])} for i in np.argsort(-s, kind="stable") if s[i] > 1e-6])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
