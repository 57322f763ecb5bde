"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Text is lower-cased, homoglyphs and digit substitutions are folded, lexicon terms are found at word
starts, and matches inside exception phrases do not count. The score is a logistic function of the
matched weight and of that weight by length.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, held_out

THRESHOLD = 0.7
#: Labelled rows that the lexicon is learned from, at most: those with the smallest hashes of their ids.
TRAINING_ROWS = 20_000
#: Shortest term; prefixes of words up to PREFIX_MAX characters compete with whole words.
TERM_MIN, PREFIX_MAX = 4, 7
#: Pairs of a term and a word before it that a task holds before it hands them on.
CONTEXTS = 1 << 17
#: How much more often toxic documents must hold a term than clean ones.
LEAST_RATIO = 8

# Letters of other scripts that look like Latin ones, and the characters that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "օ": "o",
    "ս": "u", "ո": "n", "հ": "h", "ց": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_IGNORED = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_WIDE = {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)] if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | _WIDE | _IGNORED
_MIXED = regex.compile(r"[\p{L}\d@$!|]*(?:\p{L}[\d@$!|]|[\d@$!|]\p{L})[\p{L}\d@$!|]*")
_ANY_SUBSTITUTE = regex.compile(r"(?:\p{L}[\d@$|!]+\p{L})|(?:[\d@$|]\p{L})|(?:\p{L}\d)")
_WORD = regex.compile(r"\p{L}+")
_FROM = str.maketrans(SUBSTITUTES)
_FROM_L = str.maketrans(SUBSTITUTES | {"1": "l", "!": "l", "|": "l"})


def _plain(found: regex.Match) -> str:
    token = found.group()
    core = token.rstrip("!|$@")
    tail = token[len(core) :]
    if not any(c in SUBSTITUTES for c in core) or not any(c.isalpha() for c in core):
        return token
    one, other = core.translate(_FROM), core.translate(_FROM_L)
    return (one if one == other else f"{one} {other}") + tail


def fold(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, and digit substitutions inside words as letters.

    1, ! and | can stand for i or l: a word with one of them is given in both forms.
    """
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    return _MIXED.sub(_plain, text) if _ANY_SUBSTITUTE.search(text) else text


@dataclass
class Lexicon:
    """Weights of terms; a term that ends in * is a prefix. Exceptions are phrases whose matches don't count."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    by_weight: float = 1.0
    by_density: float = 0.0

    def matcher(self):
        terms = ahocorasick.Automaton()
        for term, w in self.weights.items():
            terms.add_word(term.rstrip("*"), (len(term.rstrip("*")), term.endswith("*"), w))
        phrases = ahocorasick.Automaton()
        for p in self.exceptions:
            phrases.add_word(p, len(p))
        for a in (terms, phrases):
            if len(a):
                a.make_automaton()

        def weigh(text: str) -> tuple[float, int]:
            """Weight of all matches in folded text, and its words."""
            total, last = 0.0, len(text)
            words = text.count(" ") + text.count("\n") + 1
            if not len(terms):
                return total, words
            hits = []
            for end, (n, prefix, w) in terms.iter(text):
                start = end - n + 1
                if (start and text[start - 1].isalpha()) or (not prefix and end + 1 < last and text[end + 1].isalpha()):
                    continue
                hits.append((start, end, w))
            if hits and len(phrases):
                begin, reach = [], []  # of phrases by their start: how far any that begins here or before reaches
                for a, b in sorted((end - n + 1, end) for end, n in phrases.iter(text)):
                    begin.append(a)
                    reach.append(max(b, reach[-1]) if reach else b)
                hits = [h for h in hits if not (i := bisect.bisect_right(begin, h[0])) or reach[i - 1] < h[1]]
            seen = -1
            for start, end, w in sorted(hits, key=lambda h: (h[0], -h[2])):  # of terms that begin together the heaviest counts
                if start != seen:
                    total, seen = total + w, start
            return total, words

        return weigh

    def features(self, weight: float, words: int) -> tuple[float, float]:
        return math.log1p(weight), math.log1p(100 * weight / max(words, 1))

    def score(self, weight: float, words: int) -> float:
        a, b = self.features(weight, words)
        z = self.bias + self.by_weight * a + self.by_density * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str):
    """(term, previous word) of a folded text: its words and their prefixes."""
    before = ""
    for word in _WORD.findall(text):
        if len(word) >= TERM_MIN:
            yield word, before
            for n in range(TERM_MIN, min(PREFIX_MAX, len(word)) + 1):
                yield word[:n] + "*", before
        before = word


def _count_terms(docs: DataFrame, only=None) -> DataFrame:
    """(term, contexts): the different words that each term follows, of all terms or of those in the broadcast set only."""

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["term", "before"])

    def run(batches):
        for batch in batches:
            out: set[tuple[str, str]] = set()
            for text in batch.column(0):
                out.update(x for x in _terms(fold(text.as_py() or "")) if only is None or x[0] in only.value)
                if len(out) > CONTEXTS:
                    yield told(out)
                    out.clear()
            yield told(out)

    return docs.select("text").mapInArrow(run, "term string, before string").distinct().groupBy("term").agg(F.count("*").alias("contexts"))


def _likelihood_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """G of the rates a / n_a and b / n_b: twice the log-likelihood ratio against one common rate."""
    both = (a + b) / (n_a + n_b)
    return 2 * sum(x * math.log(x / (n * both)) for x, n in ((a, n_a), (b, n_b)) if x)


def _irls(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w * [0, *[1] * (len(w) - 1)]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[ridge] * (len(w) - 1)])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, exceptions: list[str] | None = None) -> Lexicon:
    """A lexicon from labelled documents that are not held out.

    A term is judged by the different words that it follows, so many copies of one document say no more than it alone.
    It needs more of these in toxic documents than chance gives any of the competing terms, and LEAST_RATIO times as
    many a document as in clean ones. Of a word and its prefixes the one with the greatest likelihood ratio enters: a stem
    that clean documents hold now and then is better than some of its forms that they happen to lack, as
    scores go by length. Its weight is its log-odds. Phrases of a lexicon word and a neighbour that clean
    documents hold become exceptions. With no toxic or no clean training document the lexicon is empty.

    A label stands for one text: of rows that repeat a doc_id the smallest text is learned from, of repeated labels the
    greatest. Null ids, labels and texts are left out. Of equally good terms the shorter, then the alphabetically first enters.
    """
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows).collect()  # bounded by training_rows
    picked = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in sample], "_id long, _toxic int")
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where("text is not null")
    joined = joined.groupBy("_id", "_toxic").agg(F.min("text").alias("text"))  # one text an id, so no more rows than labels
    n_toxic = sum(int(r.toxic) > 0 for r in sample)
    n_clean = len(sample) - n_toxic
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=list(exceptions or []))
    seen = cut(_count_terms(joined.where("_toxic > 0")), "terms")
    # contexts that a term needs, so that among all terms chance gives less than one that only toxic documents hold
    competing = math.log(2 * max(seen.count(), 1))
    support = max(3, min(math.ceil(competing / math.log(len(sample) / n_toxic)), n_toxic // 4))
    toxic = {r.term: r.contexts for r in seen.where(F.col("contexts") >= support).collect()}
    held = spark.sparkContext.broadcast(set(toxic))
    clean = {r.term: r.contexts for r in _count_terms(joined.where("_toxic = 0"), held).collect()}
    ranked: list[tuple[float, str, float]] = []
    for term, contexts in toxic.items():
        odds = math.log((contexts + 0.5) / (n_toxic + 1)) - math.log((clean.get(term, 0) + 0.5) / (n_clean + 1))
        ratio = _likelihood_ratio(contexts, clean.get(term, 0), n_toxic, n_clean)
        if odds >= math.log(LEAST_RATIO) and ratio >= 2 * competing:
            ranked.append((-ratio, term, odds))
    weights: dict[str, float] = {}
    inner: set[str] = set()  # all beginnings of the words and prefixes in the lexicon
    for _, term, odds in sorted(ranked, key=lambda x: (x[0], len(x[1].rstrip("*")), not x[1].endswith("*"), x[1])):
        stem = term.rstrip("*")
        if any(stem[:n] + "*" in weights for n in range(TERM_MIN, len(stem) + 1)) or (term.endswith("*") and stem in inner):
            continue
        weights[term] = odds
        inner.update(stem[:n] for n in range(TERM_MIN, len(stem) + 1))
    lexicon = Lexicon(weights, list(exceptions or []))
    sent = spark.sparkContext.broadcast(lexicon)

    def weigh(batches):
        w = sent.value.matcher()
        for batch in batches:
            folded = [fold(t or "") for t in batch.column(0).to_pylist()]
            found = [w(t) for t in folded]
            near: list[list[str]] = []
            for t, (weight, _) in zip(folded, found, strict=True):
                near.append(_phrases(t, sent.value.weights) if weight else [])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.int64()), pa.array(near, pa.list_(pa.string()))], ["toxic", "weight", "words", "near"])

    weighed = joined.select("text", "_toxic").mapInArrow(weigh, "toxic int, weight double, words long, near array<string>").toPandas()
    y = (weighed.toxic.to_numpy() > 0).astype(float)
    if exceptions is None:
        share: dict[str, list[int]] = {}
        for is_toxic, near in zip(y, weighed.near, strict=True):
            for p in set(near):
                share.setdefault(p, [0, 0])[int(is_toxic)] += 1
        lexicon.exceptions = sorted(p for p, (a, b) in share.items() if a >= 3 and b <= a // 10)
    x = np.array([lexicon.features(a, b) for a, b in zip(weighed.weight, weighed.words, strict=True)]).reshape(-1, 2)
    if not len(x) or not 0 < y.sum() < len(y):
        return lexicon
    fitted = _irls(x, y)
    if fitted[1] < 0 or fitted[2] < 0:  # more matched weight never lowers a score
        fitted = np.array([*_irls(x[:, :1], y), 0.0])
    lexicon.bias, lexicon.by_weight, lexicon.by_density = map(float, fitted)
    return lexicon


def _phrases(text: str, weights: dict[str, float]) -> list[str]:
    """Lexicon words of a folded text with a neighbouring word, where one space parts them."""
    words = text.split(" ")
    out = []
    for i, word in enumerate(words):
        if word in weights or any(word[:n] + "*" in weights for n in range(TERM_MIN, min(PREFIX_MAX, len(word)) + 1)):
            out += [" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1]
    return out


def toxicity(docs: DataFrame, lexicon: Lexicon, keep_columns: str | None = None) -> DataFrame:
    """doc_id, score and predicted of every row of docs. With keep_columns: docs with the score under that new name.

    Whole texts are scored, each by itself: rows that repeat a doc_id, or have none, get a row each with the score of their own
    text, and equal texts get equal scores. Null and empty texts have no match and get the score of a clean text. An empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    picked = docs if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = picked.columns.index("text")
    out = picked.withColumn(keep_columns or "_score", F.lit(0.0))
    schema = out.schema if keep_columns else "doc_id long, _score double"
    names = out.columns if keep_columns else ["doc_id", "_score"]

    def run(batches):
        lex = held.value
        w = lex.matcher()
        for batch in batches:
            scores = pa.array([lex.score(*w(fold(t or ""))) for t in batch.column(at).to_pylist()], pa.float64())
            kept = batch.columns if keep_columns else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*kept, scores], names=names)

    scored = picked.mapInArrow(run, schema)
    if keep_columns:
        return scored
    return scored.select("doc_id", F.col("_score").alias("score"), F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with a score under the threshold. All columns stay, whatever their names."""
    score = free_name(docs, "_score")
    return toxicity(docs, lexicon, score).where(F.col(score) < THRESHOLD).drop(score)
