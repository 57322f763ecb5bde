"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Only the lengths of the pieces matter to the packing, so a chromosome is a multiset of bins: patterns
of lengths, each with a multiplicity. Its size is bounded by the number of distinct lengths, not by the
corpus; the patterns are handed to pieces afterwards by the rank of each piece among those of its length.
"""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, payloads, spans

CAPACITY = 2048
#: Islands, migrations between them, generations between two migrations, and chromosomes of an island.
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 6, 4, 3, 6
#: Entries that the memory of one worker's word cache is held to.
CACHE_ENTRIES = 400_000


# ---- tokens -----------------------------------------------------------------------------------


class ByteBPE:
    """Ids of a byte-level BPE file of the tokenizers library, as its encode() gives them.

    Text whose white space is single spaces and newlines is parted at its spaces: the file's
    pre-tokenizer never joins what a space parts, so each part can be encoded once and remembered.
    Any other text is encoded whole. Parts are encoded by tiktoken with the same vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        import tiktoken

        # the public pattern of byte-level pre-tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.part = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first: dict[str, bytes] = {}
        encode = self.part.encode_ordinary

        class Cache(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                got = self[chunk] = np.array(encode(" " + chunk), "<u4").tobytes()
                return got

        self.cache = Cache()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        parts = text.split(" ")
        if any(s in text for s in self.special) or self._uneven(text, parts):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head = np.array(self.part.encode_ordinary(parts[0]), "<u4").tobytes()
        return head + b"".join(map(self.cache.__getitem__, parts[1:]))

    @staticmethod
    def _uneven(text: str, parts: list[str]) -> bool:
        """Whether white space is anything but single spaces and newlines between other characters."""
        words = text.split()
        return len(" ".join(words)) != len(text) or len(words) != len(parts) + text.count("\n")


_encoders: dict[str, ByteBPE] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _task, _nth): the pieces of every document.

    A document is the ids of its text and then id 0; null text is empty. Only a document longer
    than capacity is cut, and only its first piece may be shorter. _nth counts a task's pieces of a length.
    """

    def run(batches):
        bpe = _encoders.get(tokenizer)
        if bpe is None:
            bpe = _encoders[tokenizer] = ByteBPE(tokenizer)
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(bpe.ids(text or "") + b"\0\0\0\0")
                n, at = len(ids) // 4, 0
                for i in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if i == 0 else capacity
                    rows.append((doc, i, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), task, seen[size]))
                    seen[size] += 1
                    at += size
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long")


# ---- grouping genetic algorithm -----------------------------------------------------------------

Bins = dict[tuple[int, ...], int]


def _slack(bin_: tuple[int, ...], capacity: int) -> int:
    return capacity - sum(bin_)


class _Open:
    """Bins by their free space, found by best fit."""

    def __init__(self, bins: Bins, capacity: int):
        self.capacity, self.by_slack = capacity, [None] * (capacity + 1)
        self.closed: Bins = {}
        self.some = 0  # bit s is set if a bin with s free exists
        for b, m in bins.items():
            self.add(b, m)

    def add(self, b: tuple[int, ...], m: int) -> None:
        s = _slack(b, self.capacity)
        if s == 0:
            self.closed[b] = self.closed.get(b, 0) + m
            return
        if self.by_slack[s] is None:
            self.by_slack[s] = {}
        self.by_slack[s][b] = self.by_slack[s].get(b, 0) + m
        self.some |= 1 << s

    def best(self, length: int) -> tuple[tuple[int, ...], int] | None:
        """Takes out the fullest bins that still hold length."""
        over = self.some >> length
        if not over:
            return None
        s = length + (over & -over).bit_length() - 1
        b, m = self.by_slack[s].popitem()
        if not self.by_slack[s]:
            self.some &= ~(1 << s)
        return b, m

    def bins(self) -> Bins:
        out = dict(self.closed)
        for held in self.by_slack:
            for b, m in (held or {}).items():
                out[b] = out.get(b, 0) + m
        return out


def best_fit(open_bins: _Open, lengths: list[tuple[int, int]], capacity: int) -> None:
    """Put counts of lengths, in the given order, into the fullest bins that hold them, else into new ones."""
    for length, count in lengths:
        while count:
            found = open_bins.best(length)
            if found is None:
                k = capacity // length
                if count >= k:
                    open_bins.add((length,) * k, count // k)
                    count %= k
                if count:
                    open_bins.add((length,) * count, 1)
                break
            b, m = found
            k = min(_slack(b, capacity) // length, -(-count // m))  # of each of the bins, or of as many as are needed
            take = min(m, count // k) if k else 0
            if not take:
                k, take = count, 1
            if m > take:
                open_bins.add(b, m - take)
            open_bins.add((*b, *(length,) * k), take)
            count -= k * take


def fill_down(demand: dict[int, int], capacity: int) -> Bins:
    """Fill one bin after another with the largest lengths that still fit, repeating each bin while lengths last."""
    left = dict(demand)
    have = 0
    for n in left:
        have |= 1 << n
    out: Bins = {}
    while have:
        room, b = capacity, []
        used: Counter[int] = Counter()
        while room:
            fits = have & ((1 << (room + 1)) - 1)
            while fits:
                n = fits.bit_length() - 1
                if left[n] > used[n]:
                    break
                fits &= ~(1 << n)
            if not fits:
                break
            k = min(left[n] - used[n], room // n)
            b += [n] * k
            used[n] += k
            room -= k * n
        m = min(left[n] // k for n, k in used.items())
        out[tuple(b)] = out.get(tuple(b), 0) + m
        for n, k in used.items():
            left[n] -= k * m
            if not left[n]:
                have &= ~(1 << n)
    return out


def n_bins(bins: Bins) -> int:
    return sum(bins.values())


def fitness(bins: Bins, capacity: int) -> float:
    """Falkenauer's mean of squared fill: fewer and fuller bins score higher."""
    return sum(m * (sum(b) / capacity) ** 2 for b, m in bins.items()) / max(1, n_bins(bins))


def _random_bins(demand: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """Best fit over lengths in an order that falls with the length, disturbed by 5 to 50 percent."""
    noise = rng.uniform(0.05, 0.5)
    order = sorted(demand.items(), key=lambda x: -x[0] * (1 + noise * rng.random()))
    opened = _Open({}, capacity)
    best_fit(opened, order, capacity)
    return opened.bins()


def crossover(mother: Bins, father: Bins, demand: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of the father into the mother.

    Bins of the mother that would then hold a piece twice are dissolved, and the
    pieces they displace are put back by best fit.
    """
    full = sorted(father.items(), key=lambda x: (_slack(x[0], capacity), x[0]))
    share = rng.randint(1, max(1, n_bins(father) // 2))
    child: Bins = {}
    left = dict(demand)

    def take(b: tuple[int, ...], m: int) -> int:
        need = Counter(b)
        m = min(m, *(left[n] // k for n, k in need.items()))
        if m > 0:
            child[b] = child.get(b, 0) + m
            for n, k in need.items():
                left[n] -= k * m
        return max(m, 0)

    for b, m in full:
        if share <= 0:
            break
        share -= take(b, min(m, share))
    for b, m in sorted(mother.items(), key=lambda x: (_slack(x[0], capacity), x[0])):
        take(b, m)
    return _refit(child, left, capacity, rng)


def _refit(bins: Bins, left: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    opened = _Open(bins, capacity)
    best_fit(opened, sorted(((n, c) for n, c in left.items() if c), reverse=True), capacity)
    return opened.bins()


def _fullest(first: int, others: list[int], capacity: int) -> list[int]:
    """Which of the others fill a bin best that holds first: a subset sum over bits, bit s for a reachable sum s."""
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for n in others:
        reach.append((reach[-1] | reach[-1] << n) & mask)
    at, taken = reach[-1].bit_length() - 1, []
    for i in range(len(others) - 1, -1, -1):
        if not reach[i] >> at & 1:
            taken.append(i)
            at -= others[i]
    return taken


def mutate(bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Dissolve small sets of bins, the emptiest among them, and regroup their pieces into bins as full as can be.

    A regrouping stays if it takes fewer bins, or as many with no lower sum of squared fills; it is
    done as often as all of these bins are there.
    """
    bins = dict(bins)
    emptiest = sorted((b for b in bins if _slack(b, capacity)), key=sum)
    for _ in range(25 + len(bins) // 40):
        emptiest = [b for b in emptiest if b in bins]
        if not emptiest:
            break
        gone: Counter[tuple[int, ...]] = Counter()
        for b in emptiest[: rng.randint(1, 2)] + rng.sample(emptiest, min(len(emptiest), rng.randint(2, 10))):
            if gone[b] < bins[b]:
                gone[b] += 1
        pieces = sorted((n for b, m in gone.items() for n in b * m), reverse=True)
        made = []
        while pieces:
            first, others = pieces[0], pieces[1:]
            rng.shuffle(others)
            taken = set(_fullest(first, others, capacity))
            made.append(tuple(sorted([first, *(others[i] for i in taken)], reverse=True)))
            pieces = sorted((n for i, n in enumerate(others) if i not in taken), reverse=True)
        before = sum(gone.values())
        if len(made) < before or (len(made) == before and sum(sum(b) ** 2 for b in made) >= sum(m * sum(b) ** 2 for b, m in gone.items())):
            times = min(bins[b] // m for b, m in gone.items())
            for b, m in gone.items():
                bins[b] -= m * times
                if not bins[b]:
                    del bins[b]
            for b in made:
                bins[b] = bins.get(b, 0) + times
            emptiest = sorted({*emptiest, *(b for b in made if _slack(b, capacity))}, key=sum)
    return bins


def evolve(demand: dict[int, int], capacity: int, seed: int, elites: list[Bins], generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Bins, int]:
    """One island between two migrations: the best chromosome that it knows at the end, and the generations that it took."""
    rng = random.Random(seed)
    bound = -(-sum(n * c for n, c in demand.items()) // capacity)
    key = lambda x: (n_bins(x), -fitness(x, capacity))
    alive = list(elites)
    while len(alive) < population:
        alive.append(_random_bins(demand, capacity, rng))
    alive.sort(key=key)
    for turn in range(generations):
        if n_bins(alive[0]) <= bound:
            return alive[0], turn
        half = alive[: max(2, population // 2)]
        young = [mutate(crossover(*rng.sample(half, 2), demand, capacity, rng), capacity, rng) for _ in range(population - len(half) // 2)]
        young.append(mutate(half[0], capacity, rng))
        alive = sorted([*half, *young], key=key)[:population]
    return alive[0], generations


def pack_lengths(spark, demand: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, rounds: int = ROUNDS, told: list[dict] | None = None) -> Bins:
    """Bins for counts of lengths. Islands evolve as Spark tasks; after each round every island sends
    its elite to the next one. Ends when the number of bins meets the lower bound, or after the rounds.

    The islands begin with random best-fit chromosomes. Where a round brings no better one, a greedy filling
    immigrates to every island; a round without gain after that is the last.
    told: a list that gets, for each round, the generations and the bins of every island.
    """
    demand = {int(n): int(c) for n, c in demand.items() if c}
    if not demand:
        return {}
    bound = -(-sum(n * c for n, c in demand.items()) // capacity)
    known: list[list[Bins]] = [[] for _ in range(islands)]
    best: Bins | None = None
    newcomer: list[Bins] = []
    for turn in range(rounds):
        rows = [(i, json.dumps([[[list(b), m] for b, m in e.items()] for e in known[i]])) for i in range(islands)]

        def island(frames, turn=turn):
            for frame in frames:
                for i, text in zip(frame.island, frame.elites, strict=True):
                    elites = [{tuple(b): m for b, m in e} for e in json.loads(text)]
                    out, took = evolve(demand, capacity, 1000 * turn + int(i), elites)
                    yield pd.DataFrame({"island": [i], "generations": [took], "bins": [json.dumps([[list(b), m] for b, m in sorted(out.items())])]})

        start = spark.createDataFrame(rows, "island int, elites string").repartition(islands, "island")
        back = start.mapInPandas(island, "island int, generations int, bins string").collect()
        got = {r.island: {tuple(b): m for b, m in json.loads(r.bins)} for r in back}
        if told is not None:
            told.append({r.island: (r.generations, n_bins(got[r.island])) for r in back})
        before = n_bins(best) if best else None
        best = min([*got.values(), *([best] if best else [])], key=lambda x: (n_bins(x), -fitness(x, capacity)))
        stalled = before is not None and n_bins(best) >= before
        if n_bins(best) <= bound or (stalled and newcomer):
            break
        newcomer = [fill_down(demand, capacity)] if stalled or turn == rounds - 2 else []
        known = [[got[i], got[(i - 1) % islands], *newcomer] for i in range(islands)]
    return best


def _slots(bins: Bins) -> tuple[np.ndarray, ...]:
    """For each length its places, in order of a running rank: (length, rank, first sequence, offset) of each run."""
    rank: Counter[int] = Counter()
    sequence, rows = 0, []
    for b, m in sorted(bins.items(), reverse=True):
        offset = 0
        for n in b:
            rows.append((n, rank[n], sequence, offset))
            rank[n] += m
            offset += n
        sequence += m
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of docs and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The GA sees the counts of the lengths, which are at most capacity numbers. A piece's rank
    among those of its length is its count within its task plus the counts of the tasks before
    it, so no length is gathered in one task. Null texts and empty texts are one token;
    repeated rows and null ids are packed like others. An empty table packs to nothing.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer, capacity), "pieces")
    per_task = made.groupBy("_task", "length").agg(F.count("*").alias("n"))
    demand = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    held = spark.sparkContext.broadcast(_slots(pack_lengths(spark, demand, capacity)))
    before = per_task.select("_task", "length", F.expr("sum(n) over (partition by length order by _task) - n").alias("_before"))
    ranked = made.join(before, ["_task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("_before + _nth").alias("_rank"))

    def place(batches):
        length, rank, sequence, offset = held.value
        key = length * (1 << 40) + rank
        for batch in batches:
            n, r = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, n * (1 << 40) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
