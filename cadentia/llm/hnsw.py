"""Embedding near-duplicates by a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, own_ids

#: Links of a node above and on the ground layer, beams while building and at first while searching.
M, M0, EF_BUILD, EF = 12, 24, 48, 48
#: Vectors of a shard, queries searched at once, audited queries, and the recall that an audit asks for.
SHARD_VECTORS, AT_ONCE, AUDIT, RECALL = 8192, 512, 64, 0.99


class Graph:
    """An HNSW graph over unit vectors. Insertion and search work on batches of points."""

    def __init__(self, unit: np.ndarray, links: list[np.ndarray] | None = None, members: list[np.ndarray] | None = None):
        self.x = unit
        self.links, self.members = links or [], members or []
        if links is None:
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        rng = np.random.default_rng(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(M)).astype(int), 6)
        for lv in range(int(level.max(initial=0)) + 1):
            ids = np.flatnonzero(level >= lv) if lv else np.arange(n)
            self.members.append(ids.astype(np.int32))
            self.links.append(np.full((len(ids), M0 if lv == 0 else M), -1, np.int32))
        for lv in range(len(self.members) - 1, -1, -1):
            self._build_layer(lv)

    def _build_layer(self, lv: int) -> None:
        """Insert the layer's points in batches; each finds its neighbours in the graph so far and in its batch."""
        ids, links = self.members[lv], self.links[lv]
        x, width = self.x[ids], links.shape[1]
        done = 0
        while done < len(ids):
            size = min(max(128, done // 2), 1024, len(ids) - done)
            new = np.arange(done, done + size)
            near = x[new] @ x[new].T
            np.fill_diagonal(near, -2)
            k = min(width, size - 1)
            pick = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.empty((size, 0), int)
            cand, sim = new[pick], np.take_along_axis(near, pick, 1)
            if done:
                entry = self._descend(x[new], lv) if lv + 1 < len(self.members) else np.zeros(size, int)
                entry = np.where(entry < done, entry, entry % done)
                old, s = _beam(x, links, x[new], entry, EF_BUILD)
                cand, sim = np.concatenate([cand, np.maximum(old, 0)], 1), np.concatenate([sim, np.where(old >= 0, s, -2)], 1)
            self._connect(links, x, new, cand, sim)
            done += size

    @staticmethod
    def _connect(links: np.ndarray, x: np.ndarray, new: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Link new points to their best candidates, both ways; full nodes keep their best links."""
        width = links.shape[1]
        order = np.argsort(-sim, axis=1)[:, :width]
        best, s = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        links[new, : best.shape[1]] = np.where(s > -2, best, -1)
        at, to = np.nonzero(s > -2)
        a, b = best[at, to], new[at]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        nodes, first, count = np.unique(a, return_index=True, return_counts=True)
        for node, f, c in zip(nodes.tolist(), first.tolist(), count.tolist(), strict=True):
            have = links[node]
            have = have[have >= 0]
            both = np.union1d(have, b[f : f + c])
            both = both[both != node]
            if len(both) > width:
                d = x[both] @ x[node]
                half = width // 2  # the nearest, and of the others an even spread, so that tight clumps stay reachable
                o = np.argsort(-d)
                rest = o[half:]
                both = both[np.concatenate([o[:half], rest[np.linspace(0, len(rest) - 1, width - half).astype(int)]])]
            links[node] = -1
            links[node, : len(both)] = both

    def _descend(self, q: np.ndarray, lv: int) -> np.ndarray:
        """Entry points of the layer lv: greedy walks from the top layer, as positions in that layer."""
        at = np.zeros(len(q), int)
        for up in range(len(self.members) - 1, lv, -1):
            ids, links = self.members[up], self.links[up]
            x = self.x[ids]
            best = np.einsum("ij,ij->i", x[at], q)
            while True:
                n = links[at]
                s = np.where(n >= 0, np.einsum("ikj,ij->ik", x[np.maximum(n, 0)], q), -2)
                j = s.argmax(axis=1)
                top = s[np.arange(len(q)), j]
                better = top > best + 1e-7
                if not better.any():
                    break
                at = np.where(better, n[np.arange(len(q)), j], at)
                best = np.maximum(best, top)
            below = self.members[up - 1]
            at = np.searchsorted(below, ids[at])
        return at

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of beams of ef for unit queries; -1 fills what a beam did not find."""
        out, sim = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -2, np.float32)
        for lo in range(0, len(q), AT_ONCE):
            part = q[lo : lo + AT_ONCE]
            ids, s = _beam(self.x, self.links[0], part, self._descend(part, 0), ef)
            out[lo : lo + AT_ONCE], sim[lo : lo + AT_ONCE] = ids, s
        return out, sim


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches in lockstep: each step expands a few of the best unexpanded nodes of every beam."""
    n, expand = len(q), 3
    ids = np.full((n, ef), -1, np.int32)
    sim = np.full((n, ef), -2, np.float32)
    opened = np.zeros((n, ef), bool)  # whether an entry was expanded
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], sim[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q)
    seen[np.arange(n), entry] = True
    active = np.arange(n)
    while len(active):
        waiting = np.where(opened[active] | (ids[active] < 0), -3, sim[active])
        k = min(expand, ef)
        pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
        live = np.take_along_axis(waiting, pick, 1) > -2.5
        some = live.any(axis=1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        opened[active[:, None], pick] |= live
        nodes = np.take_along_axis(ids[active], pick, 1)
        near = np.where(live[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[active[:, None], np.maximum(near, 0)]
        row, col = np.nonzero(fresh)
        to = near[row, col]
        seen[active[row], to] = True
        s = np.full(near.shape, -2, np.float32)
        s[row, col] = np.einsum("ij,ij->i", x[to], q[active[row]])
        all_s = np.concatenate([sim[active], s], 1)
        keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sim[active] = np.take_along_axis(all_s, keep, 1)
        ids[active] = np.where(sim[active] > -2, np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1), -1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], np.zeros(near.shape, bool)], 1), keep, 1)
    return ids, sim


def links_between(graph: Graph, exact: np.ndarray, q_exact: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs with cosine of at least threshold in double precision.

    Beams widen until two audits find their recall: sampled queries against brute force, and queries planted at a
    cosine little above the threshold from sampled points, which must lead back to these; so recall is measured also where
    no sampled query has a link. A query whose whole beam is linked is compared with the whole shard.
    """
    q = _unit(q_exact)
    slack = threshold - 1e-4
    n, ef = len(graph.x), min(EF, len(graph.x))
    sampled = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = q[sampled] @ graph.x.T >= slack
    origin = np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))
    planted = _planted(graph.x[origin], min(1.0, threshold + 0.01))
    while True:
        back, _ = graph.search(planted, ef)
        if ef < n and (back == origin[:, None]).any(axis=1).sum() < RECALL * _reachable(graph.x, planted, origin, ef):
            ef = min(2 * ef, n)
            continue
        ids, sim = graph.search(q, ef)
        found = np.zeros_like(truth)
        r, c = np.nonzero(sim[sampled] >= slack)
        found[r, ids[sampled][r, c]] = True
        open_ended = sim.min(axis=1) >= slack
        judged = ~open_ended[sampled]
        want = truth[judged].sum()
        if ef >= n or not want or found[judged].sum() >= RECALL * want:
            break
        ef = min(2 * ef, n)
    r, c = np.nonzero((sim >= slack) & ~open_ended[:, None])
    a, b = [r], [ids[r, c]]
    wide = np.flatnonzero(open_ended)
    for lo in range(0, len(wide), AT_ONCE):
        r, c = np.nonzero(q[wide[lo : lo + AT_ONCE]] @ graph.x.T >= slack)
        a.append(wide[lo : lo + AT_ONCE][r])
        b.append(c)
    a, b = np.concatenate(a), np.concatenate(b).astype(int)
    if same:  # a pair counts if either of its ends found it
        low, high = np.minimum(a, b), np.maximum(a, b)
        pair = np.unique((low * n + high)[low < high])
        a, b = pair // n, pair % n
    keep = np.zeros(len(a), bool)
    norm, q_norm = np.sqrt((exact**2).sum(axis=1)), np.sqrt((q_exact**2).sum(axis=1))
    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        keep[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", q_exact[i], exact[j]) / (q_norm[i] * norm[j]) >= threshold
    return a[keep], b[keep]


def _planted(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at that cosine from the unit vectors x, in random directions."""
    away = np.random.default_rng(len(x)).normal(size=x.shape)
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    size = np.sqrt((away**2).sum(axis=1, keepdims=True))
    flat = size[:, 0] < 1e-9  # one dimension has no other direction
    away = np.where(flat[:, None], 0, away / np.maximum(size, 1e-9))
    return (np.where(flat, 1, cosine)[:, None] * x + np.sqrt(max(0.0, 1 - cosine**2)) * away).astype(np.float32)


def _reachable(x: np.ndarray, planted: np.ndarray, origin: np.ndarray, ef: int) -> int:
    """How many planted queries have their origin among their ef nearest points, so that a perfect beam would hold it."""
    sim = planted @ x.T
    return int(((sim > sim[np.arange(len(origin)), origin][:, None]).sum(axis=1) < ef).sum())


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors over their largest component, so that squares neither overflow nor vanish; cosines stay."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label).

    Only rows of one non-null label are compared. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, as do vectors of different lengths with each other. Equal vectors of a label are one point whose copies link with
    each other. Each label is dealt into shards of about shard_vectors points by hash; each shard gets
    a graph, and each pair of shards of a label is searched by one task. Tasks return sums of
    links and edges to one point of each local component, never all pairs. Rows with a null vec_id
    link with nothing. Every row is a vector of its own: rows that repeat a vec_id have links of their own, and component_id
    is the smallest vec_id of the vectors reached. An empty table gives no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    v, plain = own_ids(v, "vec_id", "row", [F.xxhash64("label", "v")])
    good = "label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    v = v.withColumn("ok", F.expr(f"coalesce({good}, false)")).withColumn("v", F.expr("if(ok, transform(v, x -> x + 0.0D), null)"))
    points = v.where("ok and vec_id is not null").groupBy("label", "v").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    points = cut(points.withColumn("size", F.size("v")), "points")
    shards = points.groupBy("label", "size").agg(F.ceil(F.count("*") / shard_vectors).alias("shards"))
    dealt = points.join(shards, ["label", "size"]).withColumn("shard", F.expr("pmod(xxhash64(rep), shards)"))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        exact = _scaled(np.stack(rows.v.to_numpy()).astype(float))
        g = Graph(_unit(exact))
        layers = {f"links{i}": a for i, a in enumerate(g.links)} | {f"members{i}": a for i, a in enumerate(g.members)}
        blob = _packed(rep=rows.rep.to_numpy(), copies=rows.copies.to_numpy(), exact=exact, **layers)
        return pd.DataFrame({"label": [key[0]], "size": [key[1]], "shard": [key[2]], "graph": [blob]})

    kind = points.schema["label"].dataType.simpleString()
    graphs = cut(dealt.groupBy("label", "size", "shard").applyInPandas(build, f"label {kind}, size int, shard long, graph binary"), "graphs")
    a = graphs.select("label", "size", F.col("shard").alias("a"), F.col("graph").alias("ga"))
    b = graphs.select("label", "size", F.col("shard").alias("b"), F.col("graph").alias("gb"))

    def query(key, rows: pd.DataFrame) -> pd.DataFrame:
        from .simhash import _forest

        p = np.load(io.BytesIO(rows.ga.iloc[0]))
        same = key[2] == key[3]
        q = p if same else np.load(io.BytesIO(rows.gb.iloc[0]))
        layers = sum(k.startswith("links") for k in p.files)
        exact, q_exact = p["exact"], q["exact"]
        g = Graph(_unit(exact), [p[f"links{i}"] for i in range(layers)], [p[f"members{i}"] for i in range(layers)])
        i, j = links_between(g, exact, q_exact, threshold, same)
        rep, q_rep = p["rep"], q["rep"]
        n_q = np.bincount(i, weights=p["copies"][j], minlength=len(q_rep))
        n_p = np.bincount(j, weights=q["copies"][i], minlength=len(rep))
        if same:
            nodes, n = rep, n_q + n_p
            tree = _forest(len(rep), i, j)
        else:
            nodes, n = np.concatenate([q_rep, rep]), np.concatenate([n_q, n_p])
            tree = _forest(len(nodes), i, j + len(q_rep))
        full = np.flatnonzero((n > 0) | (tree != np.arange(len(nodes))))
        return pd.DataFrame({"rep": nodes[full], "n": n[full].astype(np.int64), "near": nodes[tree[full]]})

    pairs = a.join(b, ["label", "size"]).where("a <= b")
    found = cut(pairs.groupBy("label", "size", "a", "b").applyInPandas(query, "rep long, n long, near long"), "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("src"), F.col("near").alias("dst")), "embeddings")
    told = points.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = v.where("ok and vec_id is not null").join(told, ["label", "v"], "left").select("vec_id", "n_links", "component_id")
    if not plain:  # components are rows so far, in the order of their vec_ids
        names = v.where("ok and vec_id is not null").select(F.col("row").alias("component_id"), F.col("vec_id").alias("smallest"))
        linked = linked.join(names, "component_id").select("vec_id", "n_links", F.col("smallest").alias("component_id"))
    alone = v.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))
