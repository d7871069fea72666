"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard of a label.

Every vector queries every shard of its label. A shard's beam widens until a recall audit against brute force passes,
and the beam of a query that is full of links takes in the whole shard, so no beam cuts links off. Candidates that
single precision cannot settle are verified in double precision. Links are counted, not listed: a shard gives one
edge for each component that a query newly joins, and components are the union of what all shards found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .components import connected_components

THRESHOLD = 0.98
#: Vectors in a graph, and queries that one task puts to it, at most.
SHARD_ROWS = 32768
QUERY_ROWS = 262144
LINKS = 12
BUILD_BEAM = 48
SEARCH_BEAM = 48
#: Recall of links in the audited queries that ends widening; audited queries of a batch.
RECALL = 0.99
AUDITED = 96
BATCH = 512
#: Similarities that are in memory at once.
CELLS = 1 << 22


def slack(dim: int) -> float:
    """By so much a dot product of unit vectors in single precision may be off: rounding of both vectors and of each sum."""
    return (2 * dim + 8) * 2.0**-24


class SmallWorld:
    """A graph over unit vectors; searches run for a batch of queries at once. Levels are drawn from a hash of the ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.x, self.links, self.beam = np.ascontiguousarray(x, np.float32), links, beam
        n = len(x)
        self._seen = np.zeros(max(BATCH * n, CELLS), np.uint8)
        self._turn = 0
        u = np.array([(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 5) + 1) / 2.0**64 for i in ids])
        level = np.floor(-np.log(u) / np.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")  # high levels first: every node finds its upper layers built
        rest = order[level[order] == 0]
        self.order = np.concatenate((order[level[order] > 0], rest[np.argsort(u[rest])]))
        self.level = level
        self.layers = [np.full((n, links * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max()) + 1)]
        self.entry = int(self.order[0])
        done = 1
        while done < n:
            batch = self.order[done : done + max(16, min(BATCH, done // 2))]
            self._insert(batch, done)
            done += len(batch)

    def _select(self, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Half of the width to the nearest, the rest to neighbours in other directions, filled up by nearness."""
        order = np.argsort(-sims, kind="stable")
        cand, sims = cand[order], sims[order]
        if len(cand) <= width:
            return cand
        take = list(range(width // 2))
        v = self.x[cand[: 4 * width]]
        between = v @ v.T
        for k in range(width // 2, len(v)):
            if len(take) == width:
                break
            if sims[k] > between[k, take].max():
                take.append(k)
        if len(take) < width:
            have = set(take)
            take += [k for k in range(len(cand)) if k not in have][: width - len(take)]
        return cand[take]

    def _insert(self, batch: np.ndarray, done: int) -> None:
        q = self.x[batch]
        own = q @ q.T
        entry = np.full((len(batch), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            on = np.flatnonzero(self.level[batch] >= k)
            off = np.flatnonzero(self.level[batch] < k)
            if len(off):
                entry[off, 0] = self._beam(k, q[off], entry[off], 1)[0][:, 0]
            if not len(on):
                continue
            found, sims = self._beam(k, q[on], entry[on], self.beam)
            entry[on, 0] = np.where(found[:, 0] >= 0, found[:, 0], entry[on, 0])
            nb, width = self.layers[k], self.layers[k].shape[1]
            back: dict[int, list[int]] = {}
            for r, i in enumerate(on.tolist()):
                ok = found[r] >= 0
                mates = on[on != i]
                near = mates[np.argsort(-own[i, mates], kind="stable")[:width]]
                cand = np.concatenate((found[r][ok], batch[near]))
                picked = self._select(cand, np.concatenate((sims[r][ok], own[i, near])), width // 2)
                me = int(batch[i])
                nb[me, : len(picked)] = picked
                for v in picked.tolist():
                    back.setdefault(v, []).append(me)
            for v, more in back.items():
                row = nb[v]
                have = row[row >= 0]
                cand = np.unique(np.concatenate((have, np.array(more, np.int32))))
                if len(cand) > width:
                    cand = self._select(cand, self.x[cand] @ self.x[v], width)
                nb[v] = -1
                nb[v, : len(cand)] = cand

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims), each row sorted from the nearest; -1 where the beam is not filled."""
        b, nb = len(q), self.layers[layer]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        self._turn += 1  # marks of earlier turns do not count, so the marks are cleared once in 255 turns
        if self._turn == 256:
            self._seen[:] = 0
            self._turn = 1
        turn = self._turn
        seen = self._seen[: b * len(self.x)].reshape(b, len(self.x))
        k = min(entry.shape[1], beam)
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.einsum("bkd,bd->bk", self.x[entry[:, :k]], q)
        open_[:, :k] = True
        np.put_along_axis(seen, entry, turn, axis=1)
        act = np.arange(b)
        while len(act):
            best = np.where(open_[act], sims[act], -np.inf)
            at = best.argmax(axis=1)
            alive = best[np.arange(len(act)), at] > -np.inf
            act, at = act[alive], at[alive]
            if not len(act):
                break
            open_[act, at] = False
            new = nb[ids[act, at]].astype(np.int64)
            fresh = (new >= 0) & (seen[act[:, None], np.maximum(new, 0)] != turn)
            rows, cols = np.nonzero(fresh)
            targets = new[rows, cols]
            seen[act[rows], targets] = turn
            s = np.full(new.shape, -np.inf, np.float32)
            s[rows, cols] = np.einsum("nd,nd->n", self.x[targets], q[act[rows]])
            alls = np.concatenate((sims[act], s), axis=1)
            top = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
            ids[act] = np.take_along_axis(np.concatenate((ids[act], np.where(fresh, new, -1)), axis=1), top, axis=1)
            sims[act] = np.take_along_axis(alls, top, axis=1)
            open_[act] = np.take_along_axis(np.concatenate((open_[act], fresh), axis=1), top, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(k, q, entry, 1)[0][:, :1]
        return self._beam(0, q, entry, min(beam, len(self.x)))

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
        """(rows of q, nodes, similarities) that hold all nodes found with at least `least`; nodes None: one column a node of the shard.

        A query whose beam holds nothing else widens it to the whole shard, one product that costs less than a wider search.
        """
        step = max(1, min(CELLS // len(self.x), BATCH * 64 // beam))
        full = []
        for a in range(0, len(q), step):
            part = np.arange(a, min(a + step, len(q)))
            if beam < len(self.x):
                ids, sims = self.search(q[part], beam)
                more = (sims >= least).all(axis=1)
                yield part[~more], ids[~more], sims[~more]
                part = part[more]
            full.append(part)
        rest = np.concatenate(full) if full else np.arange(0)
        step = max(1, min(CELLS // len(self.x), BATCH))
        for a in range(0, len(rest), step):
            yield rest[a : a + step], None, q[rest[a : a + step]] @ self.x.T


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square leaves the range of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Shard:
    """An indexed shard that answers batches of queries with the number of verified links and the edges that join components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, weight: np.ndarray, threshold: float = THRESHOLD):
        self.ids, self.weight, self.threshold = ids, weight, threshold
        self.unit = _unit(x)
        self.graph = SmallWorld(self.unit, ids)
        self.beam = SEARCH_BEAM
        self.heavy = np.flatnonzero(weight > 1)
        self.by_id = np.argsort(ids)
        self.label = np.arange(len(ids))  # the component of each node, as far as edges were given
        self.audits: list[tuple[int, int, int]] = []

    def _own(self, ids: np.ndarray) -> np.ndarray:
        """The queries' own nodes, -1 where they lie in other shards."""
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)
        return np.where(self.ids[self.by_id[at]] == ids, self.by_id[at], -1)

    def _join(self, query: int, own: int, near: np.ndarray, edges: list[tuple[int, int]]) -> None:
        """An edge from the query to each component among its links that it is not in yet."""
        labels = self.label[near]
        home = self.label[own] if own >= 0 else labels[0]
        if own >= 0 and (labels == home).all():
            return
        if own < 0:
            edges.append((query, int(self.ids[near[0]])))
        others, first = np.unique(labels, return_index=True)
        for c, k in zip(others.tolist(), first.tolist(), strict=True):
            if c != home:
                edges.append((query, int(self.ids[near[k]])))
                self.label[self.label == c] = home

    def _found(self, ids: np.ndarray, q: np.ndarray, edges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """For each query its links, by weight and by number."""
        weights, numbers = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        own, off = self._own(ids), slack(q.shape[1])
        for rows, nodes, sims in self.graph.within(q.astype(np.float32), self.threshold - off, self.beam):
            hit = sims >= self.threshold + off
            doubt = (sims >= self.threshold - off) & ~hit
            if nodes is None:
                at = np.flatnonzero(own[rows] >= 0)
                hit[at, own[rows[at]]] = doubt[at, own[rows[at]]] = False
            else:
                other = (nodes >= 0) & (nodes != own[rows][:, None])
                hit &= other
                doubt &= other
            r, c = np.nonzero(doubt)
            for k in range(0, len(r), 65536):
                i, j = r[k : k + 65536], c[k : k + 65536]
                hit[i, j] = np.einsum("nd,nd->n", self.unit[j if nodes is None else nodes[i, j]], q[rows[i]]) >= self.threshold
            numbers[rows] = np.count_nonzero(hit, axis=1)
            if nodes is None:
                weights[rows] = numbers[rows] + hit[:, self.heavy] @ (self.weight[self.heavy] - 1)
            else:
                weights[rows] = np.where(hit, self.weight[nodes], 0).sum(axis=1)
            for k in np.flatnonzero(numbers[rows]).tolist():
                near = np.flatnonzero(hit[k])
                self._join(int(ids[rows[k]]), int(own[rows[k]]), near if nodes is None else nodes[k, near], edges)
        return weights, numbers

    def answer(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The weight of each query's links, itself excepted, and edges between linked rows that connect all that are linked.

        Widens the shard's beam until the audit passes: queries with and without links, against brute force.
        """
        q = _unit(x)
        own = self._own(ids)
        edges: list[tuple[int, int]] = []
        while True:
            weights, numbers = self._found(ids, q, edges)
            linked = np.flatnonzero(numbers)
            audited = {*range(0, len(ids), max(1, len(ids) // (AUDITED // 2))), *linked[:: max(1, len(linked) // (AUDITED // 2))].tolist()}
            real = sum(int(np.count_nonzero(self.unit @ q[k] >= self.threshold)) - int(own[k] >= 0) for k in audited)
            hits = int(numbers[list(audited)].sum())
            done = hits >= RECALL * real or self.beam >= len(self.ids)
            if done:
                self.audits.append((self.beam, hits, real))
                return weights, edges
            self.beam *= 2


def _tasks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come by (group, role): first a group's index rows, then its queries, which stream through in batches.

    Out come (a, null, n): links of a vector; (a, b): an edge; (null, group, n, real): hits of audited queries and their real links.
    """
    shard: Shard | None = None
    key = None
    index: list[tuple] = []
    queries: list[tuple] = []

    def answer() -> list[tuple]:
        nonlocal shard
        if not queries:
            return []
        if shard is None:
            shard = Shard(*[np.concatenate(c) for c in zip(*index, strict=True)], threshold) if index else None
            index.clear()
        ids, x, _ = [np.concatenate(c) for c in zip(*queries, strict=True)]
        queries.clear()
        if shard is None:
            return []
        weights, edges = shard.answer(ids, x)
        some = np.flatnonzero(weights)
        rows = [(i, None, n, None) for i, n in zip(ids[some].tolist(), weights[some].tolist(), strict=True)]
        return rows + [(a, b, None, None) for a, b in edges] + [(None, key[0], *shard.audits[-1][1:])]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a", "b", "n", "real"])

    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        ids = batch.column(4).to_numpy(zero_copy_only=False)
        weight = batch.column(5).to_numpy(zero_copy_only=False)
        values = batch.column(6)
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
            now, role = tuple(group[s, :3].tolist()), group[s, 3]
            if now != key:
                rows = answer()
                if rows:
                    yield emit(rows)
                key, shard, waiting = now, None, 0
                index.clear()
            part = values.slice(s, e - s)
            x = part.flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
            (queries if role else index).append((ids[s:e], x, weight[s:e]))
            if role:
                waiting += e - s
                if waiting >= 8 * BATCH:
                    rows, waiting = answer(), 0
                    if rows:
                        yield emit(rows)
    rows = answer()
    if rows:
        yield emit(rows)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept, recall).

    Vectors link within one label and length. Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing. Equal vectors of a label are collapsed first and weigh as many as they
    are. Rows with a null id have no component and are not kept. recall: share of the real links of audited queries
    that the label's graphs found; null for vectors that link with nothing. Other columns are ignored.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    good = v.where(fine)
    distinct = materialise(good.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")).withColumn("dim", F.size("e").cast("long")), "vectors")
    counts = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.select("label", "dim", F.ceil(F.col("n") / shard_rows).alias("s"), F.ceil(F.col("n") / query_rows).alias("q"), F.monotonically_increasing_id().alias("g")), "shards")
    groups = counts.agg(F.sum(F.col("s") * F.col("q"))).first()[0] or 1
    rows = distinct.join(counts, ["label", "dim"])
    index = rows.select("g", F.pmod(F.xxhash64("rep"), F.col("s")).alias("shard"), F.explode(F.expr("sequence(0L, q - 1)")).alias("block"), F.lit(0).cast("long").alias("role"), "rep", "m", "e")
    asked = rows.select("g", F.explode(F.expr("sequence(0L, s - 1)")).alias("shard"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("q")).alias("block"), F.lit(1).cast("long").alias("role"), "rep", "m", "e")
    dealt = index.union(asked).repartition(int(min(max(2 * groups, 8), 20000)), "g", "shard", "block").sortWithinPartitions("g", "shard", "block", "role", "rep")
    found = materialise(dealt.mapInArrow(lambda it: _tasks(it, threshold), "a long, b long, n long, real long"), "found")
    comp = connected_components(found.where("a is not null and b is not null").select("a", "b"))
    n = found.where("b is null").groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_n"))
    audits = found.where("a is null").groupBy(F.col("b").alias("_g")).agg((F.sum("n") / F.nullif(F.sum("real"), F.lit(0))).alias("recall"))
    audits = counts.join(audits, F.col("g") == F.col("_g"), "left").select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.coalesce("recall", F.lit(1.0)).alias("recall"))
    named = distinct.join(n, F.col("rep") == F.col("_rep"), "left").join(comp, F.col("rep") == F.col("node"), "left").join(materialise(audits, "audits"), (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")))
    named = named.select(F.col("label").alias("_label"), F.col("e").alias("_e"), (F.coalesce("_n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "recall")
    named = materialise(named, "named")
    out = v.withColumn("_fine", fine)
    linked = out.where("_fine").join(named, (F.col("label") == F.col("_label")) & (F.col("e") == F.col("_e"))).select("vec_id", "n_links", "component_id", "recall")
    rest = out.where("not coalesce(_fine, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    return linked.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "recall")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
