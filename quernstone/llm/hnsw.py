"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class, and only classes are indexed. Shards stand in a ring: a class asks its
own shard and the half of the ring that follows, so that each pair of shards is searched once and a
link that is found counts for both of its ends. A graph whose lowest layer has nodes that no path
reaches gets links to them when it is built. A shard first audits itself: some of its own vectors,
and moved copies just above the threshold, are searched by graph and by brute force, and the beam
widens until the probes of every density find TARGET of their neighbours. A query with a quarter of
its beam above the threshold widens it to the whole shard. What a search returns is verified in double
precision. Before a search a bound tells whether the shard can hold a neighbour at all: by half of the
principal components and the lengths of the rest no cosine is greater than the bound says, so that a query
whose bounds all lie below the threshold has none there and isn't searched for.

A task doesn't list the pairs that it finds. It unites the linked vectors of its shard at once,
and passes on, for each query, how many it found and one of them, and for each vector of the shard
how many found it and the root that it was united with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .shards import matrix, pieces, put, shard_count, sound, to_own_shard

COSINE = 0.95
SHARD_ROWS = 50_000
#: Links of a node above the lowest layer; twice that on it.
LINKS, BUILD_BEAM, BEAM, EXPAND = 8, 32, 24, 3
#: The part of a beam, as a divisor, that may lie above the threshold before the beam is as wide as the shard.
CROWDED = 4
#: Nodes that each layer hands down to the next, and links a node may get to nodes that no path reaches.
ENTRIES, RESCUED = 6, 16
#: Probes of either kind of a shard's audit, and the mean part of its neighbours that a probe must find.
PROBES, TARGET = 256, 0.995
_SLACK = 1e-4


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Graph:
    """A small-world graph over unit vectors, built by inserting blocks of rows that at most double it."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.u = vectors
        self._f = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 6)
        order = rng.permutation(n)
        self._near = [np.full((n, LINKS * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(int(level.max(initial=0)) + 1)]
        self._entry = np.full(len(self._near), -1, np.int64)
        done = 0
        while done < n:
            block = order[done : done + min(512, max(done, 128))]
            self._insert(block, level[block])
            done += len(block)
        self._connect()
        # principal axes, and of each row its first components by them and the length of the rest
        self._axes = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1][:, : -(-vectors.shape[1] // 2)]
        self._short = np.ascontiguousarray(self._shortened(vectors).T)

    def _reach(self, front: np.ndarray, seen: np.ndarray) -> None:
        """Marks what paths on the lowest layer lead to from front."""
        while len(front):
            seen[front] = True
            to = self._near[0][front].ravel()
            to = np.unique(to[to >= 0])
            front = to[~seen[to]]

    def _connect(self) -> None:
        """Links to nodes that no path from the entry reaches, from a neighbour of theirs that one does."""
        n = len(self._f)
        seen, hosts, nodes = np.zeros(n, bool), [], []
        self._reach(self._entry[-1:], seen)
        while not seen.all():
            lost = np.flatnonzero(~seen)
            cand = self._near[0][lost]
            known = (cand >= 0) & seen[cand]
            if known.any():
                rows = lost[known.any(axis=1)]
                host = cand[known.any(axis=1), known[known.any(axis=1)].argmax(axis=1)]
            else:
                rows, pool = lost[:64], np.flatnonzero(seen)
                host = pool[(self._f[rows] @ self._f[pool].T).argmax(axis=1)]
            hosts.append(host)
            nodes.append(rows)
            self._reach(rows, seen)
        if not hosts:
            return
        host, node = np.concatenate(hosts).astype(np.int64), np.concatenate(nodes)
        order = np.argsort(host, kind="stable")
        host, node = host[order], node[order]
        begin = np.flatnonzero(np.append(True, host[1:] != host[:-1]))
        rank = np.arange(len(host)) - np.repeat(begin, np.diff(np.append(begin, len(host))))
        far = np.flatnonzero(rank >= RESCUED)
        host[far], rank[far] = node[far - RESCUED], 0  # a full host's nodes go on from one another
        extra = np.full((n, int(rank.max()) + 2), -1, np.int32)
        rank[far] = extra.shape[1] - 1
        extra[host, rank] = node
        self._near[0] = np.concatenate([self._near[0], extra], axis=1)

    def _insert(self, block: np.ndarray, level: np.ndarray) -> None:
        q = self._f[block]
        entry = None
        for layer in range(len(self._near) - 1, -1, -1):
            mine = level >= layer
            if self._entry[layer] >= 0:
                if entry is None:
                    entry = np.full((len(block), 1), self._entry[layer])
                found, _ = self._beam(q, entry, BUILD_BEAM if mine.any() else ENTRIES, layer)
                entry = found[:, :ENTRIES]
            else:
                found = np.full((len(block), 0), -1)
            if mine.any():
                rows, at = block[mine], np.flatnonzero(mine)
                close = q[at] @ q[at].T
                np.fill_diagonal(close, -2)
                k = min(LINKS, len(rows) - 1)
                peers = rows[np.argpartition(-close, k - 1, axis=1)[:, :k]] if k > 0 else np.full((len(rows), 0), -1)
                cand = np.concatenate([found[at], peers], axis=1)
                near = self._near[layer]
                near[rows] = self._pick(rows, cand, near.shape[1])
                self._answer(rows, layer)
                if self._entry[layer] < 0:
                    self._entry[layer] = rows[0]

    def _answer(self, rows: np.ndarray, layer: int) -> None:
        """Links back to new rows, pruned where a node has no room."""
        near = self._near[layer]
        to = near[rows].ravel()
        own = np.repeat(rows, near.shape[1])[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, own = to[order], own[order]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 1024):
            part, b, c = nodes[lo : lo + 1024], begin[lo : lo + 1024], np.minimum(count[lo : lo + 1024], 2 * near.shape[1])
            extra = np.full((len(part), int(c.max())), -1, np.int64)
            for i in range(extra.shape[1]):
                has = c > i
                extra[has, i] = own[b[has] + i]
            near[part] = self._pick(part, np.concatenate([near[part], extra], axis=1), near.shape[1])

    def _pick(self, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that lie nearer to the node than to each other, filled up with the nearest of the rest."""
        out = np.full((len(nodes), most), -1, np.int32)
        for lo in range(0, len(nodes), 512):
            own, c = nodes[lo : lo + 512], np.sort(cand[lo : lo + 512].astype(np.int64), axis=1)
            bad = (c < 0) | (c == own[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            v = self._f[c]
            s = np.einsum("acd,ad->ac", v, self._f[own])
            s[bad] = -9
            order = np.argsort(-s, axis=1)[:, : 4 * most]
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            v = np.take_along_axis(v, order[:, :, None], 1)
            pair = v @ v.transpose(0, 2, 1)
            kept = np.zeros(s.shape, bool)
            for i in range(s.shape[1]):
                kept[:, i] = (s[:, i] > -9) & ~(kept & (pair[:, i, :] >= s[:, i, None])).any(axis=1) & (kept.sum(axis=1) < most)
            rank = np.argsort(np.where(s <= -9, 2, ~kept), axis=1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(s, rank, 1) > -9, np.take_along_axis(c, rank, 1), -1)
            out[lo : lo + 512, : got.shape[1]] = got
        return out

    def _beam(self, q: np.ndarray, entry: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, -1 where a beam isn't full; all queries take their steps together."""
        near, rows = self._near[layer], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self._f) + 1), bool)
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -9, np.float32)
        first = (self._f[entry] @ q[:, :, None])[:, :, 0]
        first[entry < 0] = -9
        order = np.argsort(-first, axis=1, kind="stable")[:, :width]
        ids[:, : order.shape[1]], sims[:, : order.shape[1]] = np.take_along_axis(entry, order, 1), np.take_along_axis(first, order, 1)
        seen[rows, np.where(entry < 0, len(self._f), entry)] = True
        new = ids >= 0
        while True:
            live = np.flatnonzero(new.any(axis=1))
            if not len(live):
                return ids, sims
            at = np.argsort(~new[live], axis=1, kind="stable")[:, :EXPAND]
            go = np.take_along_axis(new[live], at, 1)
            new[live[:, None], at] = False
            step = np.where(go[:, :, None], near[np.where(go, ids[live[:, None], at], 0)], -1).reshape(len(live), -1).astype(np.int64)
            step.sort(axis=1)
            bad = (step < 0) | seen[live[:, None], step]
            bad[:, 1:] |= step[:, 1:] == step[:, :-1]
            seen[live[:, None], np.where(bad, len(self._f), step)] = True
            s = (self._f[step] @ q[live][:, :, None])[:, :, 0]
            s[bad] = -9
            all_s = np.concatenate([sims[live], s], axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            sims[live] = np.take_along_axis(all_s, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(bad, -1, step)], axis=1), order, 1)
            new[live] = np.take_along_axis(np.concatenate([new[live], ~bad], axis=1), order, 1)

    def search(self, q: np.ndarray, width: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query on the lowest layer, where it may also start from a given node."""
        q = q.astype(np.float32)
        entry = np.full((len(q), 1), self._entry[-1])
        for layer in range(len(self._near) - 1, 0, -1):
            entry = self._beam(q, entry, ENTRIES, layer)[0]
        if start is not None:
            entry = np.concatenate([np.where(entry == start[:, None], -1, entry), start[:, None]], axis=1)
        return self._beam(q, entry, width, 0)

    def _shortened(self, u: np.ndarray) -> np.ndarray:
        first = u @ self._axes
        return np.concatenate([first, np.sqrt(np.maximum(0, 1 - (first * first).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)

    def possible(self, q: np.ndarray, cosine: float = COSINE, start: np.ndarray | None = None) -> np.ndarray:
        """Whether rows, but the one of the graph that start gives, may have the cosine to each query; where not, none has."""
        short, out = self._shortened(q), np.empty(len(q), bool)
        for lo in range(0, len(q), 128):
            most = short[lo : lo + 128] @ self._short
            if start is not None:
                most[np.arange(len(most)), start[lo : lo + 128]] = -9
            out[lo : lo + 128] = most.max(axis=1) >= cosine - _SLACK
        return out

    def within(self, q: np.ndarray, width: int, cosine: float = COSINE, start: np.ndarray | None = None) -> list[np.ndarray]:
        """Rows with at least the given cosine to each query, verified in double precision."""
        return self.within_or_all(q, width, cosine, start)[0]

    def within_or_all(self, q: np.ndarray, width: int, cosine: float = COSINE, start: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """What within gives, and whether a query was put to all rows, or none can be near it, so that nothing of it is missing."""
        n = len(self.u)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        wide, none = np.arange(len(q)), np.empty(0, np.int64)
        if 2 * width < n:
            could = self.possible(q, cosine, start)
            none, some = np.flatnonzero(~could), np.flatnonzero(could)
            if start is not None:
                for i in none:
                    out[i] = start[i : i + 1]
            found, sims = self.search(q[some], width, None if start is None else start[some])
            full = (sims >= cosine - _SLACK).sum(axis=1) > width // CROWDED
            for i in np.flatnonzero(~full & (sims.max(axis=1) >= cosine - _SLACK)):
                c = found[i][sims[i] >= cosine - _SLACK]
                out[some[i]] = c[self.u[c] @ q[some[i]] >= cosine]
            wide = some[full]
        for lo in range(0, len(wide), 64):
            rows = wide[lo : lo + 64]
            for i, near in zip(rows, q[rows].astype(np.float32) @ self._f.T >= cosine - _SLACK):
                c = np.flatnonzero(near)
                out[i] = c[self.u[c] @ q[i] >= cosine]
        scanned = np.zeros(len(q), bool)
        scanned[wide] = scanned[none] = True
        return out, scanned

    def recalls(self, probes: np.ndarray, width: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
        """For each probe with neighbours: how many there are, and the part of them that a beam finds."""
        there = np.concatenate([(probes[lo : lo + 64] @ self.u.T >= cosine).sum(axis=1) for lo in range(0, len(probes), 64)])
        found = np.array([len(x) for x in self.within(probes, width, cosine)])
        return there[there > 0], found[there > 0] / there[there > 0]

    def audited(self, cosine: float = COSINE, width: int = BEAM) -> int:
        """The beam with which probes find TARGET of their neighbours on average, those with few and with many neighbours each for themselves."""
        n = len(self.u)
        rng = np.random.default_rng(n)
        real, base = (self.u[rng.choice(n, min(PROBES, n), replace=False)] for _ in range(2))
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(axis=1, keepdims=True) * base
        length = np.linalg.norm(side, axis=1, keepdims=True)
        side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-9)
        turn = cosine + (1 - cosine) * rng.uniform(0.02, 1, (len(base), 1))
        probes = np.concatenate([real, units(turn * base + np.sqrt(1 - turn**2) * side)])
        while 2 * width < n:
            there, part = self.recalls(probes, width, cosine)
            dense = np.digitize(there, [2, 4, 16, 64])
            if all(part[dense == d].mean() >= TARGET for d in np.unique(dense)):
                break
            width *= 2
        return width


def _work(cosine: float):
    names = ["id", "n", "link"]

    def batch(*cols):
        return pa.record_batch([pa.array(np.asarray(c, np.int64)) for c in cols], names)

    class Shard:
        def __init__(self, ids, counts, rows):
            self.ids, self.counts = ids, counts
            self.graph = Graph(units(rows), len(ids))
            self.width = self.graph.audited(cosine)
            self.parent, self.got = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            # rows asked so far: those that were put to all rows, and which later rows each other one has found
            self.scanned, self.ahead = np.zeros(len(ids), bool), {}

        def roots(self, rows):
            r = self.parent[rows]
            while (up := self.parent[r]).tolist() != r.tolist():
                r = up
            return r

        def uncounted(self, me, near, whole):
            """Of the rows found near one of the shard's own those whose link hasn't been counted: later ones, and earlier ones that were asked before and didn't find it."""
            later, earlier = near[near > me], near[near < me]
            if not whole and len(later):
                self.ahead[me] = frozenset(later.tolist())  # no more than a part of a beam
            missed = [e for e in earlier[~self.scanned[earlier]].tolist() if me not in self.ahead.get(e, ())]
            return np.concatenate([later, np.array(missed, np.int64)])

        def ask(self, ids, counts, rows):
            size = max(16, min(512, (64 << 20) // max(len(self.ids), 1)))
            for i in range(0, len(ids), size):
                out, part = [], ids[i : i + size]
                at = np.minimum(np.searchsorted(self.ids, part), len(self.ids) - 1)
                own = self.ids[at] == part  # a shard's own classes ask it too, all of a batch or none
                hits, scanned = self.graph.within_or_all(units(rows[i : i + size]), self.width, cosine, at if own.all() else None)
                for one, n, me, mine, near, whole in zip(part.tolist(), counts[i : i + size].tolist(), at.tolist(), own.tolist(), hits, scanned.tolist()):
                    if mine:
                        self.scanned[me] = whole
                    if len(near):
                        r = self.roots(near)
                        self.parent[r] = r.min()
                        counted = self.uncounted(me, near, whole) if mine else near
                        self.got[counted] += n
                        if len(counted):
                            out.append((one, self.counts[counted].sum(), self.ids[near[0]]))
                if out:
                    yield batch(*zip(*out))

        def end(self):
            r = self.roots(np.arange(len(self.ids)))
            told = (r != np.arange(len(self.ids))) | (self.got > 0)
            yield batch(self.ids[told], self.got[told], self.ids[r[told]])

    def work(batches):
        key, held, shard = None, [], None
        for at, role, part in pieces(batches):
            if at != key:
                if shard:
                    yield from shard.end()
                key, held, shard = at, [], None
            rows = (np.asarray(part.column(3)), np.asarray(part.column(5)), matrix(part, at[0]))
            if role == 0:
                held.append(rows)
                continue
            if shard is None:
                if not held:
                    continue
                shard = Shard(*(np.concatenate(x) for x in zip(*held)))
                held = []
            yield from shard.ask(*rows)
        if shard:
            yield from shard.end()

    return work


def _asked(shard: Column, shards: int) -> Column:
    """The shards that a class asks: its own and the half of the ring that follows, so that of two shards one asks the other."""
    ahead = F.sequence(F.lit(1), F.lit(shards // 2)) if shards > 1 else F.array().cast("array<int>")
    after = F.filter(ahead, lambda o: (2 * o < shards) | (shard < o))
    return F.transform(after, lambda o: F.pmod(shard + o, F.lit(shards)))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    id, link with nothing and are their own component (a null id's is null). Equal vectors and repeated
    rows link with each other. Vectors of different lengths never meet. An empty table gives an empty one;
    other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("w"))
    fine = F.col("id").isNotNull() & sound("w") & F.exists("w", lambda x: x != 0)
    rows = cut(rows.select("id", F.when(fine, F.col("w")).alias("v")), "vectors")
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    shards, cores = shard_count(classes, shard_rows), vectors.sparkSession.sparkContext.defaultParallelism
    if shards > cores and shards % cores:  # so that no round of tasks leaves cores idle; a few more rows a shard also mean fewer copies to other shards
        down = shards // cores * cores
        shards = down if 4 * shards <= 5 * down else down + cores
    index = to_own_shard(classes.select(F.col("rep").alias("id"), "v", "n"), shards)
    away = index.withColumn("shard", F.explode(_asked(F.col("shard"), shards)))
    found = cut(put(index, (index, away), shards, _work(cosine), "id long, n long, link long"), "found")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(found, "id", "link").select(F.col("node").alias("rep"), "root")
    named = classes.join(links, "rep", "left").join(roots, "rep", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    return rows.join(named, "v", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce(F.coalesce("root", "id").eqNullSafe(F.col("id")), F.lit(True)).alias("kept"),
    )
