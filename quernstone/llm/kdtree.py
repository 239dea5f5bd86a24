"""Exact top-k inner-product search with a KD-tree per shard.

Trees split at the median of the widest dimension and keep tight boxes. A query walks a tree best
box first: no vector of a box scores above the sum of max(q * low, q * high), and a box whose
bound can't beat the k-th score is left out with all below it. A query first visits the shard that
it lives in, and takes the k-th score found there along to all others.
"""

from __future__ import annotations

from bisect import insort
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .shards import matrix, pieces, put, shard_count, sound, to_own_shard

K, LEAF, SHARD_ROWS = 5, 64, 100_000


class Tree:
    """points as integers; rows are ordered by id inside a leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self._low, self._high, self._least, self._span, self._kids = [], [], [], [], []
        self._order: list[np.ndarray] = []
        self._at = 0
        self._build(ids[order], points[order], order)
        order = np.concatenate(self._order)
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self._low), np.array(self._high)
        most = max(int(np.abs(self.low.astype(object)).max(initial=0)), int(np.abs(self.high.astype(object)).max(initial=0)))
        self.most = most

    def _build(self, ids: np.ndarray, points: np.ndarray, order: np.ndarray) -> None:
        stack = [(np.arange(len(ids)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            own = points[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self._low)
            if parent >= 0:
                self._kids[parent][side] = node
            self._low.append(low)
            self._high.append(high)
            self._least.append(int(ids[rows].min()))
            self._kids.append([-1, -1])
            self._span.append((0, 0))
            spread = high - low
            if len(rows) <= LEAF or not spread.any():
                self._span[node] = (self._at, self._at + len(rows))
                self._at += len(rows)
                self._order.append(order[np.sort(rows)])
                continue
            half = len(rows) // 2
            by = np.argpartition(own[:, int(np.argmax(spread))], half)
            stack += [(rows[by[half:]], node, 1), (rows[by[:half]], node, 0)]

    def search(self, queries: np.ndarray, own: list[int], k: int, known: list[tuple[int, int] | None]) -> list[list[tuple[int, int]]]:
        """For each query its best (score, id) rows here, at most k, that beat the known k-th (score, id)."""
        dim = self.points.shape[1]
        exact = dim * max(self.most, 1) * max(int(np.abs(queries.astype(object)).max(initial=0)), 1)
        kind = np.float64 if exact < 1 << 53 else np.int64 if exact < 1 << 63 else object
        points, low, high, qs = (x.astype(kind) for x in (self.points, self.low, self.high, queries))
        bounds = np.maximum(qs, 0) @ high.T + np.minimum(qs, 0) @ low.T
        out = []
        for q, bound, me, best in zip(qs, bounds, own, known):
            found: list[tuple[int, int]] = []
            worst = (-best[0], best[1]) if best else None
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heappop(heap)
                if worst is not None and (b > worst[0] or b == worst[0] and self._least[node] >= worst[1]):
                    if b > worst[0]:
                        break
                    continue
                left, right = self._kids[node]
                if left >= 0:
                    heappush(heap, (-bound[left], left))
                    heappush(heap, (-bound[right], right))
                    continue
                s, e = self._span[node]
                if e - s > LEAF:
                    e = min(e, s + k + int(np.count_nonzero(self.ids[s:e] == me)))
                scores = points[s:e] @ q
                close = range(e - s) if worst is None else np.flatnonzero(scores >= -worst[0]).tolist()
                for i in close:
                    if (one := int(self.ids[s + i])) != me and (worst is None or (-scores[i], one) < worst):
                        insort(found, (-int(scores[i]), one))
                        if len(found) > k:
                            found.pop()
                        if len(found) == k and (worst is None or found[-1] < worst):
                            worst = found[-1]
            out.append([(-s, i) for s, i in found])
        return out


def _work(k: int):
    def work(batches):
        key, ids, rows, tree = None, [], [], None
        for at, role, part in pieces(batches):
            if at != key:
                key, ids, rows, tree = at, [], [], None
            own = np.asarray(part.column(3))
            if role == 0:
                ids.append(own)
                rows.append(matrix(part, at[0]))
                continue
            if tree is None:
                if not ids:
                    continue
                tree = Tree(np.concatenate(ids), np.concatenate(rows))
                ids, rows = [], []
            for i in range(0, part.num_rows, 512):
                sub = part.slice(i, 512)
                known = [None if s is None else (s, n) for s, n in zip(sub.column(5).to_pylist(), sub.column(6).to_pylist())]
                got = tree.search(matrix(sub, at[0]), sub.column(3).to_pylist(), k, known)
                flat = [(q, n, s) for q, g in zip(sub.column(3).to_pylist(), got) for s, n in g]
                cols = list(zip(*flat)) or [[], [], []]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["query_id", "id", "score"])

    return work


def integers(vector: str = "embedding") -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest integer inner products.

    is_query picks the queries by the column `id`. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; vectors of different lengths never meet. A
    query's candidates are the rows with another id, a repeated row among them counts each time it
    is there, and ties go to the smaller id. An id that repeats is one query, with the smallest of its
    vectors. Empty tables give an empty result; other columns are not read.
    """
    points = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & sound("v"))
    points = cut(points.select("id", integers("v").alias("v")), "points")
    shards = shard_count(points, shard_rows)
    blank = [F.lit(None).cast("long").alias("kth"), F.lit(None).cast("long").alias("kth_id")]
    index = to_own_shard(points, shards).select("*", *blank)
    asked = to_own_shard(points.where(is_query).groupBy("id").agg(F.min("v").alias("v")), shards)
    schema = "query_id long, id long, score long"
    home = cut(put(index, (asked.select("*", *blank),), shards, _work(k), schema), "home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("id")).alias("i"))).alias("w"))
    kth = kth.where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("w.score").alias("kth"), (-F.col("w.i")).alias("kth_id"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))
    away = asked.join(kth, "id", "left").select("id", "v", "dim", F.explode(others).alias("shard"), "kth", "kth_id")
    found = home.unionByName(put(index, (away,), shards, _work(k), schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)
