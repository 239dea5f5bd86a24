"""Streaming of sharded vector indexes: a shard's rows come first, then the queries put to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy


def sound(vector: str = "embedding") -> Column:
    """True for vectors that aren't null and hold finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def shard_count(points: DataFrame, per_shard: int, least_rows: int = 2000) -> int:
    """Shards of at most about so many rows; more and smaller ones where cores would be idle, but not below least_rows."""
    rows, cores = points.count(), points.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // per_shard), min(cores, -(-rows // least_rows)))


def to_own_shard(points: DataFrame, shards: int) -> DataFrame:
    """Points with (dim, shard): vectors of one length only ever meet their like."""
    return points.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))


def put(index: DataFrame, queries: tuple[DataFrame, ...], shards: int, work, schema: str) -> DataFrame:
    """Run work on every shard; all tables have the same columns, dim, shard, id and v among them.

    Spark deals and sorts the rows, spilling where it must. Every shard is a partition of its own; a task
    holds one shard's index and one batch of queries. Each table of queries is sorted by itself, so no batch mixes them.
    """
    rows = index.withColumn("role", F.lit(0))
    for n, part in enumerate(queries, 1):
        rows = rows.unionByName(part.withColumn("role", F.lit(n)))
    rows = rows.select("dim", "shard", "role", "id", "v", *[c for c in rows.columns if c not in ("dim", "shard", "role", "id", "v")])
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "role", "id").mapInArrow(tidy(work), schema)


def pieces(batches) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """((dim, shard), role, rows) for each run of rows of one shard and role."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(i)) for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            yield (int(keys[0, s]), int(keys[1, s])), int(keys[2, s]), b.slice(s, e - s)


def matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = part.column(4).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(part.num_rows, dim)
