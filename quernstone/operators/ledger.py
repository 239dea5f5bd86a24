"""Event ledgers and their projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drift, latest_per_key


def project(events: DataFrame, key: str, terminal: Column, order: Sequence[Column], fields: dict[str, Column]) -> DataFrame:
    """The last terminal event of each key, as a row of named fields."""
    return latest_per_key(events.where(terminal & F.col(key).isNotNull()), [key], order).select(key, *[c.alias(n) for n, c in fields.items()])


def idempotent(events: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first event of each idempotency key."""
    return latest_per_key(events, [key], order)


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows to write and the keys to delete that bring a projection in line with its ledger."""
    d = drift(expected, actual, keys, fields)
    return expected.join(d.where("kind <> 'stale'").select(*keys), list(keys), "left_semi"), d.where("kind = 'stale'").select(*keys)


def merged_runs(*sources: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Runs of several sources in one order, each id once, the earlier source first."""
    every = None
    for i, s in enumerate(sources):
        own = s.withColumn("source_no", F.lit(i))
        every = own if every is None else every.unionByName(own)
    return latest_per_key(every, ["run_id"], [F.col("source_no")]).orderBy(*order)
