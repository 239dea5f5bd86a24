"""Keys, upserts, differences and profiles of tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = 1) -> DataFrame:
    """The first rows of each key in the order given; give it a unique tie-break."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= rows).drop("__n")


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt over all cores if its files give fewer partitions than there are cores. For plain scans: others would be run to learn their partitions."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def top_k(df: DataFrame, k: int, *order: Column, most: int | None = None) -> DataFrame:
    """The first k rows in order, one at least; of operators that hold k down, at most `most`."""
    return df.orderBy(*order).limit(max(1, k if most is None else min(k, most)))


def match(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b on equal keys, nulls being equal; b has one row a key. Without keys b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    other = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    return a.join(other, on, how).drop(*[f"__b_{k}" for k in keys])


#: Rows that an operator sends to all tasks at most, counted before it does so.
SENT_ROWS = 10_000


def in_blocks(asked: DataFrame, key: str, most: int | None = None) -> list[DataFrame]:
    """A stated table as tables of about so many rows, by a hash of its key, each marked to be sent to all tasks. Null keys go along."""
    most = SENT_ROWS if most is None else most
    n = -(-asked.count() // most)
    if n <= 1:
        return [F.broadcast(asked)]
    return [F.broadcast(asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def with_each(rows: DataFrame, asked: DataFrame, key: str, on: Column | None = None) -> DataFrame:
    """Rows with each row of a stated table that `on` lets them meet, in blocks of it."""
    out = None
    for block in in_blocks(asked, key):
        own = rows.crossJoin(block) if on is None else rows.join(block, on)
        out = own if out is None else out.unionByName(own)
    return out


def _sides(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*[c for c in rest if c in old.columns]).alias("o"))
    b = new.select(*keys, F.struct(*rest).alias("n"))
    return a.join(b, list(keys), "full"), rest


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = (), keep_if_same: dict[str, str] | None = None) -> DataFrame:
    """New rows over old ones.

    keep_if_null: columns whose old value stays where the new one is null. keep_if_same: columns whose old value
    stays only while another column hasn't changed, and goes otherwise.
    """
    both, rest = _sides(old, new, keys)
    out = []
    for c in rest:
        o, n = F.col("o")[c], F.col("n")[c]
        if keep_if_same and c in keep_if_same:
            by = keep_if_same[c]
            value = F.coalesce(n, F.when(F.col("o")[by].eqNullSafe(F.col("n")[by]), o))
        elif c in keep_if_null:
            value = F.coalesce(n, o)
        else:
            value = n
        out.append(F.when(F.col("n").isNull(), o).otherwise(value).alias(c))
    return both.select(*keys, *out)


def merge_gaps(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Gap rows merged: the greater confidence, priority and last sighting, the lesser first one, sightings counted on reopening."""
    both, _ = _sides(old, new, [key])
    o, n = (lambda c: F.col("o")[c]), (lambda c: F.col("n")[c])
    reopened = n("status").isin("open", "in_progress") & o("status").isin("observing", "resolved") & (n("last_seen") > o("verified"))
    return both.select(
        key,
        F.when(F.coalesce(reopened, F.lit(False)), "open").otherwise(F.coalesce(o("status"), n("status"))).alias("status"),
        F.greatest(o("confidence"), n("confidence")).alias("confidence"),
        F.greatest(o("priority"), n("priority")).alias("priority"),
        F.least(o("first_seen"), n("first_seen")).alias("first_seen"),
        F.greatest(o("last_seen"), n("last_seen")).alias("last_seen"),
        F.coalesce(n("verified"), o("verified")).alias("verified"),
        (F.coalesce(o("reopen_count"), F.lit(0)) + F.coalesce(reopened, F.lit(False)).cast("int")).alias("reopen_count"),
    )


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows, and of the new ones those with a key that is not there yet, the first of each."""
    fresh = latest_per_key(new, keys, order).join(old.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def drop_stale(projection: DataFrame, canonical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a projection whose key the canonical set still has."""
    return projection.join(canonical.select(*keys).distinct(), list(keys), "left_semi")


def drift(expected: DataFrame, actual: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows (keys, kind, fields) that differ: missing, stale, or mismatched with the names of the fields, nulls being equal."""
    a = expected.select(*keys, F.struct(*fields).alias("e"))
    b = actual.select(*keys, F.struct(*fields).alias("a"))
    both = a.join(b, list(keys), "full")
    off = F.filter(F.array(*[F.when(~F.col("e")[f].eqNullSafe(F.col("a")[f]), f) for f in fields]), lambda x: x.isNotNull())
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "stale").when(F.size(off) > 0, "mismatched")
    named = F.when(kind == "mismatched", F.array_join(off, ",")).otherwise("")
    return both.select(*keys, kind.alias("kind"), named.alias("fields")).where("kind is not null")


def describe(df: DataFrame) -> DataFrame:
    """Rows (ordinal, column, type, nullable, non_null)."""
    parts = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("non_null")) for i, f in enumerate(df.schema, 1)]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def aggregate(df: DataFrame, group_by: str, agg: str, column: str | None = None, where: str | None = None, descending: bool = True, k: int = 200) -> DataFrame:
    """One aggregate by one column, the largest first, key as bucket; where is `column = 'literal'` only."""
    if agg not in ("count", "sum", "avg", "min", "max"):
        raise ValueError(f"no such aggregate: {agg}")
    if where:
        m = re.fullmatch(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*'([^']{0,80})'\s*", where)
        if not m or m[1] not in df.columns:
            raise ValueError("where must be column = 'literal'")
        df = df.where(F.col(m[1]) == m[2])
    value = F.count("*") if agg == "count" else getattr(F, agg)(column)
    out = df.groupBy(F.col(group_by).alias("bucket")).agg(value.alias("value"))
    return top_k(out, k, F.col("value").desc() if descending else F.col("value").asc(), F.col("bucket").asc(), most=200)


_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|copy|call|set|add|load|refresh|cache|uncache|analyze|msck|repair|use|vacuum|reindex|lock|execute|prepare)\b", re.I)


def read_only_sql(spark: SparkSession, sql: str, cap: int = 200) -> DataFrame:
    """A SELECT or WITH query, limited; anything else is an error. Words inside literals don't count."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)).strip()
    if not re.match(r"(?i)(select|with)\b", bare) or ";" in bare or _FORBIDDEN.search(bare):
        raise ValueError("only single SELECT or WITH queries may run")
    return spark.sql(sql).limit(max(1, min(cap, 200)))


def staged(stages: Sequence[DataFrame], key: Sequence[str] = ()) -> DataFrame:
    """The rows of the first stage that has any, for each key; stages have the same columns."""
    every = None
    for i, s in enumerate(stages):
        part = s.withColumn("stage", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(*key).agg(F.min("stage").alias("stage"))
    return every.join(first, [*key, "stage"], "left_semi")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For each row of left the value of right at the nearest earlier or equal place, else at the first later one.

    Both sides are sorted together once, within their keys; nothing is joined pair by pair.
    """
    a = left.select(*keys, F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    b = right.select(*keys, F.col(at).alias("at"), F.lit(0).alias("side"), F.col(value).alias("v"))
    w = Window.partitionBy(*keys).orderBy("at", "side")
    own = F.when(F.col("side") == 0, F.struct("at", "v"))
    rows = b.unionByName(a).withColumn("prev", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    pick = F.coalesce("prev", "next")
    return rows.where("side = 1").select(*keys, F.col("at").alias(at), pick["at"].alias("found_at"), pick["v"].alias(value), F.when(F.col("prev").isNotNull(), "previous").when(pick.isNotNull(), "following").otherwise("none").alias("fallback"))
