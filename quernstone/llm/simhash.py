"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits and two link at RADIUS = 3 or fewer differing bits. Half of three isn't
whole, so each fingerprint is looked at four times, each time without one of its four 16-bit
blocks, and emits all variants within radius 1 (half of three, rounded down) of what is left: 49
variants a view, 196 in all. Two fingerprints at distance 3 or less have a block that holds one or
more of the differing bits; without it they are at most two bits apart, each reaches the middle
with one step, and both land on that variant.

Members of one variant group are linked without listing all pairs. With equal left-out blocks two
members differ in at most 2 bits, with blocks one bit apart in at most 3, so a star over equal
blocks and one link between neighbouring block values keep every such link's connection. What
that leaves is three differing bits in one block, found among members equal in all other bits.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, loose, row_hash, tidy, words_of
from .components import components
from .sieve import make_filter

RADIUS = 3
BLOCK = 16
SHINGLE = 3


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of the n-word shingles, repeats included; 0 where there is no word."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        rows = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """Rows (id, fp), fp the fingerprint as a signed long."""

    def each(batches):
        for b in batches:
            fps = np.array([fingerprint(t, n) for i in range(0, b.num_rows, 512) for t in as_bytes(b.column(1).slice(i, 512))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), "id long, fp long")


def _variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints) of all variants; a key holds the 48 bits left and, above them, the number of the block left out."""
    keys = []
    for b in range(64 // BLOCK):
        low, high = np.uint64(BLOCK * b), np.uint64(BLOCK * (b + 1))
        rest = (fps & ((np.uint64(1) << low) - np.uint64(1))) if b else np.zeros_like(fps)
        if b < 64 // BLOCK - 1:
            rest = rest | ((fps >> high) << low)
        rest = rest | np.uint64(b << (64 - BLOCK))
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64 - BLOCK, dtype=np.uint64)])
        keys.append(rest[:, None] ^ flips[None, :])
    keys = np.concatenate(keys, axis=1)
    return keys.ravel(), np.repeat(fps, keys.shape[1])


_TRIPLES = np.array([sum(1 << i for i in c) for c in combinations(range(BLOCK), 3)], np.uint64)


def _group_links(key: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked in one variant group."""
    b = int(key) >> (64 - BLOCK)
    shift = np.uint64(BLOCK * b)
    blocks = (fps >> shift) & np.uint64((1 << BLOCK) - 1)
    first: dict[int, int] = {}
    out = []
    for x, fp in zip(blocks.tolist(), fps.tolist()):
        if x in first:
            out.append((first[x], fp))
        else:
            first[x] = fp
    for x, fp in first.items():
        for i in range(BLOCK):
            y = x ^ (1 << i)
            if y > x and y in first:
                out.append((fp, first[y]))
    centre = _variants(fps)[0].reshape(len(fps), -1)[:, b * (64 - BLOCK + 1)] == np.uint64(key)
    if centre.sum() > 1:
        at = dict(zip(blocks[centre].tolist(), fps[centre].tolist()))
        for x, fp in at.items():
            out += [(fp, at[y]) for y in (np.uint64(x) ^ _TRIPLES).tolist() if y > x and y in at]
    return out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) that connect the distinct fingerprints of column fp just as all pairs at RADIUS or less would."""

    def emit(batches):
        for b in batches:
            all_fps = np.asarray(b.column(0)).view(np.uint64)
            for i in range(0, len(all_fps), 4096):
                keys, own = _variants(all_fps[i : i + 4096])
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"])

    def link(batches):
        rest = (np.empty(0, np.uint64), np.empty(0, np.uint64))

        def meet(keys, fps):
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            two = starts[ends - starts == 2]
            src, dst = [fps[two]], [fps[two + 1]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                if found := np.array(_group_links(int(keys[s]), fps[s:e]), np.uint64).reshape(-1, 2).T.tolist():
                    src.append(np.array(found[0], np.uint64))
                    dst.append(np.array(found[1], np.uint64))
            src, dst = np.concatenate(src), np.concatenate(dst)
            near = np.bitwise_count(src ^ dst) <= RADIUS
            src, dst = src[near].view(np.int64), dst[near].view(np.int64)
            pairs = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], axis=1), axis=0)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

        for b in batches:
            keys = np.concatenate([rest[0], np.asarray(b.column(0)).view(np.uint64)])
            own = np.concatenate([rest[1], np.asarray(b.column(1)).view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            rest = keys[last:], own[last:]
            if last:
                yield meet(keys[:last], own[:last])
        if len(rest[0]):
            yield meet(*rest)

    # a fingerprint grows to 196 rows, so the few bytes they come from are dealt out evenly first
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fps.select("fp").distinct().repartition(parts).mapInArrow(tidy(emit), "key long, fp long")
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(link), "src long, dst long").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of linked texts, with all its columns: the one with the smallest id, of equal ids that with the smallest fingerprint, then the smallest hash of its columns.

    A row is known by a 128-bit hash of all its columns, nulls told apart, so texts that share an id are decided each for itself, and of
    rows that are equal in all columns one stays. A null id comes after all others. Null and empty texts have
    fingerprint zero. An empty table gives an empty one. Columns may have any names.
    """
    key = F.struct(row_hash(docs, docs.columns, 1).alias("a"), row_hash(docs, docs.columns, 2).alias("b"))

    def each(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for i in range(0, b.num_rows, 512) for t in as_bytes(b.column(1).slice(i, 512))], np.uint64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["id", "key", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    made = cut(texts.mapInArrow(tidy(each), "id long, key struct<a:long,b:long>, fp long"), "fingerprinted")
    rows = made.groupBy("key", "id", "fp").agg(F.count("*").alias("n"))
    roots = components(fingerprint_links(made.select("fp"))).select(F.col("node").alias("fp"), "root")
    place = F.struct(F.col("id").isNull().alias("no"), "id", "fp", "key")
    firsts = made.groupBy("fp").agg(F.min(place).alias("first")).join(roots, "fp", "left")
    firsts = firsts.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = firsts.select(F.col("first.key").alias("key"), F.lit(True).alias("stays"))
    fate = rows.join(stay, "key", "left").where("stays is null or n > 1").select("key", F.coalesce("stays", F.lit(False)).alias("stays"))
    fate = cut(fate, "fate")
    # a filter of bounded size lets most rows pass, and only those that may be in the table of fates meet it, by a shuffle
    sieve = make_filter(fate.select(F.col("key.a").alias("h")))
    if sieve is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    @F.pandas_udf("boolean")
    def may_be_there(h: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(h.to_numpy().view(np.uint64)))

    whole = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key")).withColumn("may", may_be_there("key.a"))
    some = whole.where("may")
    alone = some.join(fate.select("key"), "key", "left_anti")
    repeated = some.join(fate.where("stays").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return whole.where("not may").unionByName(alone).unionByName(repeated).select("doc.*")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs.

    Null and empty texts have fingerprint zero and link like any other; equal fingerprints link.
    component_id is the smallest id reachable. Rows with a null id take part; their own id stays null,
    and the smallest id of their component is null only where no member has one. Repeated rows stay
    repeated; an empty table gives an empty one. Other columns are not read, whatever their names.
    """
    made = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = made.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = components(fingerprint_links(made)).select(F.col("node").alias("fp"), "root")
    classes = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.select("fp", "root").join(lowest.select(loose("root"), "component_id"), "root").select("fp", "component_id")
    return made.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
