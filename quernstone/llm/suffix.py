"""Passages that repeat across documents, by sparse suffix arrays.

Of a text's suffixes only those stay that begin at a minimiser: the position with the least hash of
its first GRAM words among WINDOW neighbouring ones. GRAM + WINDOW - 1 is LEAST, so any passage of
LEAST words that two documents share holds one such window whole, and both keep a suffix at the
same place in it. A suffix is written as the hash of its first words, then the words right of
them, then those left of it, nearest first. All suffixes are sorted so, across all partitions.
Suffixes that agree in their first words are compared in each of the WINDOW passages of LEAST
words that hold those: the passages are hashed from the words left and right, and equal hashes of
different documents are matches. What shares its first words with too many others, or with another
task, is compared so by a shuffle of the passages' hashes.

A first pass counts the hashes alone. Those that more than one document has set bits in a filter of
fixed size, and the second pass writes only suffixes that the filter lets through; when a
corpus fills the filter, more of them are written and none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_bytes, cut, tidy, words_of

LEAST = 50
WINDOW = 25
GRAM = LEAST - WINDOW + 1
SIDE = WINDOW - 1
#: Bits of the filter; suffixes of one key that are compared in memory.
FILTER_BITS, KEY_ROWS = 1 << 27, 1 << 16
_P = 0x9E3779B97F4A7C15


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words, from the words' hashes."""
    powers = {1: h}
    size = 1
    with np.errstate(over="ignore"):
        while size * 2 <= GRAM:
            half = powers[size]
            powers[size * 2] = half[: len(half) - size] * np.uint64(pow(_P, size, 1 << 64)) + half[size:]
            size *= 2
        out, done = None, 0
        for size in sorted(powers, reverse=True):
            if GRAM & size:
                n = len(h) - GRAM + 1
                part = powers[size][done : done + n]
                out = part if out is None else out * np.uint64(pow(_P, size, 1 << 64)) + part
                done += size
        x = out ^ (out >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def anchors(g: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every WINDOW neighbouring ones, the first of equal ones."""
    found = []
    for i in range(0, len(g) - WINDOW + 1, 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(g[i : i + (1 << 16) + WINDOW - 1], WINDOW)
        found.append(np.unique(part.argmin(axis=1) + np.arange(i, i + len(part))))
    return np.unique(np.concatenate(found))


def _suffixes(text: bytes | None):
    """(word hashes, gram hashes, anchors), or nothing for a text of fewer than LEAST words."""
    words = words_of(text)
    if len(words) < LEAST:
        return None
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    g = grams(h)
    return h, g, anchors(g)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _repeated(texts: DataFrame) -> np.ndarray:
    """The filter, as bytes of bits, over first-word hashes that two rows or more have."""

    def keys(batches):
        for b in batches:
            own = [np.unique(s[1][s[2]]) for t in as_bytes(b.column(1)) if (s := _suffixes(t))]
            if own:
                yield pa.record_batch([pa.array(np.concatenate(own).view(np.int64))], ["key"])

    twice = texts.mapInArrow(tidy(keys), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mask = F.lit(FILTER_BITS - 1).cast("long")
    places = twice.select(F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    got = places.select(F.shiftright("p", 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint8)


_ROW = "key long, context binary, row long, id long, pos array<long>"
_NO_ID = (1 << 63) - 1
_NAMES = ["key", "context", "row", "id", "pos"]


def _written(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """The suffixes that pass the filter, each with its contexts as big-endian words of 32 bits, 0 beyond the text."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def each(batches):
        row = TaskContext.get().partitionId() << 40
        has = lambda at: (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        for b in batches:
            for id_, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                row += 1
                if not (s := _suffixes(text)):
                    continue
                h, g, p = s
                one, two = _bits(g[p])
                p = p[(has(one) & has(two)).astype(bool)]
                if not len(p):
                    continue
                w = np.maximum(h >> np.uint64(32), np.uint64(1)).astype(">u4")
                w = np.concatenate([np.zeros(SIDE, ">u4"), w, np.zeros(SIDE, ">u4")])
                right = w[(p + SIDE + GRAM)[:, None] + np.arange(SIDE)]
                left = w[(p + SIDE - 1)[:, None] - np.arange(SIDE)]
                context = np.concatenate([right, left], axis=1).astype(">u4")
                # what repeats inside the text is one suffix with several places
                places: dict[tuple[int, bytes], list[int]] = {}
                for k, c, at in zip(g[p].view(np.int64).tolist(), context, p.tolist()):
                    places.setdefault((k, c.tobytes()), []).append(at)
                n = len(places)
                keys, raw = zip(*places)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(raw, pa.binary()), pa.array([row] * n, pa.int64()), pa.array([id_] * n, pa.int64()), pa.array(places.values(), pa.list_(pa.int64()))], _NAMES)

    return texts.mapInArrow(tidy(each), _ROW)


_FOUND = "h long, row long, id long, start long, end long, partner long"


def _windows(key, context):
    """For each number of words left of the anchor: hashes of the window of LEAST words that begins there, and whether the text has it whole."""

    def prefixes(words):
        out = [np.zeros(len(words), np.uint64)]
        for j in range(SIDE):
            out.append(out[-1] * np.uint64(_P) + words[:, j])
        return out

    with np.errstate(over="ignore"):
        right, left = prefixes(context[:, :SIDE]), prefixes(context[:, SIDE:])
        for a in range(SIDE + 1):
            x = (key.view(np.uint64) * np.uint64(_P) + left[a]) * np.uint64(0xC2B2AE3D27D4EB4F) + right[SIDE - a] + np.uint64(a)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            whole = np.ones(len(key), bool)
            if a:
                whole &= context[:, SIDE + a - 1] != 0
            if a < SIDE:
                whole &= context[:, SIDE - a - 1] != 0
            yield x ^ (x >> np.uint64(29)), whole


def _shared(key, context, row, ids, open_: bool):
    """(index, words to the left, words to the right, partner) of suffixes in windows that another row here has too, from first to last.

    Where open_, also (index, words to the left, hash) of what stands for each window here: one suffix of two rows each, or all of the only row.
    """
    n = len(key)
    most, least, partner = np.full(n, -1), np.full(n, SIDE), np.full(n, _NO_ID)
    by_id, kept = np.argsort(ids, kind="stable"), []
    for a, (h, whole) in enumerate(_windows(key, context)):
        i = by_id[whole[by_id]]
        if not len(i):
            continue
        i = i[np.argsort(h[i], kind="stable")]
        new = np.concatenate([[True], h[i[1:]] != h[i[:-1]]])
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        first = i[begin]
        other = row[i] != row[first][group]
        twice = np.logical_or.reduceat(other, begin)
        good = twice[group]
        g = i[good]
        most[g], least[g] = a, np.minimum(least[g], a)
        second = np.minimum.reduceat(np.where(other, ids[i], _NO_ID), begin)
        partner[g] = np.minimum(partner[g], np.where(other, ids[first][group], second[group])[good])
        if open_:
            met = np.minimum.reduceat(np.where(other, np.arange(len(i)), len(i)), begin)
            at = np.concatenate([np.flatnonzero(~good), begin[twice], met[twice]])
            kept.append((i[at], np.full(len(at), a), h[i[at]].view(np.int64)))
    i = np.flatnonzero(most >= 0)
    return (i, most[i], SIDE - least[i], partner[i]), [np.concatenate(x) for x in zip(*kept)]


def _matches(batches):
    """Stretches of suffixes, with partners; with h, windows that are still to be compared across tasks.

    A key's suffixes are compared in all windows at once. Those of a task's first and last key, which other tasks may
    have too, and of keys with more than KEY_ROWS are compared as far as they lie together, and their windows go on.
    """

    def arrays(b):
        cols = [np.asarray(b.column(0)), None, np.asarray(b.column(2)), np.asarray(b.column(3).fill_null(_NO_ID)), np.empty(b.num_rows, object)]
        cols[4][:] = b.column(4).to_pylist()
        cols[1] = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(b.num_rows, 2 * SIDE).astype(np.uint32)
        return cols

    def rows(cols, i, before, after, partner, h):
        lists = cols[4][i]
        times = np.array([len(x) for x in lists])
        i, before, after = (np.repeat(x, times) for x in (i, before, after))
        pos = np.array([x for one in lists for x in one])
        given = lambda x: pa.nulls(len(i), pa.int64()) if x is None else pa.array(np.repeat(x, times))
        known = lambda x: pa.array(x, mask=x == _NO_ID)
        partner = pa.nulls(len(i), pa.int64()) if partner is None else known(np.repeat(partner, times))
        return pa.record_batch([given(h), pa.array(cols[2][i]), known(cols[3][i]), pa.array(pos - before), pa.array(pos + GRAM + after), partner], ["h", "row", "id", "start", "end", "partner"])

    def compared(cols, open_):
        (i, before, after, partner), kept = _shared(*cols[:4], open_)
        if len(i):
            yield rows(cols, i, before, after, partner, None)
        if kept:
            for lo in range(0, len(kept[0]), 1 << 16):
                i, before, h = (x[lo : lo + (1 << 16)] for x in kept)
                yield rows(cols, i, before, SIDE - before, None, h)

    held = passed = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = arrays(b)
        if passed is None:
            passed = cols[0][0]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        key = cols[0]
        own, last = int(np.searchsorted(key, passed, "right")), int(np.searchsorted(key, key[-1]))
        last = max(own, last)
        if own:
            yield from compared([c[:own] for c in cols], True)
        if last > own:
            yield from compared([c[own:last] for c in cols], False)
        held = [c[last:] for c in cols]
        if len(held[0]) > KEY_ROWS:
            passed = key[-1]
            yield from compared(held, True)
            held = None
    if held is not None and len(held[0]):
        yield from compared(held, True)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, partner_id), one for each stretch of a document that repeats.

    A stretch is a union of overlapping passages of LEAST words or more that another row has too, and passages
    that only touch are two; end_word is
    exclusive; partner_id is the smallest id that a passage in it was matched with. Words are those that ASCII
    blanks part, in ASCII lower case. Null, empty and shorter texts have none; a null id stays null; repeated rows
    match each other; repetition inside one row doesn't count. An empty table gives an empty one; other columns
    are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = ["key", "context", "row"]
    written = cut(_written(texts, _repeated(texts)), "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(written.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(_matches), _FOUND), "matches")
    # windows of keys that tasks share meet by their hashes; a batch leaves two rows of each at most
    h = Window.partitionBy("h")
    met = found.where("h is not null").withColumn("first", F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).over(h))
    elsewhere = F.col("row") != F.col("first.row")
    met = met.withColumn("second", F.min(F.when(elsewhere, F.struct(F.col("id").isNull().alias("no"), "id"))).over(h)).where("second is not null")
    met = met.withColumn("partner", F.when(elsewhere, F.col("first.id")).otherwise(F.col("second.id")))
    names = ["row", "id", "start", "end", "partner"]
    spans = found.where("h is null").select(*names).unionByName(met.select(*names))
    by = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("row", "island").agg(F.first("id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("partner").alias("partner_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")
