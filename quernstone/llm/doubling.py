"""Substring dedup by level-wise doubling.

A window is a number of consecutive words of one document. Lengths double from BASE or a little
less up to the length asked for (9, 18, 35), and only windows repeated at one length are extended to the
next: a window that starts twice holds, at every shorter length, windows that start twice.

Of the shorter windows not all are counted. A long window stands for itself by the one whose hash is least
among those inside it, so at each length only windows that are least in some long window still
alive are looked at, and a long window lives on if its least one is repeated. Equal long windows
have equal least ones, so none is lost. A hash at twice the length is made of the two hashes of its halves,
which overlap where the length isn't even.

At the last length the windows themselves are compared. What a task sees twice is settled there, and
it sends one of each kind on, in stretches that share their least window of the length before: those
meet by its hash. What is found repeated goes back to the texts by a hash of each text, so the copies of
a text share one answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import as_bytes, cut, loose, named, tidy, word_lists
from .sieve import Filter, make_filter

LENGTH, BASE = 35, 10
#: Windows compared in a task at once; those of a long text that are looked at at once.
HELD, CHUNK = 1 << 20, 1 << 18
#: How often the route of windows may occur before they meet by their own hashes.
HEAVY = 1 << 11
_P, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def levels(length: int) -> list[int]:
    """Lengths from the base up to the one asked for, each at most twice the one before."""
    out = [length]
    while out[-1] > BASE:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def base_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of the base length, from the words' hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - length + 1), np.uint64)
        for j in range(length):
            out = out * _P + words[j : j + len(out)]
        return _mixed(out)


def doubled(h: np.ndarray, length: int, longer: int) -> np.ndarray:
    """Hashes of all windows of a length up to twice that of h, from its first and its last part."""
    n = len(h) - (longer - length)
    with np.errstate(over="ignore"):
        return _mixed(h[: max(0, n)] * _P + h[longer - length :])


def running(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each size neighbouring values, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


def looked_at(h: np.ndarray, least: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Marks windows that are the least of a long window that is alive."""
    span = len(h) - len(least) + 1
    # a long window's least value is never above a hash inside it, so the greatest over those around tells
    with np.errstate(over="ignore"):
        shown = np.where(alive, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    return (running(np.concatenate([pad, shown, pad]), span, np.maximum) == h) & (running(np.concatenate([pad, alive.astype(np.uint64), pad]), span, np.maximum) > 0)


def word_hashes(text: bytes | None) -> np.ndarray:
    parts = [np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) for words in word_lists(text)]
    return np.concatenate([np.empty(0, np.uint64), *parts])


def climb(words: np.ndarray, lengths: list[int], filters: list[Filter]):
    """(start, hashes, least, least one length below, alive) at the length after the filters', for stretches of the text where a window lives."""
    top = lengths[-1]
    for start in range(0, len(words) - top + 1, CHUNK):
        part = words[start : start + CHUNK + top - 1]
        alive, h, least = np.ones(len(part) - top + 1, bool), None, None
        for i, length in enumerate(lengths[: len(filters) + 1]):
            h = doubled(h, lengths[i - 1], length) if i else base_hashes(part, length)
            below, least = least, running(h, top - length + 1, np.minimum)
            if i < len(filters):
                alive &= filters[i].has(least)
                if not alive.any():
                    break
        else:
            yield start, h, least, below, alive


def _counted(texts: DataFrame, lengths: list[int], filters: list[Filter]) -> DataFrame:
    """Rows (h, n): how often a task saw a window, of those that are looked at at this length."""
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def each(batches):
        for b in batches:
            own = [h[looked_at(h, least, alive)] for t in as_bytes(b.column("text")) for _, h, least, _, alive in climb(word_hashes(t), lengths, sent.value)]
            if own:
                h, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.select("text").mapInArrow(tidy(each), "h long, n long")


def _starts(*same: np.ndarray) -> np.ndarray:
    """Where runs begin in which each of the arrays stays as it is."""
    new = np.ones(len(same[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
    return np.flatnonzero(new)


_SENT = "route long, a long, b long, start long, end long, hashes binary, open boolean"
_NAMES = ["route", "a", "b", "start", "end", "hashes", "open"]


def _compared(texts: DataFrame, lengths: list[int], filters: list[Filter], heavy: Filter | None) -> DataFrame:
    """Stretches of windows of the last length: settled ones without hashes, and ones to be compared by route, open if they need an answer."""
    sent = texts.sparkSession.sparkContext.broadcast((filters, heavy))

    def settle(keys, h, route, doc, pos):
        order = np.argsort(h, kind="stable")
        begin = _starts(h[order])
        sizes = np.diff(np.append(begin, len(h)))
        twice, first = np.empty(len(h), bool), np.zeros(len(h), bool)
        twice[order] = np.repeat(sizes > 1, sizes)
        first[order[begin]] = True
        at = pos - np.arange(len(pos))
        i = np.flatnonzero(twice)
        if len(i):
            begin = _starts(doc[i], pos[i] - np.arange(len(i)))
            end = np.append(begin[1:], len(i)) - 1
            runs = {(*keys[d], s, e) for d, s, e in zip(doc[i[begin]].tolist(), pos[i[begin]].tolist(), (pos[i[end]] + 1).tolist())}
            a, b, s, e = zip(*runs)
            none = len(runs)
            yield pa.record_batch([pa.nulls(none, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.bool_())], _NAMES)
        i = np.flatnonzero(first)
        begin = _starts(doc[i], at[i], route[i], twice[i])
        end = np.append(begin[1:], len(i))
        raw = h[i].tobytes()
        own = i[begin]
        a, b = zip(*[keys[d] for d in doc[own].tolist()])
        yield pa.record_batch([
            pa.array(route[own].view(np.int64)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(pos[own]), pa.array(pos[own] + end - begin),
            pa.array([raw[8 * s : 8 * e] for s, e in zip(begin.tolist(), end.tolist())], pa.binary()), pa.array(~twice[own]),
        ], _NAMES)

    def each(batches):
        own_filters, hot = sent.value
        keys, held, size = [], [], 0
        for batch in batches:
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), as_bytes(batch.column("text"))):
                for start, h, _, below, alive in climb(word_hashes(text), lengths, own_filters):
                    at = np.flatnonzero(alive)
                    route = h[at] if below is None else below[at]
                    if hot is not None:
                        route = np.where(hot.has(route), h[at], route)
                    held.append((h[at], route, np.full(len(at), len(keys)), at + start))
                    size += len(at)
                    if size >= HELD:
                        yield from settle([*keys, (a, b)], *map(np.concatenate, zip(*held)))
                        held, size = [], 0
                keys.append((a, b))
            if not held:
                keys = []
        if held:
            yield from settle(keys, *map(np.concatenate, zip(*held)))

    return texts.select("a", "b", "text").mapInArrow(tidy(each), _SENT)


def _met(batches):
    """Runs of open windows whose hash another stretch has too; rows come sorted by route."""

    def meet(b):
        raw, open_ = b.column("hashes"), np.asarray(b.column("open"))
        h = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        sizes = np.asarray(b.column("end")) - np.asarray(b.column("start"))
        _, place, n = np.unique(h, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.asarray(b.column("start")), sizes)
        i = np.flatnonzero((n[place] > 1) & open_[row])
        if not len(i):
            return None
        begin = _starts(row[i], pos[i] - np.arange(len(i)))
        end, own = np.append(begin[1:], len(i)) - 1, pa.array(row[i[begin]])
        return pa.record_batch([b.column("a").take(own), b.column("b").take(own), pa.array(pos[i[begin]]), pa.array(pos[i[end]] + 1)], ["a", "b", "start", "end"])

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        routes = np.asarray(b.column("route"))
        last = int(np.searchsorted(routes, routes[-1]))
        rest = b.slice(last)
        if last and (out := meet(b.slice(0, last))) is not None:
            yield out
    if rest is not None and (out := meet(rest)) is not None:
        yield out


def _keys(text: Column) -> tuple[Column, Column]:
    """A text's 128-bit hash in two parts, by which its copies are one."""
    return F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b")


def repeated_runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (a, b, start, end) for a table of (a, b, text): starts of windows from start to end, exclusive, that also start anywhere else. Runs may repeat and touch."""
    lengths, filters, counts = levels(length), [], None
    for _ in lengths[:-1]:
        counts = cut(_counted(texts, lengths, filters).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "windows")
        sieve = make_filter(counts)
        if sieve is None:  # no window lives on to the next length
            return texts.sparkSession.createDataFrame([], "a long, b long, start long, end long")
        filters.append(sieve)
    # windows whose route is frequent meet by their own hashes, and what meets in one place stays bounded
    heavy = make_filter(counts.where(F.col("n") > HEAVY)) if counts is not None else None
    sent = cut(_compared(texts, lengths, filters, heavy), "stretches")
    met = sent.where("route is not null").repartition("route").sortWithinPartitions("route").mapInArrow(tidy(_met), "a long, b long, start long, end long")
    return sent.where("route is null").select("a", "b", "start", "end").unionByName(met)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or the columns of them named in keep, with a column dedup: a struct of n_words, n_removed and kept, the words left joined by one space.

    A word goes if a window of so many consecutive words that holds it also starts anywhere else, in the same
    document or another; windows are judged on the texts as given. Words are what ASCII blanks part, unchanged. A null or empty
    text has no words and an empty kept. Repeated rows and copies lose all words where they have length of them or more, and
    none where they have fewer. Columns are kept whatever their names; one named dedup is replaced.
    An empty table gives an empty one.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "dedup"]
    text = named(text_col).cast("string")
    texts = docs.select(*_keys(text), text.alias("text")).where("text is not null")
    runs = repeated_runs(texts, length).distinct()
    spans = runs.groupBy("a", "b").agg(F.collect_list(F.struct("start", (F.col("end") + (length - 1)).alias("end"))).alias("spans"))
    # a text goes to the workers once: in its row, or beside it
    inside = text_col in kept and docs.schema[text_col].dataType == StringType()
    rows = docs.select(*_keys(text), F.struct(*[named(c) for c in kept]).alias("row"), *([] if inside else [text.alias("text")]))
    joined = rows.join(spans.select(loose("a"), loose("b"), F.col("spans.start").alias("start"), F.col("spans.end").alias("end")), ["a", "b"], "left")

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, made = b.slice(lo, 256), []
                texts = part.column("row").field(text_col) if inside else part.column("text")
                for t, starts, ends in zip(as_bytes(texts), part.column("start").to_pylist(), part.column("end").to_pylist()):
                    n = removed = 0
                    words = []
                    change = np.zeros(max(ends, default=0) + 1 if ends else 1, np.int32)
                    if starts:
                        np.add.at(change, starts, 1)
                        np.add.at(change, ends, -1)
                    gone = np.cumsum(change) > 0
                    for piece in word_lists(t):
                        own = gone[n : n + len(piece)]
                        if own.any():
                            words += [w for w, g in zip(piece, own.tolist()) if not g] + piece[len(own) :]
                        else:
                            words += piece
                        n += len(piece)
                    removed = n - len(words)
                    made.append((n, removed, b" ".join(words)))
                n, removed, left = zip(*made)
                left = pa.array(left, pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column("row"), pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), left], ["n_words", "n_removed", "kept"])], ["row", "dedup"])

    dedup = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("dedup", dedup)])
    return joined.drop("a", "b").mapInArrow(tidy(each), schema).select("row.*", "dedup")


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256)."""
    return made.select(named(id_col).alias("doc_id"), "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


ORACLE = r"""
    WITH split AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), windows AS (
        SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM split WHERE len(ws) >= 35)
    ), twice AS (
        SELECT md5(w) AS w FROM windows GROUP BY 1 HAVING count(*) > 1
    ), starts AS (
        SELECT doc_id, p FROM windows SEMI JOIN twice ON md5(windows.w) = twice.w
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM starts
    ), words AS (
        SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM split
    ), kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)
"""
