"""Ranked lexical search as a blocked sparse matrix product.

The items are the rows of one sparse matrix, item by term, holding how often an item has a term.
The documents are another, term by document, holding a term's impact on a document as a 64-bit
integer. The product's row of an item is made after Gustavson: the rows of the item's terms, each
times its multiplicity, are merged into one row of scores. Documents are multiplied in blocks, each
block leaves an item its best k, and these are reduced to the best k of all.

One scan takes the texts apart and writes the documents' rows of counts, of the items' terms only. Totals
and document frequencies are sums over that narrow table, and so are the blocks. Items come in blocks too,
each small enough to be sent to all tasks; more items mean more products, not larger ones.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, many, named, tidy

K = 20
#: Bytes of item texts in a block; documents multiplied at once; bytes of a text taken apart at once.
ITEM_BYTES, BLOCK, PIECE = 1 << 24, 1 << 14, 1 << 20
#: Parts that an item's best rows are reduced in before the last step.
PARTS = 16
_NO_ID = (1 << 63) - 1
#: ASCII letters in lower case, digits and all bytes of other signs as they are; the rest of ASCII is blank.
_TERMS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(128)).lower() + bytes(range(128, 256))


def pieces_of(text: bytes | None):
    """Lists of the text's terms, in order, from pieces that end between terms."""
    if not text:
        return
    flat, at = text.translate(_TERMS), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _item_blocks(items: DataFrame, item_id: str, text: str):
    """Blocks of items as (ids, counters of terms), by a hash of the item, of about ITEM_BYTES each."""
    own = items.select(named(item_id).alias("id"), named(text).cast("string").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-(size[0] + 64 * size[1]) // ITEM_BYTES))
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        table = part.toArrow()
        yield table.column("id"), [sum((Counter(p) for p in pieces_of(t)), Counter()) for t in as_bytes(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))]


_COUNTS = "id long, n long, terms array<int>, tfs array<long>"


def _counts(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows (id, n, terms, tfs): a document's number of terms, and those that the vocabulary has with their counts, in its order."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches):
        get = sent.value.get
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part, ns, found, tfs = b.slice(lo, 1024), [], [], []
                for t in as_bytes(part.column(1)):
                    n, seen = 0, []
                    for terms in pieces_of(t):
                        n += len(terms)
                        at = np.fromiter(map(get, terms, repeat(-1)), np.int32, len(terms))
                        seen.append(np.unique(at[at >= 0], return_counts=True))
                    if len(seen) == 1:
                        own, tf = seen[0]
                    elif seen:
                        own, place = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
                        tf = np.zeros(len(own), np.int64)
                        np.add.at(tf, place, np.concatenate([x[1] for x in seen]))
                    else:
                        own, tf = np.empty(0, np.int32), np.empty(0, np.int64)
                    ns.append(n)
                    found.append(own)
                    tfs.append(tf)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (found, tfs))
                yield pa.record_batch([part.column(0), pa.array(ns, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return texts.mapInArrow(tidy(each), _COUNTS)


def _frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Number of documents of each term of the vocabulary."""

    def summed(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], ["term", "df"])

    got = counts.select("terms").mapInArrow(tidy(summed), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Block:
    """Documents as a term by document matrix: of each term the columns that have it, and its impacts there."""

    def __init__(self, terms: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int):
        order = np.argsort(terms, kind="stable")
        self.columns, self.values = columns[order], values[order]
        self.starts = np.searchsorted(terms[order], np.arange(size + 1))

    def row(self, terms: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
        """Gustavson's merge: the rows of the terms, each so many times, added up. A row has a column once, so adding by index loses nothing."""
        for s, e, x in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist(), times.tolist()):
            if s < e:
                out[self.columns[s:e]] += x * self.values[s:e]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores first, then smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _product(counts: DataFrame, matrix: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """Rows (item, doc_id, score): of each task the best k of each row of the product."""
    sent = counts.sparkSession.sparkContext.broadcast((matrix, w))

    def multiplied(batches):
        rows, weight = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in rows]
        for b in many(batches, BLOCK):
            ids = np.asarray(b.column(0).fill_null(_NO_ID))
            m = np.array([75 + (25 * n * docs) // length for n in b.column(1).to_pylist()], np.int64)
            times = np.diff(np.asarray(b.column(2).offsets))
            columns, terms = np.repeat(np.arange(len(ids)), times), b.column(2).flatten().to_numpy()
            block = Block(terms, columns, impacts(weight[terms], b.column(3).flatten().to_numpy(), m[columns]), len(weight))
            out = np.zeros(len(ids), np.int64)
            for i, (own, multiplicity) in enumerate(rows):
                out[:] = 0
                block.row(own, multiplicity, out)
                known_ids, known = held[i]
                at = np.flatnonzero(out > 0 if len(known) < k else out >= known[-1])
                if len(at):
                    all_ids, all_scores = np.concatenate([known_ids, ids[at]]), np.concatenate([known, out[at]])
                    top = best(all_ids, all_scores, k)
                    held[i] = all_ids[top], all_scores[top]
        item = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x[0]) for x in held])
        ids, scores = (np.concatenate([np.empty(0, np.int64), *[x[j] for x in held]]) for j in (0, 1))
        yield pa.record_batch([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return counts.mapInArrow(tidy(multiplied), "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k best documents with a score above 0, fewer where there are fewer.

    Terms are runs of ASCII letters and digits and signs beyond ASCII, in ASCII lower case, of whole texts. Equal scores rank
    by ascending id, a null id last. Null and empty texts have no terms: such documents count nowhere, such items find nothing. Each
    row of docs is a document and each row of items an item, so repeated ones rank each for itself. An
    empty table on either side gives an empty one. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    kind = items.select(named(item_id).alias("item_id")).schema["item_id"]
    out = None
    for ids, counted in _item_blocks(items, item_id, item_text):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        counts = cut(_counts(texts, vocabulary), "counts")
        total = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        w = weights(total[0], _frequencies(counts, len(vocabulary)))
        # a term of weight 0 adds nothing
        rows = []
        for c in counted:
            own = np.array(sorted((vocabulary[t], x) for t, x in c.items()), np.int64).reshape(-1, 2)
            own = own[w[own[:, 0]] > 0]
            rows.append((own[:, 0], own[:, 1]))
        found = _product(counts.where("size(terms) > 0"), rows, w, total[0], total[1], k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
        found = found.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        named_items = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": ids}))
        named_items = named_items.select("item", F.col("item_id").cast(kind.dataType).alias("item_id"))
        # the names are those of one block of items, whose size is bounded
        got = found.join(F.broadcast(named_items), "item").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out


ORACLE = r"""
    WITH own AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
    ), sizes AS (
        SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM own WHERE len(terms) > 0
    ), total AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes
    ), counts AS (
        SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY ALL
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, docs
    ), impacts AS (
        SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // length)))) AS impact FROM counts JOIN weights USING (term), total
    ), asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ) GROUP BY ALL
    ), scored AS (
        SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(times * impact) > 0
    ), ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 20
"""
