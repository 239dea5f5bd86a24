"""Language-model scores by subword lattices.

The pieces of an existing vocabulary span a lattice over each word; a log-space forward recursion
sums all its segmentations, weighted by the pieces' scores, and gives the word's marginal
probability. Vocabulary files rank their pieces by merges, not by use, so the scores are estimated
from the training documents by expectation-maximisation over the same lattices. No piece crosses
words, so a document's marginal is a sum over its words, and each distinct word is computed once.

A word that training saw also has an arc of its own across its whole lattice, with its frequency
less a discount; what the discounts free weights the segmentations. The score without such arcs,
of the pieces alone, stands beside it. Scores are kept for each class of training documents (their
language, say), and a text's probability is the mixture over classes, which takes nothing but the
text. Over all texts the probabilities sum to one at most.

Counts are gathered from all training documents. A bounded number of the most frequent words is
sent to all tasks; the others meet the documents that hold them in a join by word.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, many, words_of

#: Parts of the mixture at most, the least frequent classes together in the last; rounds of estimation; what each word's count is less by.
CLASSES, ROUNDS, DISCOUNT = 8, 3, 0.75
#: Most frequent words that every task knows.
FREQUENT = 1 << 17

#: Words of more bytes are scored on their own, in stretches of bounded memory, and teach in parts of so many bytes.
LONG = 2048
_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def vocabulary(path: str | None = None) -> list[bytes]:
    """The tokenizer's pieces as bytes, a word's leading mark as a blank, and all single bytes; pieces that cross words are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """Finds the pieces of words, and runs over all segmentations of a word at once."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        keys, lengths = np.zeros(self.n, np.uint64), np.array([len(p) for p in pieces])
        self.longest = int(lengths.max())
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            keys[at] = self._key(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, n))
        self._slot_key, self._slot = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -1, np.int32)
        self._deep, todo, at = -1, np.arange(self.n), self._at(keys)
        while len(todo):
            self._deep += 1
            free = todo[self._slot[at[todo]] < 0]
            own = free[np.unique(at[free], return_index=True)[1]]
            self._slot_key[at[own]], self._slot[at[own]] = keys[own], own
            todo = todo[~np.isin(todo, own)]
            at[todo] = (at[todo] + 1) % (1 << _BITS)

    @staticmethod
    def _key(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                h = h * _P + rows[:, j].astype(np.uint64) + np.uint64(1)
        return h

    @staticmethod
    def _at(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        ids = np.where(self._slot_key[at] == keys, self._slot[at], -1)
        for d in range(1, self._deep + 1):
            todo = np.flatnonzero((ids < 0) & (self._slot[at] >= 0))
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % (1 << _BITS)
            ids[todo] = np.where(self._slot_key[at[todo]] == keys[todo], self._slot[at[todo]], -1)
        return ids

    def arcs(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each piece length, the ids (word, start) of the pieces that begin there; -1 for none."""
        h = np.zeros(rows.shape, np.uint64)
        codes = rows.astype(np.uint64) + np.uint64(1)
        out = []
        with np.errstate(over="ignore"):
            for n in range(1, min(self.longest, rows.shape[1]) + 1):
                h = h[:, : rows.shape[1] - n + 1] * _P + codes[:, n - 1 :]
                out.append(self._find(h.ravel()).reshape(h.shape))
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        x = np.stack(terms)
        top = x.max(axis=0)
        return top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)).sum(axis=0))

    def forward(self, arcs: list[np.ndarray], score: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log probability (end, word) of all ways to each end, and the arcs' scores; score has one entry more, for id -1."""
        length = arcs[0].shape[1]
        s = [score[a] for a in arcs]
        alpha = np.zeros((length + 1, arcs[0].shape[0]))
        for t in range(1, length + 1):
            alpha[t] = self._sum([alpha[t - n] + s[n - 1][:, t - n] for n in range(1, min(t, len(s)) + 1)])
        return alpha, s

    def whole(self, word: bytes, score: np.ndarray) -> np.ndarray:
        """Log probability of one word, however long, in every class; score is (class, piece)."""
        text, m, step = np.frombuffer(b" " + word, np.uint8), self.longest, 4096
        kept = np.full((m + step, len(score)), -np.inf)
        kept[m - 1] = 0
        for lo in range(0, len(text), step):
            hi, begin = min(lo + step, len(text)), max(0, lo - m + 1)
            own = np.full((hi - lo, m, len(score)), -np.inf)
            for n, ids in enumerate(self.arcs(text[None, begin:hi]), 1):
                ends = begin + n + np.arange(ids.shape[1])
                use = ends > lo
                own[ends[use] - lo - 1, m - n] = score[:, ids[0, use]].T
            for j in range(hi - lo):
                x = kept[j : j + m] + own[j]
                top = x.max(axis=0)
                kept[m + j] = top + np.log(np.exp(x - top).sum(axis=0))
            kept[:m] = kept[hi - lo : hi - lo + m].copy()
        return kept[m - 1]

    def expected(self, arcs: list[np.ndarray], score: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected, over all segmentations of the words, each counted by its weight."""
        alpha, s = self.forward(arcs, score)
        length = len(alpha) - 1
        beta = np.zeros_like(alpha)
        for t in range(length - 1, -1, -1):
            beta[t] = self._sum([s[n - 1][:, t] + beta[t + n] for n in range(1, min(length - t, len(s)) + 1)])
        out = np.zeros(self.n + 1)
        for n, (ids, own) in enumerate(zip(arcs, s), 1):
            post = np.exp(alpha[: length - n + 1].T + own + beta[n:].T - alpha[-1][:, None]) * weight[:, None]
            np.add.at(out, ids.ravel(), post.ravel())
        return out[:-1]

    def by_length(self, words: list[bytes], block: int = 4096):
        """(positions, rows) of words of equal length, a blank before each."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts):
            size = max(1, min(block, 200_000 // (int(lengths[part[0]]) + 1))) if len(part) else 1
            for i in range(0, len(part), size):
                at = part[i : i + size]
                yield at, np.frombuffer(b"".join(b" " + words[j] for j in at), np.uint8).reshape(len(at), -1)


def _class_of(docs: DataFrame, train: Column, class_col: str | None, classes: int) -> tuple[Column, list[int]]:
    """Class numbers, and how many training documents each class has."""
    if class_col is None:
        return F.lit(0), [docs.where(train).count()]
    by = docs.where(train).groupBy(F.col(class_col).cast("string").alias("k")).count()
    top = by.where("k is not null").orderBy(F.desc("count"), "k").limit(classes - 1).collect()
    total = by.agg(F.sum("count")).first()[0] or 0
    names = {r.k: i for i, r in enumerate(top)}
    column = F.lit(len(names))
    for name, i in names.items():
        column = F.when(F.col(class_col).cast("string") == name, i).otherwise(column)
    return column, [*(r["count"] for r in top), total - sum(r["count"] for r in top)]


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """Rows (word, n0, n1, ...) over docs (text, cls, train): each word's count in every class of training documents, 0 where only others hold it."""

    def each(batches):
        for b in batches:
            held: dict[int, Counter] = {}
            for text, cls, train in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.setdefault(cls if train else -1, Counter()).update(words_of(text))
            for cls, counts in held.items():
                yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array([cls] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "cls", "n"])

    rows = docs.select("text", "cls", "train").mapInArrow(each, "word binary, cls int, n long")
    sums = [F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)]
    return rows.groupBy("word").agg(*sums)


def estimate(words: DataFrame, classes: int, pieces: list[bytes], rounds: int = ROUNDS) -> np.ndarray:
    """Log scores (class, piece) after so many rounds; every piece keeps a little."""
    spark = words.sparkSession
    scores = np.full((classes, len(pieces)), -math.log(len(pieces)))
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(scores)

        def each(batches):
            lattice = Lattice(pieces)
            own = np.column_stack([known.value, np.full(classes, -np.inf)])
            total = np.zeros((classes, len(pieces)))
            for b in many(batches):
                text = b.column(0).to_pylist()
                counts = np.stack([np.asarray(b.column(k + 1)) for k in range(classes)]).astype(np.float64)
                parts = [(w[i : i + LONG], j) for j, w in enumerate(text) if len(w) > LONG for i in range(0, len(w), LONG)]
                if parts:
                    short = [j for j, w in enumerate(text) if len(w) <= LONG]
                    counts = counts[:, short + [j for _, j in parts]]
                    text = [text[j] for j in short] + [p for p, _ in parts]
                for at, rows in lattice.by_length(text):
                    arcs = lattice.arcs(rows)
                    for k in range(classes):
                        has = counts[k, at] > 0
                        if has.any():
                            total[k] += lattice.expected([a[has] for a in arcs], own[k], counts[k, at[has]])
            yield pa.record_batch([pa.array(np.arange(len(pieces))), *map(pa.array, total)], ["piece", *(f"e{k}" for k in range(classes))])

        schema = "piece long, " + ", ".join(f"e{k} double" for k in range(classes))
        got = words.mapInArrow(each, schema).groupBy("piece").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(classes)]).collect()
        expected = np.zeros_like(scores)
        for r in got:
            expected[:, r.piece] = r[1:]
        expected += 1e-3
        scores = np.log(expected / expected.sum(axis=1, keepdims=True))
        known.unpersist()
    return scores


def _octave(n: Column) -> Column:
    """Sixteenths of the counts' powers of two."""
    return F.floor(F.log2(n + 1.0) * 16).cast("int")


def _frequent_from(words: DataFrame) -> int:
    """The least step of _octave from which on there are FREQUENT words at most; a histogram of counts tells, so that no task sorts the words."""
    steps = sorted(words.groupBy(_octave(F.col("n")).alias("o")).count().collect(), key=lambda r: -r.o)
    least, held = 1 << 30, 0
    for r in steps:
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.o
    return least


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, vocabulary_path: str | None = None, classes: int = CLASSES) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score), one for each row of docs.

    score has an arc across each word that training saw, lattice_score has the pieces' arcs only. The mixture has
    `classes` parts at most; all documents of further classes teach its last part together.
    train marks the rows to learn from (null: learn). A null or empty text is its end token alone; a null id stays
    null; repeated rows count and score each for itself; without training rows the lattice has uniform scores.
    An empty table gives an empty one; other columns are read only if they are named.
    """
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    cls, ends = _class_of(docs, F.coalesce(train, F.lit(True)), class_col, classes)
    used = [k for k, n in enumerate(ends) if n] or [0]
    ends = [ends[k] for k in used]
    number = F.coalesce(*[F.when(cls == k, F.lit(i)) for i, k in enumerate(used)], F.lit(0))
    kinds = len(used)
    own = docs.select(F.col(text_col).cast("string").alias("text"), number.alias("cls"), F.coalesce(train, F.lit(True)).alias("train"))
    words = cut(count_words(own, kinds), "words")
    sizes = words.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(kinds)], *[F.count_if(F.col(f"n{k}") > 0).alias(f"v{k}") for k in range(kinds)], F.count_if(sum((F.col(f"n{k}") for k in range(kinds)), F.lit(0)) > 0).alias("v")).first()
    seen = [(sizes[f"n{k}"] or 0) + ends[k] for k in range(kinds)]
    kept = [sizes[f"v{k}"] for k in range(kinds)]
    n_all, v_all = sum(seen), sizes["v"] + (sum(ends) > 0)
    scores = estimate(words, kinds, pieces) if sizes["v"] else np.full((kinds, len(pieces)), -math.log(len(pieces)))
    sent = spark.sparkContext.broadcast(np.column_stack([scores, np.full(kinds, -np.inf)]))

    def value(batches):
        lattice = Lattice(pieces)
        free = [math.log(1 - ends[k] / seen[k]) if seen[k] > ends[k] else 0.0 for k in range(kinds)]
        for b in many(batches):
            text = b.column(0).to_pylist()
            counts = np.stack([np.asarray(b.column(k + 1)) for k in range(kinds)]).astype(np.float64)
            out = np.empty((2 * kinds, len(text)))

            def put(k, at, pieced):
                out[kinds + k, at] = (pieced + free[k]) / math.log(10)
                if seen[k]:
                    with np.errstate(divide="ignore"):
                        pieced = np.logaddexp(np.log(np.maximum(counts[k, at] - DISCOUNT, 0)), math.log(DISCOUNT * max(kept[k], 1)) + pieced) - math.log(seen[k])
                out[k, at] = pieced / math.log(10)

            short = [j for j, w in enumerate(text) if len(w) <= LONG]
            for own, rows in lattice.by_length([text[j] for j in short]):
                at, arcs = np.array(short)[own], lattice.arcs(rows)
                for k in range(kinds):
                    put(k, at, lattice.forward(arcs, sent.value[k])[0][-1])
            for j, w in enumerate(text):
                if len(w) > LONG:
                    for k, pieced in enumerate(lattice.whole(w, sent.value)):
                        put(k, np.array([j]), np.array([pieced]))
            yield pa.record_batch([b.column(0), pa.array(counts.sum(axis=0).astype(np.int64)), *map(pa.array, out)], ["word", "n", *(f"s{k}" for k in range(2 * kinds))])

    doubles = ", ".join(f"s{k} double" for k in range(2 * kinds))
    valued = cut(words.mapInArrow(value, f"word binary, n long, {doubles}"), "valued")
    top = valued.where(_octave(F.col("n")) >= _frequent_from(valued)).toArrow()
    least = spark.sparkContext.broadcast((top.column(0).to_pylist(), np.column_stack([top.column(i + 1).to_numpy() for i in range(2 * kinds + 1)])))

    def texts(batches):
        names, table = least.value
        get = {w: i for i, w in enumerate(names)}.get
        first, rest = TaskContext.get().partitionId() << 40, len(names)
        with np.errstate(divide="ignore"):
            values = np.column_stack([np.log10(table[:, 0] + 0.5), table[:, 0] > 0, table[:, 1:]])
        values = np.vstack([values, np.zeros(values.shape[1])])
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("base", pa.float64()), ("known", pa.float64()), *((f"s{k}", pa.float64()) for k in range(2 * kinds))])
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                split = [words_of(t) for t in as_bytes(part.column(1))]
                row, ids = [], part.column(0).to_pylist()
                word, n, sums = [], [], []
                for j, ws in enumerate(split):
                    at = np.array([get(w, rest) for w in ws], np.int64)
                    row.append(first + j)
                    word.append(None)
                    n.append(len(ws))
                    sums.append(values[at].sum(axis=0))
                    rare = Counter(ws[x] for x in np.flatnonzero(at == rest))
                    row += [first + j] * len(rare)
                    word += rare
                    n += rare.values()
                    sums += [np.zeros(values.shape[1])] * len(rare)
                first += len(split)
                own = {r: i for r, i in zip(range(first - len(split), first), ids)}
                yield pa.record_batch([pa.array(row), pa.array([own[r] for r in row], pa.int64()), pa.array(word, pa.binary()), pa.array(n), *map(pa.array, np.array(sums).T)], schema=schema)

    found = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(texts, f"row long, id long, word binary, n long, base double, known double, {doubles}"), "found")
    by_row = found.where("word is null").select("row", "id", "n", "base", "known", *[f"s{k}" for k in range(2 * kinds)])
    rare = found.where("word is not null").select("row", "word", F.col("n").alias("tf")).join(valued, "word")
    tf = F.col("tf")
    rare = rare.groupBy("row").agg(F.sum(tf * F.log10(F.col("n") + 0.5)).alias("rb"), F.sum(F.when(F.col("n") > 0, tf).otherwise(0)).alias("rk"), *[F.sum(tf * F.col(f"s{k}")).alias(f"r{k}") for k in range(2 * kinds)])
    both = by_row.join(rare, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    less = math.log10(n_all + 0.5 * (v_all + 1))
    base = F.col("base") + zero("rb") + math.log10(sum(ends) + 0.5) - (F.col("n") + 1) * less
    total = max(sum(ends), 1)
    prior = [math.log10(max(ends[k], 1) / total) + (math.log10(ends[k] / seen[k]) if ends[k] else 0.0) for k in range(kinds)]

    def mixture(first: int) -> Column:
        parts = [F.col(f"s{first + k}") + zero(f"r{first + k}") + prior[k] for k in range(kinds)]
        best = F.greatest(*parts) if kinds > 1 else parts[0]
        return best + F.log10(sum((F.pow(F.lit(10.0), p - best) for p in parts), F.lit(0.0))) if kinds > 1 else best

    return both.select(
        F.col("id").alias("doc_id"), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + zero("rk") + int(sum(ends) > 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), mixture(0).alias("score"), mixture(kinds).alias("lattice_score"),
    )
