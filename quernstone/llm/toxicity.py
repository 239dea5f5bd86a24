"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the mean of its hashed character-trigram
vectors, each with its own table, side by side. Two gated recurrent layers read a window of words
from either end, attention pools their states, and a logistic unit scores the window. All
overlapping windows of a whole text are scored and the highest counts. Training, in numpy on the
driver, scores all windows of each sampled document too and goes back through the highest one; the
threshold is set on the same whole texts.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, tidy

WINDOW, STRIDE = 64, 48
WORD_BUCKETS, TRIGRAM_BUCKETS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 1 << 13, 12, 8, 8
#: Labelled rows that training takes of either class, and characters that these have together at most.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 30_000_000
EPOCHS, BATCH, RATE, SEED = 6, 100, 0.02, 7
#: Words that a worker remembers the inputs of.
MEMO = 1 << 16
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACED).split() if text else []


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows over n words; one empty window where there is no word."""
    return [(s, min(s + WINDOW, n)) for s in range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)]


def word_ids(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, all trigram buckets in a row, and where each word's trigrams begin."""
    buckets = np.array([crc32(w) % WORD_BUCKETS for w in vocab], np.int64)
    lengths = np.array([len(w) for w in vocab], np.int64)
    joined = np.frombuffer(b"".join(b"<%b>" % w for w in vocab), np.uint8).astype(np.uint64)
    codes = (joined[:-2] << np.uint64(16)) | (joined[1:-1] << np.uint64(8)) | joined[2:]
    buckets_of = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(TRIGRAM_BUCKETS)
    begins = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    keep = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return buckets, buckets_of[keep].astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def new_model() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
    m = {"word": draw(WORD_BUCKETS, WIDTH), "trigram": draw(TRIGRAM_BUCKETS, WIDTH), "att": draw(2 * HIDDEN, ATTENTION, scale=0.3), "att_b": draw(ATTENTION, scale=0), "att_v": draw(ATTENTION, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "out_b": draw(1, scale=0)}
    for d in "fb":
        m |= {f"x_{d}": draw(2 * WIDTH, 3 * HIDDEN, scale=0.25), f"h_{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"b_{d}": draw(3 * HIDDEN, scale=0)}
    return m


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def inputs(m: dict, ids: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, numbers of trigrams) of the words that word_ids gave."""
    lengths = np.diff(np.append(ids[2], len(ids[1])))
    chars = np.add.reduceat(m["trigram"][ids[1]], ids[2], axis=0) / lengths[:, None].astype(np.float32)
    return np.concatenate([m["word"][ids[0]], chars], axis=1), lengths


def _run(m: dict, d: str, projected: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction; projected is (time, window, 3 * HIDDEN)."""
    steps = range(len(projected)) if d == "f" else range(len(projected) - 1, -1, -1)
    h = np.zeros((projected.shape[1], HIDDEN), np.float32)
    out = np.empty((*projected.shape[:2], HIDDEN), np.float32)
    u = m[f"h_{d}"]
    for t in steps:
        hu = h @ u
        zr = _sigmoid(projected[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(projected[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        k = (1 - z) * mask[t]
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :], k))
        h = h + k * (n - h)
        out[t] = h
    return out


def _pool(m: dict, states: np.ndarray, mask: np.ndarray):
    u = np.tanh(states @ m["att"] + m["att_b"])
    s = np.where(mask[:, :, 0] > 0, u @ m["att_v"], np.float32(-1e30))
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    c = np.einsum("tw,twh->wh", a, states)
    return c @ m["out"] + m["out_b"][0], (u, a, c)


def logits(m: dict, table: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Window logits; table holds each word's projected inputs of both directions, at is (time, window)."""
    mask = (np.arange(len(at))[:, None] < lengths[None, :]).astype(np.float32)[:, :, None]
    p = table[at]
    states = np.concatenate([_run(m, "f", p[:, :, : 3 * HIDDEN], mask, None), _run(m, "b", p[:, :, 3 * HIDDEN :], mask, None)], axis=2)
    return _pool(m, states, mask)[0]


def project(m: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ m["x_f"] + m["b_f"], x @ m["x_b"] + m["b_b"]], axis=1)


def _frame(groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(g) for g in groups], np.int64)
    at = np.zeros((max(int(lengths.max()), 1), len(groups)), np.int64)
    at[np.arange(len(at))[:, None] < lengths[None, :]] = [g[t] for t in range(len(at)) for g in groups if t < len(g)]
    return at, lengths


def peaks(m: dict, table: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The highest window logit of each text, whose words are rows of table, and where that window lies."""
    where = [(d, s, e) for d, ids in enumerate(texts) for s, e in windows(len(ids))]
    where.sort(key=lambda w: w[2] - w[1])
    best, place = np.full(len(texts), -np.inf), [(0, 0)] * len(texts)
    for i in range(0, len(where), 512):
        part = where[i : i + 512]
        lengths = np.array([e - s for _, s, e in part], np.int64)
        at = np.zeros((max(int(lengths.max()), 1), len(part)), np.int64)
        for j, (d, s, e) in enumerate(part):
            at[: e - s, j] = texts[d][s:e]
        for (d, s, e), z in zip(part, logits(m, table, at, lengths).tolist()):
            if z > best[d]:
                best[d], place[d] = z, (s, e)
    return best, place


def _gradients(m: dict, ids: tuple, groups: list[list[int]], owner: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
    (wid, tid, _), (x, tlen) = ids, inputs(m, ids)
    table = project(m, x)
    at, lengths = _frame(groups)
    mask = (np.arange(len(at))[:, None] < lengths[None, :]).astype(np.float32)[:, :, None]
    p = table[at]
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_run(m, d, p[:, :, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN], mask, kept[d]) for i, d in enumerate("fb")], axis=2)
    logit, (u, a, c) = _pool(m, states, mask)
    g = {}
    dl = np.zeros(len(logit), np.float32)
    for doc in range(len(labels)):
        own = np.flatnonzero(owner == doc)
        best = own[np.argmax(logit[own])]
        dl[best] = (_sigmoid(logit[best]) - labels[doc]) * weights[doc]
    g["out"], g["out_b"] = dl @ c, dl.sum(keepdims=True)
    dc = dl[:, None] * m["out"]
    da = np.einsum("wh,twh->tw", dc, states)
    ds = a * (da - (a * da).sum(axis=0))
    du = ds[:, :, None] * m["att_v"] * (1 - u * u)
    g["att_v"] = np.einsum("tw,twk->k", ds, u)
    g["att"], g["att_b"] = np.einsum("twh,twk->hk", states, du), du.sum(axis=(0, 1))
    dstates = a[:, :, None] * dc + du @ m["att"].T
    dp = np.zeros_like(p)
    for i, d in enumerate("fb"):
        uh = m[f"h_{d}"]
        dh = np.zeros((len(groups), HIDDEN), np.float32)
        dU = np.zeros_like(uh)
        for t, h, z, r, n, hn, k in reversed(kept[d]):
            dh = dh + dstates[t, :, i * HIDDEN : (i + 1) * HIDDEN]
            dn = dh * k * (1 - n * n)
            dz = -dh * (n - h) * mask[t] * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            gate = np.concatenate([dz, dr, dn], axis=1)
            dp[t, :, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN] = gate
            hid = np.concatenate([dz, dr, dn * r], axis=1)
            dU += h.T @ hid
            dh = dh * (1 - k) + hid @ uh.T
        g[f"h_{d}"] = dU
    dt = np.zeros_like(table)
    np.add.at(dt, at.ravel(), (dp * mask).reshape(-1, dp.shape[2]))
    dx = np.zeros_like(x)
    for i, d in enumerate("fb"):
        part = dt[:, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN]
        g[f"x_{d}"], g[f"b_{d}"] = x.T @ part, part.sum(axis=0)
        dx += part @ m[f"x_{d}"].T
    g["word"], g["trigram"] = np.zeros_like(m["word"]), np.zeros_like(m["trigram"])
    np.add.at(g["word"], wid, dx[:, :WIDTH])
    np.add.at(g["trigram"], tid, np.repeat(dx[:, WIDTH:] / tlen[:, None].astype(np.float32), tlen, axis=0))
    return g


class Lesson:
    """Training texts as places in a list of their distinct words, whose buckets are computed once."""

    def __init__(self, docs: list[tuple[list[bytes], int]]):
        at: dict[bytes, int] = {b".": 0}
        self.texts = [np.fromiter((at.setdefault(w, len(at)) for w in ws), np.int32, len(ws)) for ws, _ in docs]
        self.labels = np.array([y for _, y in docs], np.int64)
        self._ids = word_ids(list(at))

    def part(self, rows: np.ndarray) -> tuple[tuple, list[np.ndarray]]:
        """The word ids of some texts, and these with their words as places in them."""
        own = [self.texts[i] for i in rows]
        used, at = np.unique(np.concatenate([[0], *own]).astype(np.int64), return_inverse=True)
        wid, tid, tat = self._ids
        lengths = np.diff(np.append(tat, len(tid)))[used]
        begin = np.cumsum(lengths) - lengths
        ids = wid[used], tid[np.repeat(tat[used] - begin, lengths) + np.arange(lengths.sum())], begin
        return ids, np.split(at[1:], np.cumsum([len(x) for x in own])[:-1])


def train(docs: list[tuple[list[bytes], int]]) -> dict[str, np.ndarray]:
    """A model from (words, label) rows; without rows of both classes it scores all texts below one half."""
    m = new_model()
    positive = sum(y for _, y in docs)
    if not 0 < positive < len(docs):
        m["out"][:] = 0
        m["out_b"][:] = -1
        return m
    lesson = Lesson(docs)
    balance = np.array([len(docs) / 2 / (len(docs) - positive), len(docs) / 2 / positive])
    rng = np.random.default_rng(SEED)
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    step, total = 0, max(60, EPOCHS * -(-len(docs) // BATCH))
    while step < total:
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), BATCH):
            rows = order[i : i + BATCH]
            ids, texts = lesson.part(rows)
            place = peaks(m, project(m, inputs(m, ids)[0]), texts)[1]
            groups = [t[s:e].tolist() for t, (s, e) in zip(texts, place)]
            labels = lesson.labels[rows]
            g = _gradients(m, ids, groups, np.arange(len(rows)), labels.astype(np.float32), (balance[labels] / len(rows)).astype(np.float32))
            step += 1
            rate = RATE * min(1, 2 * (1 - (step - 1) / total))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                m[k] -= (rate / (1 - 0.9**step) * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if step == total:
                break
    return _centred(m, lesson)


def _centred(m: dict, lesson: Lesson) -> dict[str, np.ndarray]:
    """Moves the output so that one half lies midway between the classes: between the documents of either that come nearest to the other, but for a few."""
    every = []
    for i in range(0, len(lesson.texts), 256):
        ids, texts = lesson.part(np.arange(i, min(i + 256, len(lesson.texts))))
        every.append(peaks(m, project(m, inputs(m, ids)[0]), texts)[0])
    best = np.concatenate(every)
    bad, good = best[lesson.labels == 1], best[lesson.labels == 0]
    low, high = np.quantile(bad, 0.01), np.quantile(good, 0.999)
    if low <= high:
        marks = np.unique(np.quantile(best, np.linspace(0, 1, 400)))
        wrong = [np.mean(bad < c) + np.mean(good >= c) for c in marks]
        low = high = marks[int(np.argmin(wrong))]
    return m | {"out_b": m["out_b"] - np.float32((low + high) / 2)}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[list[bytes], int]]:
    """(words, label) of at most `rows` rows of either class: those with the lowest hashes, as long as they have `chars` characters together.

    Texts are whole. A row that would go beyond the characters is passed over, the next ones are not. An id labelled
    more than once counts as toxic if any of its labels is; of rows that repeat an id one teaches, the text with the
    lowest hash; null ids, labels and texts teach nothing.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = known.groupBy((F.col("y") > 0).cast("int").alias("c")).count().collect()
    lowest = None
    for c in (0, 1):
        there = sum(r["count"] for r in sizes if r.c == c)
        share = min(1 << 20, (3 * rows << 20) // (2 * there) + 1) if there else 0  # thinned by hash first, so that few rows are sorted
        part = known.where(((F.col("y") > 0).cast("int") == c) & F.col("id").isNotNull() & (F.shiftrightunsigned(F.xxhash64("id"), 44) < share))
        part = part.orderBy(F.xxhash64("id"), "id").limit(rows)
        lowest = part if lowest is None else lowest.unionByName(part)
    taken = own.where("text is not null").join(F.broadcast(lowest), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    taken = cut(taken.select("id", "y", F.col("t.text").alias("text"), F.length("t.text").cast("long").alias("n")), "lesson")
    held, use = {0: 0, 1: 0}, []
    for r in taken.select("id", "y", "n", F.xxhash64("id").alias("h")).orderBy("h", "id").collect():
        c = int(r.y > 0)
        if held[c] + r.n <= chars:
            held[c] += r.n
            use.append((r.id, c))
    fits = docs.sparkSession.createDataFrame(use, "id long, c int")
    got = taken.join(F.broadcast(fits), "id").select("id", "c", "text").toArrow()
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    label, text = got.column(1).to_numpy(), as_bytes(got.column(2).combine_chunks())
    return [(words(text[i]), int(label[i])) for i in order]


class Scorer:
    """Scores whole texts; remembers the projected inputs of words."""

    def __init__(self, model: dict):
        self._m = model
        self._clear()

    def _clear(self) -> None:
        self._at: dict[bytes, int] = {}
        self._table = np.empty((0, 6 * HIDDEN), np.float32)
        self._used = 0

    def _learn(self, new: list[bytes]) -> None:
        if self._used + len(new) > len(self._table):
            grown = np.empty((max(2 * len(self._table), self._used + len(new), 4096), 6 * HIDDEN), np.float32)
            grown[: self._used] = self._table[: self._used]
            self._table = grown
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            self._table[self._used : self._used + len(part)] = project(self._m, inputs(self._m, word_ids(part))[0])
            self._at.update(zip(part, range(self._used, self._used + len(part))))
            self._used += len(part)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return _sigmoid(self.logits_of(texts))

    def logits_of(self, texts: list[bytes | None]) -> np.ndarray:
        """The highest window logit of each text."""
        split = [words(t) for t in texts]
        every = set().union(*split)
        if len(self._at) + len(every) > MEMO:
            self._clear()
        self._learn(list(every.difference(self._at)))
        if not self._used:
            self._learn([b"."])
        get = self._at.__getitem__
        flat = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in split]
        return peaks(self._m, self._table, flat)[0]


def _scored(model: dict, batches, text_at: int):
    scorer = Scorer(model)
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield part, scorer.scores(as_bytes(part.column(text_at)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, np.ndarray]:
    return train(training_rows(docs, labels, id_col, text_col, label_col))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of docs.

    Null and empty texts have one empty window and its score; a null id stays null; repeated rows
    score alike; an empty table gives an empty one; other columns are not read.
    """

    def each(batches):
        for part, s in _scored(model, batches, 1):
            yield pa.record_batch([part.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def each(batches):
        for part, s in _scored(model, batches, at):
            yield part.filter(pa.array(s < threshold))

    return docs.mapInArrow(tidy(each), docs.schema)
