import random
import zlib

import numpy as np

from quernstone.llm import toxicity
from quernstone.llm.queries import QUERIES


def test_gradients_are_the_slopes():
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    vocab = [b".", b"aa", b"bcd", b"e"]
    args = (toxicity.word_ids(vocab), [[1, 2, 3, 1], [2, 2], [3]], np.array([0, 0, 1]), np.array([1.0, 0.0]), np.array([0.5, 0.5]))

    def loss():
        table = toxicity.project(m, toxicity.inputs(m, args[0])[0])
        at, lengths = toxicity._frame(args[1])
        z = toxicity.logits(m, table, at, lengths)
        z = np.array([max(z[0], z[1]), z[2]])
        return float((0.5 * (np.log1p(np.exp(z)) - args[3] * z)).sum())

    g = toxicity._gradients(m, *args)
    rng = np.random.default_rng(1)
    for k in m:
        at = tuple(np.array(np.nonzero(g[k])).T[rng.integers(np.count_nonzero(g[k]))])
        old = m[k][at]
        m[k][at] = old + 1e-3
        up = loss()
        m[k][at] = old - 1e-3
        down = loss()
        m[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4 + 0.02 * abs(g[k][at]), k


def test_windows_cover_and_overlap():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        w = toxicity.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b[0] < a[1] for a, b in zip(w, w[1:]))


def rows(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        ws = [rng.choice(["the", "ren", "osti", "and", "ilo", "mer"]) + rng.choice(["", "a", "en"]) for _ in range(rng.randint(5, 300))]
        toxic = i % 3 == 0
        for _ in range(max(2, len(ws) // 40) if toxic else 0):
            ws.insert(rng.randint(0, len(ws)), rng.choice(["vilefool", "dreckig,", "Brute!"]))
        out.append((i, " ".join(ws), int(toxic)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows(700)
    df = spark.createDataFrame([(i, t, 9) for i, t, _ in data] + [(None, "x", 1), (9001, None, 1), (9002, "", 1), (9003, "z" * 100_000, 1)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 500] + [(9001, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == 704 and all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002]
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in data if i >= 500]
    assert sum(held) / len(held) > 0.95
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_score_like_brute_force():
    """Every window of a text by the formulas, one word and one gate at a time."""
    rng = np.random.default_rng(5)
    m = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in toxicity.new_model().items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    H = toxicity.HIDDEN

    def word(w):
        code = lambda t: ((((t[0] << 16) | (t[1] << 8) | t[2]) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 40) % toxicity.TRIGRAM_BUCKETS
        own = b"<" + w + b">"
        return np.concatenate([m["word"][zlib.crc32(w) % toxicity.WORD_BUCKETS], np.mean([m["trigram"][code(own[i : i + 3])] for i in range(len(w))], axis=0)])

    def direction(d, xs):
        h, out = np.zeros(H), []
        for x in xs:
            p, u = x @ m[f"x_{d}"] + m[f"b_{d}"], h @ m[f"h_{d}"]
            z, r = sig(p[:H] + u[:H]), sig(p[H : 2 * H] + u[H : 2 * H])
            n = np.tanh(p[2 * H :] + r * u[2 * H :])
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    def window(ws):
        xs = [word(w) for w in ws]
        states = np.concatenate([direction("f", xs), direction("b", xs[::-1])[::-1]], axis=1)
        a = np.exp(np.tanh(states @ m["att"] + m["att_b"]) @ m["att_v"])
        return (a / a.sum()) @ states @ m["out"] + m["out_b"][0]

    texts = [" ".join(rng.choice(["ab", "cde", "Fool!", "été", "z"], n)) for n in (1, 5, 64, 65, 200)]
    want = []
    for t in texts:
        ws = toxicity.words(t.encode())
        starts = range(0, max(len(ws) - 16, 1), 48)
        want.append(max(sig(window(ws[s : s + 64])) for s in starts))
    got = toxicity.Scorer({k: v.astype(np.float32) for k, v in m.items()}).scores([t.encode() for t in texts])
    assert np.allclose(got, want, atol=1e-4)


def test_lessons_are_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, "w " * (10 * i)) for i in range(1, 40)] + [(3, "other text")] * 50 + [(50, "x " * 90_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(50, 1), (3, 1)], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")
    assert len(every) == 40 and max(len(ws) for ws, _ in every) == 90_000
    few = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", rows=8, chars=2000)
    assert len(few) <= 16 and all(sum(2 * len(ws) for ws, y in few if y == c) <= 2000 for c in (0, 1)) and few


def test_query(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = QUERIES["op10_toxicity"](spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    print(len(held), sum(a == b for a, b in held))
    assert sum(a == b for a, b in held) / len(held) > 0.85
