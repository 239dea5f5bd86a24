import math
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from quernstone.llm import lattice
from quernstone.llm.queries import QUERIES


def ways(word, score):
    """Probability of all segmentations, by trying them."""
    if not word:
        return 1.0
    return sum(math.exp(score[word[:n]]) * ways(word[n:], score) for n in range(1, len(word) + 1) if word[:n] in score)


def test_forward_sums_all_segmentations():
    pieces = sorted({b" ", b"a", b"b", b"c", b"ab", b" a", b"bc", b"abc", b" ab"})
    rng = np.random.default_rng(0)
    s = np.log(rng.dirichlet(np.ones(len(pieces))))
    score = dict(zip(pieces, s))
    lat = lattice.Lattice(pieces)
    words = [b"abcab", b"a", b"cc", b"bcabc", b"abcbc"]
    for at, rows in lat.by_length(words):
        alpha, _ = lat.forward(lat.arcs(rows), np.append(s, -np.inf))
        for j, got in zip(at, alpha[-1]):
            assert math.isclose(math.exp(got), ways(b" " + words[j], score))
    # expected counts are the slope of the log probability by each score
    [(at, rows)] = list(lat.by_length([b"abcab"]))
    e = lat.expected(lat.arcs(rows), np.append(s, -np.inf), np.ones(1))
    for i in range(len(pieces)):
        up = s.copy()
        up[i] += 1e-5
        slope = (math.log(ways(b" abcab", dict(zip(pieces, up)))) - math.log(ways(b" abcab", score))) / 1e-5
        assert abs(slope - e[i]) < 1e-3


def brute_base(rows, train):
    count, ends = Counter(), 0
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    for (i, ws) in split:
        if train(i):
            count.update(ws)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    less = math.log10(n + 0.5 * (v + 1))
    return sorted(((i, len(ws) + 1, sum(w in count for w in ws) + (ends > 0), n, sum(math.log10(count[w] + 0.5) - less for w in ws) + math.log10(ends + 0.5) - less) for i, ws in split), key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), want):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9), (g, w)


def test_base_like_brute_force_and_odd_rows(spark):
    old, lattice.FREQUENT = lattice.FREQUENT, 3
    rows = [(i, f"the cat{i % 5} sat ON the Mat{i} é{i}", "en") for i in range(60)] + [(None, "the", "en"), (100, None, None), (101, "", "x"), (102, " \t", "de"), (103, "q" * 50_000, "fr"), (7, "the cat", "en"), (7, "the cat", "en")]
    df = spark.createDataFrame([(i, t, c, 1) for i, t, c in rows], "doc_id long, text string, lang string, n long")
    try:
        got = [tuple(r) for r in lattice.score(df, F.col("doc_id") % 5 != 1, class_col="lang").collect()]
        same([g[:5] for g in got], brute_base([(i, t) for i, t, _ in rows], lambda i: i is None or i % 5 != 1))
        assert all(math.isfinite(x) and x <= 0 for g in got for x in g[5:])
        none = [tuple(r) for r in lattice.score(df, F.lit(False)).collect()]
        assert len(none) == len(rows) and all(g[2] == 0 and g[3] == 0 and math.isfinite(g[5]) for g in none)
        assert lattice.score(df.limit(0), F.lit(True)).count() == 0
    finally:
        lattice.FREQUENT = old


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, "a b a") for i in range(6)] + [(8, "")], "doc_id long, text string")
    texts = [""] + [" ".join(p) for n in range(1, 5) for p in __import__("itertools").product("ab", repeat=n)]
    ask = df.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], df.schema))
    got = {r.doc_id: r.score for r in lattice.score(ask, F.col("doc_id") < 100).collect()}
    total = sum(10 ** got[100 + i] for i in range(len(texts)))
    assert 0.5 < total <= 1


def splits(word, score):
    """(pieces, probability) of all segmentations."""
    if not word:
        return [((), 1.0)]
    return [((word[:n], *rest), math.exp(score[word[:n]]) * p) for n in range(1, len(word) + 1) if word[:n] in score for rest, p in splits(word[n:], score)]


def brute_scores(rows, pieces):
    """(score, lattice_score) of each text, by listing segmentations; rows are (text, class or None where held out)."""
    split = [(t.lower().split(), c) for t, c in rows]
    names = sorted({c for _, c in split if c is not None}, key=lambda c: (-sum(x == c for _, x in split), c))
    models = []
    for name in names:
        counts, ends = Counter(), 0
        for ws, c in split:
            if c == name:
                counts.update(ws)
                ends += 1
        score = {p: -math.log(len(pieces)) for p in pieces}
        for _ in range(lattice.ROUNDS):
            use = dict.fromkeys(pieces, 1e-3)
            for w, n in counts.items():
                every = splits(" " + w, score)
                whole = sum(p for _, p in every)
                for ps, p in every:
                    for x in ps:
                        use[x] += n * p / whole
            score = {p: math.log(u / sum(use.values())) for p, u in use.items()}
        models.append((counts, ends, score))
    out = []
    for ws, _ in split:
        both = [0.0, 0.0]
        for counts, ends, score in models:
            n = sum(counts.values()) + ends
            arc = pieced = ends / n * ends / sum(m[1] for m in models)
            for w in ws:
                lat = sum(p for _, p in splits(" " + w, score))
                arc *= (max(counts[w] - lattice.DISCOUNT, 0) + lattice.DISCOUNT * len(counts) * lat) / n
                pieced *= lat * (1 - ends / n)
            both = [both[0] + arc, both[1] + pieced]
        out.append([math.log10(x) for x in both])
    return out


def test_score_like_brute_force(spark, monkeypatch):
    pieces = sorted([" ", "a", "b", "c", "ab", " a", "bc", "abc", " ab"])
    monkeypatch.setattr(lattice, "vocabulary", lambda path=None: [p.encode() for p in pieces])
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 5), p=(0.5, 0.3, 0.2) if i % 2 else (0.2, 0.2, 0.6))) for _ in range(rng.integers(0, 7))) for i in range(40)]
    rows = [(t, ("en" if i % 2 else "de") if i % 4 < 3 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, c or "en", c is not None) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string, learn boolean")
    got = {r.doc_id: r for r in lattice.score(df, F.col("learn"), class_col="lang").collect()}
    for i, (score, pieced) in enumerate(brute_scores(rows, pieces)):
        assert math.isclose(got[i].score, score, rel_tol=1e-9) and math.isclose(got[i].lattice_score, pieced, rel_tol=1e-9), i


def test_long_words_have_the_same_probability():
    lat = lattice.Lattice(pieces := lattice.vocabulary())
    rng = np.random.default_rng(6)
    score = np.log(rng.dirichlet(np.ones(len(pieces)), 2))
    score = np.column_stack([score, np.full(2, -np.inf)])
    for word in (b"a", b"understanding" * 3, bytes(rng.integers(97, 101, 9000).tolist())):
        [(_, rows)] = list(lat.by_length([word]))
        arcs = lat.arcs(rows)
        want = [lat.forward(arcs, s)[0][-1][0] for s in score]
        assert np.allclose(lat.whole(word, score), want, rtol=1e-9)


def test_query(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_lattice_score"](spark, d).collect()
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute_base(rows, lambda i: crc(i) != 1))
    assert all(r.held_out == (crc(r.doc_id) == 1) for r in got)
    ours, base, pieced = (sum(x) for x in zip(*((r.score, r.base_score, r.lattice_score) for r in got if r.held_out)))
    print(ours, base, pieced)
    # the base gives every unknown word the same share, so that its probabilities sum to more than one
    assert ours > 1.02 * base
