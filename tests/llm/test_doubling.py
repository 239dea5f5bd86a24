import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import doubling


def brute(rows, length=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(ws[i : i + length]) for ws in split for i in range(len(ws) - length + 1))
    out = []
    for (doc, _), ws in zip(rows, split):
        gone = set()
        for i in range(len(ws) - length + 1):
            if seen[tuple(ws[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "字", "W1"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (34, 35, 36, 50, 69, 70, 71, 140, 300)]
    rows = []
    for i in range(120):
        ws = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    for i in range(20):
        ws = rows[11][1].split() + text(150)
        ws[rng.randint(0, len(ws) - 1)] = "edit"
        rows.append((300 + i, " ".join(ws)))
    line = text(22)
    rows += [(400 + i, " ".join([*text(25), *line, *random.Random(i % 40).choices(vocab, k=14), f"x{i}", *text(10)])) for i in range(80)]
    rows += [(600, None), (601, ""), (602, " \n "), (603, "the " * 3000), (604, "a b " * 500 + "end"), (None, rows[7][1]), (None, None), (605, " ".join(text(40) * 2)), (606, " ".join(passages[3]).upper()), (607, "y " * 34), (608, "z " * 35), (609, "v " * 36)]
    rows += [(7, rows[7][1]), (7, " ".join(text(60)))]
    return rows


@pytest.mark.parametrize("held,heavy,chunk", [(1 << 20, 1 << 11, 1 << 18), (300, 3, 50)])
def test_like_brute_force(spark, monkeypatch, held, heavy, chunk):
    for name, x in (("HELD", held), ("HEAVY", heavy), ("CHUNK", chunk)):
        monkeypatch.setattr(doubling, name, x)
    rows = corpus()
    df = spark.createDataFrame([(i, t, {"k": 1}) for i, t in rows], "doc_id long, text string, row map<string,int>").repartition(5)
    made = doubling.remove_repeats(df)
    assert made.columns == ["doc_id", "text", "row", "dedup"]
    got = sorted(((r.doc_id, *r.dedup) for r in made.collect()), key=str)
    assert got == brute(rows)
    assert {r.row["k"] for r in made.collect()} == {1} and sorted(str(r.text) for r in made.collect()) == sorted(str(t) for _, t in rows)
    few = doubling.remove_repeats(df, keep=["doc_id"])
    assert few.columns == ["doc_id", "dedup"] and sorted(((r.doc_id, *r.dedup) for r in few.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("length", [1, 7, 12, 64])
def test_other_lengths(spark, length):
    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 5000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, *r.dedup) for r in doubling.remove_repeats(df, length).collect()), key=str) == brute(rows, length)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, a int, start int, dedup int")
    got = doubling.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "a", "start", "dedup"] and sorted(tuple(r.dedup) for r in got.collect()) == [(0, 0, ""), (3, 0, "a b c")]
    assert doubling.digest(doubling.remove_repeats(df.limit(0))).count() == 0
    assert doubling.digest(got).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_levels_double():
    assert doubling.levels(35) == [9, 18, 35] and doubling.levels(10) == [10] and doubling.levels(1) == [1]
    for n in range(1, 300):
        ls = doubling.levels(n)
        assert ls[-1] == n and all(a < b <= 2 * a for a, b in zip(ls, ls[1:]))


def test_hashes_tell_windows():
    words = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64) * np.uint64(0x1234567) + np.uint64(99)
    lengths = doubling.levels(35)
    h = doubling.base_hashes(words, lengths[0])
    for i, n in enumerate(lengths):
        h = doubling.doubled(h, lengths[i - 1], n) if i else h
        windows = [tuple(words[p : p + n]) for p in range(len(words) - n + 1)]
        assert len(h) == len(windows) and len(set(h.tolist())) == len(set(windows)) == len({(x, w) for x, w in zip(h.tolist(), windows)})


def test_looked_at_are_the_least_of_windows_alive():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, span = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        h = rng.integers(1, 8, n + span - 1).astype(np.uint64)
        least = doubling.running(h, span, np.minimum)
        assert least.tolist() == [h[p : p + span].min() for p in range(n)]
        alive = rng.random(n) < 0.5
        want = {i for p in range(n) if alive[p] for i in range(p, p + span) if h[i] == least[p]}
        assert set(np.flatnonzero(doubling.looked_at(h, least, alive)).tolist()) == want


def test_filter_holds_all(spark):
    h = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 5000)
    sieve = doubling.make_filter(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert sieve.has(h.view(np.uint64)).all() and sieve.has((h + 1).view(np.uint64)).mean() < 0.1
    assert doubling.make_filter(spark.range(0).select(F.col("id").alias("h"))) is None
