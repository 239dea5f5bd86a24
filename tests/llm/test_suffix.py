import random
from collections import defaultdict

import numpy as np

from quernstone.llm import suffix


def brute(rows):
    """For each row the set of words in passages of LEAST words that another row has."""
    seen = defaultdict(set)
    split = [(t or "").encode().lower().split() for _, t in rows]
    for r, ws in enumerate(split):
        for i in range(len(ws) - suffix.LEAST + 1):
            seen[tuple(ws[i : i + suffix.LEAST])].add(r)
    out = []
    for r, ws in enumerate(split):
        own = set()
        for i in range(len(ws) - suffix.LEAST + 1):
            if len(seen[tuple(ws[i : i + suffix.LEAST])]) > 1:
                own.update(range(i, i + suffix.LEAST))
        out.append(own)
    return out


def test_anchors_leave_no_window_without():
    rng = np.random.default_rng(0)
    for g in (rng.integers(0, 1 << 60, 3000).astype(np.uint64), rng.integers(0, 4, 3000).astype(np.uint64), np.zeros(500, np.uint64)):
        p = suffix.anchors(g)
        kept = np.zeros(len(g), bool)
        kept[p] = True
        for i in range(len(g) - suffix.WINDOW + 1):
            w = g[i : i + suffix.WINDOW]
            assert (kept[i : i + suffix.WINDOW] & (w == w.min())).any()


def test_grams_tell_contents():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    g = suffix.grams(np.concatenate([h, h]))
    assert len(g) == 400 - suffix.GRAM + 1 and (g[: 200 - suffix.GRAM + 1] == suffix.grams(h)).all() and g[0] == g[200] and len(np.unique(g)) == 200


def test_like_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (50, 51, 60, 74, 99, 120, 49)]
    rows = []
    for i in range(150):
        ws = text(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        rows.append((i, " ".join(ws)))
    rows += [(200 + i, rows[7][1].upper()) for i in range(30)]
    for i in range(20):
        ws = rows[11][1].split() + text(120)
        ws[rng.randint(0, len(ws) - 1)] = "edit"
        rows.append((300 + i, "\n".join(ws)))
    hot = text(80)
    rows += [(400 + i, " ".join(text(20) + hot + text(20))) for i in range(60)]
    rows += [(600, None), (601, ""), (602, "the " * 3000), (603, "the " * 900 + "end"), (None, rows[7][1]), (604, " ".join(passages[5] * 3)), (605, " ".join(passages[2] + passages[3]) + " x" * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row long").repartition(3)
    got = defaultdict(set)
    partners = {}
    for r in suffix.repeated_passages(df).collect():
        assert r.n_words == r.end_word - r.start_word >= suffix.LEAST
        got[r.doc_id].update(range(r.start_word, r.end_word))
        partners[r.doc_id] = r.partner_id
    want = dict(zip((i for i, _ in rows), brute(rows)))
    assert all(want[i] == got[i] for i in want)
    assert {i for i in want if want[i]} == {i for i in got if got[i]}
    assert partners[200] != 200
    assert suffix.repeated_passages(df.limit(0)).count() == 0


def pieces(got):
    out = defaultdict(set)
    for r in got:
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_frequent_line_hides_no_passage(spark, monkeypatch):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = text(30)
    rows = []
    for i in range(400):
        # pairs far apart in any order share 25 words before the line, or 22 after it, or some on both sides
        a, b = random.Random(i % 200), i % 3
        own = [f"p{a.random()}" for _ in range(44)]
        before, after = [(own[:25], []), ([], own[:22]), (own[:12], own[12:24])][i % 200 % 3]
        rows.append((i, " ".join([*text(20), f"x{i}", *before, *line, *after, f"y{i}", *text(20 + b)])))
    rows += [(1000 + i, " ".join([*text(30), *line, *text(30)])) for i in range(600)]
    want = {i: w for (i, _), w in zip(rows, brute(rows)) if w}
    assert set(range(400)) <= want.keys()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert pieces(suffix.repeated_passages(df).collect()) == want
    monkeypatch.setattr(suffix, "KEY_ROWS", 50)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "64")
    try:
        assert pieces(suffix.repeated_passages(df).collect()) == want
    finally:
        spark.conf.unset(batch)
