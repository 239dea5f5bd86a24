import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(TERM, (text or "").translate(UPPER))


def brute(docs, items, k=20):
    own = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in own:
            m = 75 + 25 * size * n // length
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in Counter(terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    for t in ["A-b_c'D 1.5", "Ünï É字字 x y", "", " ", "İSTANBUL KELVINK ſ", "a\x00b\x7fc", "".join(map(chr, range(300)))]:
        assert [x.decode() for p in lexical.pieces_of(t.encode()) for x in p] == terms(t)
    assert list(lexical.pieces_of(None)) == []


@pytest.mark.parametrize("block,piece,item_bytes", [(1 << 14, 1 << 20, 1 << 24), (7, 40, 200)])
def test_like_brute_force(spark, monkeypatch, block, piece, item_bytes):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PIECE", piece)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    rng = random.Random(3)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(2000)] + ["Ünï", "字", "NAÏVE"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(200, None), (201, ""), (202, " -- "), (203, "w1 " * 5000 + text(900)), (None, docs[3][1]), (7, docs[3][1]), (7, docs[3][1])]
    items = [(i, text(rng.randint(1, 12))) for i in range(9)] + [(20, None), (21, ""), (22, "nowhere"), (3, "w1 w1 w1 Ünï"), (None, "w2 W2"), (23, docs[3][1])]
    if item_bytes < 1000:
        items = items[-6:]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, id int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, term string")
    got = lexical.search(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["item_id"].dataType.typeName() == "integer"
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [(1, 1, 1)]
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0 and lexical.search(d.where("doc_id = 2"), q).count() == 0


def test_best_of_ties():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 25))
        ids, scores = rng.permutation(n).astype(np.int64), rng.integers(0, 6, n)
        want = sorted(range(n), key=lambda i: (-scores[i], ids[i]))[:k]
        assert lexical.best(ids, scores, k).tolist() == want
