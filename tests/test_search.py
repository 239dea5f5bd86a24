"""Searches whose plans narrow the candidates, against plain loops over all rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions.text import TOKEN
from quernstone.operators import search as S
from quernstone.operators import understanding as U

TEXTS = {
    1: "The quick brown fox jumps over the lazy dog",
    2: "THE QUICK BROWN FOX",
    3: "quick brown",
    4: "xquick brown foxy jumps",
    5: "水泥 价格 and the quick-brown fox",
    6: "",
    7: None,
    8: "a b c d a b c d",
    9: "quick  brown fox jumps",
    10: "the quick brown fox jumps the quick brown fox jumps",
}
QUERIES = {1: "quick brown fox", 2: "QUICK", 3: "brown fox jumps", 4: "", 5: None, 6: "水泥 价格 and", 7: "b c d", 8: "uick brown fo", 9: "- brown", 10: "quick brown", 11: "no such words here"}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "own") for i, t in TEXTS.items()], "chunk_id long, content string, probe string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id long, query string")


def test_literal_matches(docs, asked):
    got = sorted((r.query_id, r.chunk_id) for r in S.literal_matches(docs.drop("probe"), asked).collect())
    assert got == sorted((q, d) for q, w in QUERIES.items() for d, t in TEXTS.items() if w is not None and t is not None and w.lower() in t.lower())


def test_literal_matches_keeps_other_columns(docs, asked):
    got = S.literal_matches(docs, asked.where("query_id = 1"))
    assert got.columns == ["chunk_id", "content", "probe", "query_id", "query"]
    assert {r.probe for r in got.collect()} == {"own"}


def test_bm25_among_keeps_the_statistics(spark, docs, asked):
    toks = {d: re.findall(TOKEN, (t or "").lower()) for d, t in TEXTS.items()}
    toks = {d: t for d, t in toks.items() if t}
    mean = sum(map(len, toks.values())) / len(toks)

    def score(words, t):
        total = 0.0
        for w in words & set(t):
            df, tf = sum(w in o for o in toks.values()), t.count(w)
            total += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        return round(total, 4)

    seeds = spark.createDataFrame([(2,), (8,), (9,)], "chunk long")
    got = {(r.query_id, r.chunk): r.score for r in S.bm25(docs, asked, 10, among=seeds).collect()}
    want = {(q, d): score(set(re.findall(TOKEN, (w or "").lower())), toks[d]) for q, w in QUERIES.items() for d in (2, 8, 9)}
    want = {k: v for k, v in want.items() if set(re.findall(TOKEN, (QUERIES[k[0]] or "").lower())) & set(toks[k[1]])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-4 for k in want)


def test_token_budget_is_each_query_s_own(spark):
    rows = [(q, r, "x" * 300, 1.0) for q in (1, 2) for r in range(1, 5 - q)]
    got = S.token_budget(spark.createDataFrame(rows, "query_id int, rank int, content string, score double"), ["query_id"], 250).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_fan_out_tells_many_parts_apart(spark):
    one = " and ".join(f"part{i}" for i in range(1200))
    asked = spark.createDataFrame([(1, one), (2, "other")], "query_id long, query string")
    got = U.fan_out(asked, lambda q: q.selectExpr("query_id", "try_cast(regexp_replace(query, '[^0-9]', '') as long) as chunk", "1.0D as score").where("chunk is not null"), 2000).collect()
    assert {r.query_id for r in got} == {1} and sorted(r.chunk for r in got) == list(range(1200))


def test_against_all(spark):
    vectors = {1: [1.0, 0.0], 2: [3.0, 4.0], 3: None, 4: [0.0, 0.0], 5: [1.0, 0.0]}
    rows = spark.createDataFrame([(i, v, i * 10) for i, v in vectors.items()], "vec_id long, embedding array<double>, label long")
    asked = rows.selectExpr("vec_id as query_id", "embedding as q")
    got = {(r.query_id, r.vec_id): r.score for r in S.against_all(rows, asked, "vec_id", "embedding").collect()}
    known = {(1, 2): 0.6, (2, 1): 0.6, (2, 5): 0.6, (5, 2): 0.6, (1, 5): 1.0, (5, 1): 1.0}
    assert got == {(q, i): known.get((q, i)) for q in vectors for i in vectors if q != i}


def test_fetched_by_intent(spark):
    from quernstone.plans import hybrid as H

    rows = [(p, q, 100 * q + r, r, 1.0 - r / 10) for p in ("text", "vector", "literal", "other") for q in (1, 2, 3) for r in range(1, 9)]
    legs = spark.createDataFrame(rows, "path string, query_id int, chunk int, rank int, score double")
    intents = spark.createDataFrame([(1, "rule"), (2, "compare"), (3, "general")], "query_id int, intent string")
    got = {}
    for r in H.fetched(legs, intents, 2).collect():
        got[r.query_id, r.path] = max(r.rank, got.get((r.query_id, r.path), 0))
    times = {1: {"text": 3, "literal": 3}, 2: {"text": 2, "literal": 2}, 3: {}}
    assert got == {(q, p): 2 * times[q].get(p, 1) for q in times for p in ("text", "vector", "literal", "other")}
    assert max(r.rank for r in H.fetched(legs, intents, 8).where("path = 'vector'").collect()) == 6
    assert H.most_fetched("text", 8) == 24 and H.most_fetched("vector", 8) == 8


def test_nearest_is_the_top_of_against_all(spark, monkeypatch):
    import random

    from pyspark.sql import Window

    rng = random.Random(6)
    one = lambda: [float(rng.randint(-3, 3)) for _ in range(3)]
    vectors = [one() for _ in range(150)] + [None, [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0], [1e200] * 3, [float("nan")] * 3, [1e-200] * 3, []]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    asked = rows.where("vec_id % 9 = 0 or vec_id >= 148").selectExpr("vec_id as query_id", "embedding as q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    whole = S.against_all(rows, asked, "vec_id", "embedding").withColumn("rank", rank)
    for k, sent, products in ((4, None, 1 << 22), (30, 7, 200), (400, None, 1 << 22)):
        monkeypatch.setattr(S, "_PRODUCTS", products)
        if sent:
            monkeypatch.setattr("quernstone.operators.tables.SENT_ROWS", sent)
        want = whole.where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score").collect()
        got = S.nearest(rows, asked, k, "vec_id", "embedding").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert S.nearest(rows, asked.limit(0), 3, "vec_id", "embedding").count() == 0 and S.nearest(rows.limit(0), asked, 3, "vec_id", "embedding").count() == 0
    plan = S.nearest(rows, asked, 3, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_literal_matches_send_no_texts_around(spark, docs, asked):
    got = S.literal_matches(docs.withColumn("name", F.length("content")), asked, keep=["chunk_id", "name"])
    assert got.columns == ["chunk_id", "name", "query_id", "query"]
    assert sorted((r.query_id, r.chunk_id, r.name) for r in got.collect()) == sorted((q, d, len(t)) for q, w in QUERIES.items() for d, t in TEXTS.items() if w is not None and t is not None and w.lower() in t.lower())
