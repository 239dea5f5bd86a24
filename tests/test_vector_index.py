import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import vector_index as V

SCHEMA = "vec_id long, v array<double>, day int"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 4) + 0.3 * rng.normal(size=16)).tolist(), i % 9) for i in range(1200)]
    rows += [(2000 + i, rows[5][1], 3) for i in range(400)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] * 16, 1), (3004, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = V.write_index(df, f"file://{tmp_path_factory.mktemp('index')}", "vec_id", "v", lists=12, others=("day",))
    return made, {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i < 3000}, {i: d for i, _, d in rows}, df


def test_every_sound_row_is_in_one_list(index):
    made, vectors, *_ = index
    assert sorted(r.id for r in made.rows.select("id").collect()) == sorted(vectors)
    assert sum(r.n for r in made.lists.collect()) == len(vectors)


def test_search_is_audited_and_prunes(index):
    made, vectors, _, df = index
    asked = df.where("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    probes, recall = V.audited(made, asked, 5)
    assert recall >= 0.9 and probes < 12
    got = V.search(made, asked, 5, probes)
    held, hits, n = got.collect(), 0, 0
    for q in {r.query_id for r in asked.collect()}:
        own = [r for r in held if r.query_id == q]
        best = sorted((-round(float(vectors[q] @ vectors[i]), 4), i) for i in vectors if i != q)[:5]
        assert all(abs(r.score - float(vectors[q] @ vectors[r.id])) < 1e-4 for r in own)
        hits += sum(r.score >= -best[-1][0] for r in own)
        n += 5
    assert hits >= 0.9 * n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_all_lists_are_as_good_as_a_scan(index):
    made, _, _, df = index
    asked = df.where("vec_id in (3, 5, 2100, 3000)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = V.search(made, asked, 7, 12, refine=200)
    assert sorted(map(tuple, got.select("query_id", "id", "score").collect())) == sorted(map(tuple, V.by_scan(made, asked, 7).select("query_id", "id", "score").collect()))
    assert {r.query_id for r in got.collect()} == {3, 5, 2100}


def test_a_least_score_loses_nothing(index, monkeypatch):
    made, vectors, days, df = index
    asked = df.where("vec_id % 300 = 11").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    for blocks in (False, True):
        if blocks:
            monkeypatch.setattr(V, "SENT_ROWS", 64)
        got = {(r.query_id, r.id, r.day) for r in V.within(made, asked, 0.97, ("day",), F.col("day") < 5).collect()}
        want = {(q, i, days[i]) for q in {r.query_id for r in asked.collect()} for i in vectors if i != q and days[i] < 5 and round(float(vectors[q] @ vectors[i]), 4) >= 0.97}
        assert got == want and len(got) > 20


def test_expired_entries_answer_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "2024-01-01 00:00:00"), (2, [1.0, 0.1], "2024-01-02 00:00:00"), (3, [1.0, 0.05], "2024-01-05 00:00:00"), (4, [0.0, 1.0], "2024-01-02 00:00:00")], "vec_id long, v array<double>, at string")
    made = V.write_index(rows.withColumn("at", F.col("at").cast("timestamp")), f"file://{tmp_path}/cache", "vec_id", "v", others=("at",))
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, q array<double>")
    find = lambda now, ttl: [(r.rank, r.id) for r in V.cached_answers(made, asked, 0.85, "at", F.lit(now).cast("timestamp"), ttl, 2).collect()]
    assert find("2024-01-02 00:00:00", 86400) == [(1, 1), (2, 2)]
    assert find("2024-01-02 00:00:01", 86400) == [(1, 2)]
    assert find("2024-01-09 00:00:00", 60) == []


def test_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    made = V.write_index(empty, f"file://{tmp_path}/none", "vec_id", "v")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, q array<double>")
    assert V.search(made, asked, 3, 2).count() == 0
