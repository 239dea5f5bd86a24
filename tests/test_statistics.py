import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import prices as P
from quernstone.operators import search as S
from quernstone.operators import tables as O


def test_top_k_has_no_silent_cap(spark):
    df = spark.range(1000)
    assert O.top_k(df, 500, F.col("id")).count() == 500 and O.top_k(df, 500, F.col("id"), most=200).count() == 200 and O.top_k(df, 0, F.col("id")).count() == 1


def test_a_far_value_leaves_slices_even(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x")).unionByName(spark.createDataFrame([(1e12,)], "x double"))
    sizes = [r.n for r in P.slices(df, "x").groupBy("slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 200 and max(sizes) < 400


def test_average_ranks(spark):
    values = [5.0, 1.0, 1.0, 7.0, 1e12, None, 5.0, -3.0, 1.0]
    got = {r.x: r["rank"] for r in P.average_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()}
    assert got == {-3.0: 1.0, 1.0: 3.0, 5.0: 5.5, 7.0: 7.0, 1e12: 8.0}
    assert P.average_ranks(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_percentiles_like_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(-50, 50, {"a": 1, "b": 700}.get(k, 38)) * (10.0 if k else 1e9)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.p, r.q, r.h) for r in P.percentiles(df, "v", {"p": 0.25, "q": 0.99, "h": 0.5}, ["k"]).collect()}
    for k in ("a", "b", None):
        own = [v for x, v in rows if x == k and v is not None]
        assert np.allclose(got[k], [np.percentile(own, 25), np.percentile(own, 99), np.percentile(own, 50)])
    one = P.percentiles(df, "v", {"p": 0.75}).collect()
    assert np.allclose(one[0].p, np.percentile([v for _, v in rows if v is not None], 75))
    stats = {r.k: r for r in P.number_stats(df, "v", ["k"]).collect()}
    assert stats["none"].n == 0 and stats["none"].median is None and stats[None].n == 38
    assert {r.v for r in P.outliers(df.unionByName(spark.createDataFrame([("b", 1e9)], "k string, v double")), "v", ["k"]).collect()} >= {1e9}


def test_questions_meet_rows_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "vec_id long, v array<double>")
    asked = rows.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, S.against_all(rows, asked, "vec_id", "v").collect()))
    monkeypatch.setattr(O, "SENT_ROWS", 2)
    assert sorted(map(tuple, S.against_all(rows, asked, "vec_id", "v").collect())) == whole and len(whole) == 9 * 29
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = S.against_all(rows, asked, "vec_id", "v")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
