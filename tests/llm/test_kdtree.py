import math

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import kdtree


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 50 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_like_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(int(1000 + i), rows[50][1]) for i in range(300)] + [(1150, rows[3][1])]
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, []), (2201, []), (2250, [3.0]), (2251, [2.0]), (2300, [0.0] * 6), (2350, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, shard int")
    got = kdtree.top_k(df, F.col("id") % 50 == 0, shard_rows=60)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert kdtree.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
