"""Clusters of groups that lie far apart, on columns of unlike scales."""

from quernstone.operators import prices as P

CENTRES = [(0.0, 0.0), (0.0, 9e6), (50.0, 0.0), (50.0, 9e6)]


def test_groups_that_lie_apart_are_clusters(spark):
    rows = [(100 * g + i, x + i % 5 * 0.1, y + i % 7 * 1e3) for g, (x, y) in enumerate(CENTRES) for i in range(30)]
    got = P.cluster(spark.createDataFrame([*rows, (900, None, 1.0)], "id long, x double, y double"), ["x", "y"], 4)
    assert got.columns == ["id", "x", "y", "cluster"]
    groups = {}
    for r in got.collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[100 * g + i for i in range(30)] for g in range(4)]


def test_number_of_clusters_is_clamped(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(40)], "id long, x double")
    assert P.cluster(rows, ["x"], 1).select("cluster").distinct().count() == 2
    assert P.cluster(rows, ["x"], 99).select("cluster").distinct().count() <= 10
