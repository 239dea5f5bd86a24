import numpy as np

from quernstone.llm import hnsw

from .test_simhash import closure


def test_like_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 24))
    near = [b + rng.normal(scale=s, size=24) for b in base[:60] for s in (0.05, 0.12, 0.2)]
    chain = [base[0]]
    for _ in range(30):
        chain.append(chain[-1] + rng.normal(scale=0.2, size=24))
    hub = [base[7] * 3 + rng.normal(scale=0.02, size=24) for _ in range(200)]
    vs = [*base, *near, *chain, *hub, base[5], base[5] * 2]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [1.0, None] + [1.0] * 22), (5003, [float("nan")] * 24), (5004, []), (5005, [1.0]), (5006, [2.5]), (5007, [1e300] * 24), (5008, [1e300] * 23 + [2e300]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, root string")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard_rows=160).collect()}
    assert len(got) == len(rows) + len(odd)
    u = hnsw.units(np.array(vs))
    s = u @ u.T >= 0.95
    pairs = [(int(a), int(b)) for a, b in np.argwhere(s) if a < b]
    n = s.sum(axis=1) - 1
    assert [got[i].n_links for i in range(len(vs))] == n.tolist()
    want = closure(len(vs), pairs)
    assert [got[i].component_id for i in range(len(vs))] == [want[i] for i in range(len(vs))]
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(vs)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (5000, 5001, 5002, 5003, 5004, None))
    assert got[5006].component_id == 5005 and got[5008].component_id == 5007
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    assert df.where("vec_id = 5001").count() == hnsw.near_duplicates(df.where("vec_id = 5001")).count()


def test_each_pair_of_shards_meets_once(spark):
    from pyspark.sql import functions as F

    for shards in (1, 2, 3, 7, 8):
        rows = spark.range(shards).select(F.col("id").cast("int").alias("s")).select("s", F.explode(hnsw._asked(F.col("s"), shards)).alias("t")).collect()
        assert sorted(tuple(sorted(r)) for r in rows) == [(a, b) for a in range(shards) for b in range(a + 1, shards)]


def test_sparse_pairs_beside_dense_groups():
    """Recall for each vector by itself, so that a group of very many neighbours can't hide one of few."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 64))
    near = base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.3, (500, 1))
    groups = [c + rng.normal(size=(300, 64)) * s for c, s in zip(rng.normal(size=(4, 64)), (0.05, 0.15, 0.25, 0.3))]
    u = hnsw.units(np.concatenate([base, near, *groups]))
    graph = hnsw.Graph(u)
    width = graph.audited()
    there, part = graph.recalls(u, width)
    assert part.mean() >= 0.99 and part[there >= 16].min() == 1 and (part < 0.9).sum() <= 0.005 * len(u)
    rows = np.arange(len(u))
    got = [x for i in range(0, len(u), 256) for x in graph.within(u[i : i + 256], width, start=rows[i : i + 256])]
    part = np.array([len(x) for x in got]) / (u @ u.T >= 0.95).sum(axis=1)
    assert part.mean() >= 0.999 and part.max() == 1


def test_nodes_that_no_path_reaches_get_links():
    rng = np.random.default_rng(8)
    graph = hnsw.Graph(hnsw.units(np.concatenate([rng.normal(size=(800, 16)) * 0.01 + rng.normal(size=16), rng.normal(size=(800, 16))])))
    near = graph._near[0] = graph._near[0][:, : 2 * hnsw.LINKS].copy()
    near[near % 7 == 0] = -1
    graph._connect()
    seen = np.zeros(len(graph.u), bool)
    graph._reach(graph._entry[-1:], seen)
    assert seen.all()


def test_a_link_counts_whichever_end_finds_it(spark, monkeypatch):
    """Searches that miss at random: a link is counted for both ends if either found it, once."""
    rng = np.random.default_rng(12)
    u = hnsw.units(np.concatenate([c + rng.normal(size=(40, 12)) * 0.04 for c in rng.normal(size=(6, 12))]))
    near = u @ u.T >= 0.95
    known: dict = {}

    def some(self, q, width, cosine=0.95, start=None):
        at = [int(np.argmax(self.u @ x)) for x in q]
        scanned = np.array([a % 3 == 0 for a in at])
        gone = [np.flatnonzero(self.u @ x >= cosine) for x in q]
        out = [g if w else g[(np.random.default_rng(a).random(len(g)) < 0.6) | (g == a)] for a, g, w in zip(at, gone, scanned)]
        return out, scanned

    for a in range(len(u)):
        g = np.flatnonzero(near[a])
        known[a] = set(g.tolist()) if a % 3 == 0 else set(g[(np.random.default_rng(a).random(len(g)) < 0.6) | (g == a)].tolist())
    want = [sum(b in known[a] or a in known[b] for b in range(len(u)) if b != a) for a in range(len(u))]
    monkeypatch.setattr(hnsw.Graph, "within_or_all", some)
    monkeypatch.setattr(hnsw.Graph, "audited", lambda self, *x: 24)
    got = {}
    batches = []
    import pyarrow as pa

    for role in (0, 1):
        batches.append(pa.record_batch([pa.array([12] * len(u), pa.int32()), pa.array([0] * len(u), pa.int32()), pa.array([role] * len(u), pa.int32()), pa.array(range(len(u)), pa.int64()), pa.array(u.tolist(), pa.list_(pa.float64())), pa.array([1] * len(u), pa.int64())], ["dim", "shard", "role", "id", "v", "n"]))
    for b in hnsw._work(0.95)(batches):
        for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[i] = got.get(i, 0) + n
    assert [got.get(a, 0) for a in range(len(u))] == want and sum(want) < near.sum() - len(u)


def test_what_no_row_can_be_near_is_not_searched_for(monkeypatch):
    """The bound never rules out a query that has a neighbour, whatever the vectors; of queries without one few are searched for."""
    rng = np.random.default_rng(21)
    plain = rng.normal(size=(1500, 32))
    flat = np.concatenate([rng.normal(size=(800, 3)) * 5, rng.normal(size=(800, 29)) * 0.2], axis=1)
    for rows in (plain, flat, rng.normal(size=(700, 1)), np.concatenate([plain[:600], plain[:300] + rng.normal(size=(300, 32)) * 0.2])):
        graph = hnsw.Graph(hnsw.units(rows))
        own = np.arange(len(rows))
        s = graph.u @ graph.u.T
        s[own, own] = -9
        assert graph.possible(graph.u, start=own)[s.max(axis=1) >= 0.95].all()
        q = hnsw.units(rows[: len(rows) // 2] * 1.5 + rng.normal(size=(len(rows) // 2, rows.shape[1])) * 0.1)
        assert graph.possible(q)[(q @ graph.u.T).max(axis=1) >= 0.95].all()
    graph = hnsw.Graph(hnsw.units(plain))
    asked = []
    search = hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, *x: asked.append(len(q)) or search(self, q, *x))
    found, scanned = graph.within_or_all(graph.u, 24, start=np.arange(1500))
    assert [x.tolist() for x in found] == [[i] for i in range(1500)] and sum(asked) < 300 and scanned.sum() >= 1200
    assert not any(len(x) for x in graph.within(hnsw.units(rng.normal(size=(400, 32))), 24))
