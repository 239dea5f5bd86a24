import math
import os

import duckdb
import pytest

from quernstone.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{SF}/{t}.parquet') else ''}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, str)):
        return v
    try:
        return round(float(v), 9)
    except (TypeError, ValueError):
        return str(v)


def rows(cols, got):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in got), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols, got = rows(df.columns, df.collect())
    assert got, "no rows"
    if name in SQL:
        res = duck.execute(SQL[name])
        want_cols, want = rows([c[0] for c in res.description], res.fetchall())
        assert cols == want_cols
        assert len(got) == len(want)
        off = [(g, w) for g, w in zip(got, want) if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(g, w))]
        assert not off, (len(off), off[:3])
