import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=str)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r) for r in df.select(*[df[c] for c in cols]).collect()), key=str)
