from quernstone.operators import prices as P


def test_pages_with_month_and_material_are_read(spark):
    rows = [
        (1, 1, 3, "信息价 2024年3月价格 水泥(P.O) 说明"), (2, 1, 3, "水泥(P.O)\n t \n410.50"), (3, 1, 3, "Steel t 99.99"),
        (4, 1, 4, "2024年03月价格 STEEL"), (5, 1, 4, "steel kg 5.10\nsteel t 6.00"),
        (6, 2, 1, "2024年4月价格 steel kg 7.00"), (7, 2, 2, "steel kg 8.00"), (8, 2, 3, "2024年3月价格 Steel"), (9, 3, 9, None), (10, 3, 9, "2023年3月价格 and 2024年3月价格 steel m² 4.20 x"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, page long, content string").repartition(3)
    asked = spark.createDataFrame([(1, "steel", "2024-03"), (2, "水泥(P.O)", "2024-03"), (3, "steel", "2024-04"), (4, "steel", "2024-03"), (5, "", "2024-03"), (6, "steel", "2024"), (7, None, None)], "query_id int, material string, ym string")
    done = spark.createDataFrame([(4,)], "query_id int")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.page, r.unit, r.price) for r in P.anchor_prices(chunks, asked, 2, done).collect())
    assert got == [(1, 1, 1, 4, "kg", "5.10"), (1, 2, 3, 9, "m²", "4.20"), (2, 1, 1, 3, "t", "410.50"), (3, 1, 2, 1, "kg", "7.00")]
    assert P.anchor_prices(chunks.limit(0), asked, 2).count() == 0


def test_lines_of_one_number_are_read_as_they_stand(spark, tmp_path):
    from datetime import datetime

    import duckdb

    from quernstone.queries import QUERIES, SQL

    con = duckdb.connect()
    names = ["a one", "b two", "c three", "d four"]
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR)")
    con.executemany("INSERT INTO part VALUES (?, ?)", list(enumerate(names)))
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INTEGER, l_extendedprice DOUBLE, l_shipdate TIMESTAMP)")
    # order 7 has the same material twice under number 2, the dearer line first; order 8 twice under number 1, the cheaper first
    lines = [(n, n, 1, 10.5 + n, 1) for n in range(3)] + [(7, 3, 2, 90.25, 1), (7, 3, 2, 40.75, 1), (8, 3, 3, 1.5, 1), (8, 3, 1, 20.0, 1), (8, 3, 1, 30.0, 2)]
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?)", [(*x[:4], datetime(2001, 3, x[4])) for x in lines])
    for name in ("part", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = QUERIES["anchor_price_fallback"](spark, str(tmp_path))
    want = con.execute(SQL["anchor_price_fallback"])
    cols = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert [(r[3], r[5]) for r in want] == [(7, "90.25"), (8, "20.00")]
    assert sorted(map(tuple, got.select(*cols).collect())) == want
