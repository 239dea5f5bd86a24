from quernstone.operators import tablegrid as TG

SCHEMA = "table_id int, row int, seq int, text string, rowspan int, colspan int"


def test_cells_take_free_places():
    assert TG.placed([[(2, 1), (1, 2)], [(1, 1), (1, 1)], [(1, 3)]]) == [[(0, 0, 2, 1), (0, 1, 1, 2)], [(1, 1, 1, 1), (1, 2, 1, 1)], [(2, 0, 1, 3)]]
    assert TG.placed([[(9, 1)], [(1, 1)]]) == [[(0, 0, 2, 1)], [(1, 1, 1, 1)]]
    # one place between two cells from above
    assert TG.placed([[(2, 1), (1, 1), (2, 1)], [(0, 0), (1, 1)]]) == [[(0, 0, 2, 1), (0, 1, 1, 1), (0, 2, 2, 1)], [(1, 1, 1, 1), (1, 3, 1, 1)]]


def test_grid_roles_and_broken_lines(spark):
    cells = [
        (1, 0, 0, "品名", None, None), (1, 0, 1, "型号", 1, 1), (1, 0, 2, "单位", 1, 1), (1, 0, 3, "价格", 1, 1),
        (1, 5, 0, "水泥", 2, 1), (1, 5, 1, "P.O", 1, 1), (1, 5, 2, "t", 1, 1), (1, 5, 3, "¥1,410.50", 1, 1), (1, 6, 0, "P.C", 1, 1), (1, 6, 1, "t", 1, 1), (1, 6, 2, "390", 1, 1),
        (1, 7, 0, "长名", 1, 1), (1, 7, 1, "上半", 1, 1), (1, 7, 2, "", 1, 1), (1, 7, 3, None, 1, 1), (1, 8, 0, "称", 1, 1), (1, 8, 1, "下半", 1, 1), (1, 8, 2, "m³", 1, 1), (1, 8, 3, "5.00", 1, 1), (1, 9, 0, "尾", 1, 1),
        (2, 0, 0, "x", 1, 1),
    ]
    grid = TG.grid(spark.createDataFrame(cells, SCHEMA).repartition(3))
    at = {(r.row, r.col): (r.text, r.merged) for r in grid.where("table_id = 1").collect()}
    assert at[1, 0] == ("水泥", False) and at[2, 0] == ("水泥", True) and at[2, 1] == ("P.C", False) and at[2, 3] == ("390", False)
    assert {(r.col, r.role) for r in TG.roles(grid).where("table_id = 1").collect()} == {(0, "name"), (1, "spec"), (2, "unit"), (3, "price")}
    got = sorted(tuple(r)[1:] for r in TG.price_lines(grid).collect())
    assert got == [(1, "水泥", "P.O", "t", 1410.5), (2, "水泥", "P.C", "t", 390.0), (4, "长名 称", "上半 下半", "m³", 5.0)]
    assert TG.grid(spark.createDataFrame([], SCHEMA)).count() == 0
