"""Tables with merged cells as grids, the roles of their columns, and price rows that lines were broken in.

Where a cell lies hangs on the cells placed before it in its table, so a table's cells are placed together, table by table; what a
column is, and which rows are one, are aggregates and windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells that a span may cover in one direction; what lies beyond is an error of the source.
MOST_SPAN = 1000
#: Patterns that tell numbers and units, which columns are voted by.
NUMBER, UNIT = r"^[¥￥]?\s*\d[\d,]*(\.\d+)?$", r"^(m[²³23]?|㎡|m³|t|kg|km|个|套|台|根|块|只|组|项|工日|L)$"


def placed(spans: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, int, int]]]:
    """For the rows of a table, given as (rowspan, colspan) of their cells, where each cell lies: (first row, first column, rows, columns), cut off at the last row. A cell takes the first free column and what its span covers."""
    taken: dict[int, int] = {}
    out = []
    for r, row in enumerate(spans):
        c, own = 0, []
        for down, across in row:
            down, across = min(max(down, 1), len(spans) - r), min(max(across, 1), MOST_SPAN)
            while taken.get(c, 0) > r:
                c += 1
            own.append((r, c, down, across))
            for i in range(c, c + across):
                taken[i] = max(taken.get(i, 0), r + down)
            c += across
        out.append(own)
    return out


def grid(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, text, merged): every place of each table's grid that a cell covers, from cells (table_id, row, seq, text, rowspan, colspan) as a source lists them.

    Rows are numbered anew from 0 in their order. merged says that a place is covered by a cell that begins elsewhere. Null spans are 1. Where
    spans overlap, a place has the text of the cell that comes last.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "seq"])
        rows = [list(zip(g["text"], g["rowspan"].fillna(1).astype(int), g["colspan"].fillna(1).astype(int))) for _, g in pdf.groupby("row", sort=True)]
        found: dict[tuple[int, int], tuple] = {}
        for own, at in zip(rows, placed([[(d, a) for _, d, a in r] for r in rows])):
            for (text, _, _), (r, c, down, across) in zip(own, at):
                for i in range(down):
                    for j in range(across):
                        found[r + i, c + j] = (text, i > 0 or j > 0)
        table = pdf["table_id"].iloc[0]
        return pd.DataFrame([(table, r, c, text, merged) for (r, c), (text, merged) in sorted(found.items())], columns=["table_id", "row", "col", "text", "merged"])

    kind = cells.schema["table_id"].dataType.simpleString()
    own = cells.select("table_id", "row", "seq", F.col("text").cast("string").alias("text"), F.col("rowspan").cast("double").alias("rowspan"), F.col("colspan").cast("double").alias("colspan"))
    return own.groupBy("table_id").applyInPandas(each, f"table_id {kind}, row int, col int, text string, merged boolean")


def roles(cells: DataFrame, head: int = 1) -> DataFrame:
    """(table_id, col, role) of a grid's columns, by what most of their cells below the head are: price, unit, or text; the first text column is the name, the next one the specification, further ones are notes. Columns without text have none."""
    body = cells.where((F.col("row") >= head) & (F.trim("text") != ""))
    counts = body.groupBy("table_id", "col").agg(F.count("*").alias("n"), F.count_if(F.trim("text").rlike(NUMBER)).alias("numbers"), F.count_if(F.trim("text").rlike(UNIT)).alias("units"))
    kind = F.when(2 * F.col("numbers") > F.col("n"), "price").when(2 * F.col("units") > F.col("n"), "unit").otherwise("text")
    own = counts.select("table_id", "col", kind.alias("kind"))
    nth = F.row_number().over(Window.partitionBy("table_id", "kind").orderBy("col"))
    named = F.when(F.col("kind") != "text", F.col("kind")).when(nth == 1, "name").when(nth == 2, "spec").otherwise("note")
    return own.select("table_id", "col", named.alias("role"))


def price_lines(cells: DataFrame, head: int = 1) -> DataFrame:
    """(table_id, row, name, spec, unit, price) of a grid: one line for each row with a price. Rows without one that come before belong to it: their names and specifications go before its own."""
    known = cells.where(F.col("row") >= head).join(roles(cells, head), ["table_id", "col"])
    pick = lambda role: F.min(F.when((F.col("role") == role) & (F.trim("text") != ""), F.struct("col", F.trim("text").alias("t"))))["t"]
    rows = known.groupBy("table_id", "row").agg(*[pick(r).alias(r) for r in ("name", "spec", "unit", "price")])
    along = Window.partitionBy("table_id").orderBy("row")
    line = F.count("price").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("price").isNotNull().cast("int")
    whole = rows.withColumn("line", line).groupBy("table_id", "line").agg(
        F.max(F.when(F.col("price").isNotNull(), F.col("row"))).alias("row"), *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("row", F.col(c).alias("t"))))), lambda x: x["t"]), " ").alias(c) for c in ("name", "spec")],
        F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("row"))).alias("unit"), F.max("price").alias("price"),
    )
    number = F.regexp_replace("price", r"[¥￥,\s]", "").cast("double")
    return whole.where("price is not null").select("table_id", "row", "name", "spec", "unit", number.alias("price"))
