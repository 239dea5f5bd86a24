"""Tables found in text boxes (page_id, id, x, y, w, h, text) by their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_GAP, COLUMN_GAP, LEAST_CELLS = 40.0, 60.0, 4


def rows(boxes: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """Adds row_no: a box stays in the row of the one before it (by y) while their centres are nearer than the gap."""
    w = Window.partitionBy("page_id").orderBy("y", "id")
    own = boxes.withColumn("cy", F.col("y") + F.col("h") / 2)
    own = own.withColumn("new", F.coalesce((F.abs(F.col("cy") - F.lag("cy").over(w)) >= gap).cast("int"), F.lit(1)))
    return own.withColumn("row_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "cy")


def regions(rowed: DataFrame, least: int = LEAST_CELLS) -> DataFrame:
    """Boxes in tables, with table_no: two or more rows in a row of two or more cells, and enough cells in all."""
    per = rowed.groupBy("page_id", "row_no").agg(F.count("*").alias("cells"))
    w = Window.partitionBy("page_id").orderBy("row_no")
    breaks = F.sum((F.col("cells") < 2).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    many = per.withColumn("table_no", breaks).where("cells >= 2")
    good = many.groupBy("page_id", "table_no").agg(F.count("*").alias("rows"), F.sum("cells").alias("total")).where((F.col("rows") >= 2) & (F.col("total") >= least))
    return rowed.join(many.join(good.select("page_id", "table_no"), ["page_id", "table_no"], "left_semi").select("page_id", "row_no", "table_no"), ["page_id", "row_no"])


def columns(cells: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """Adds col_no: cells of a table stay in the column of the one before them (by x) while they start nearer than the gap."""
    w = Window.partitionBy("page_id", "table_no").orderBy("x", "id")
    own = cells.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) >= gap).cast("int"), F.lit(1)))
    return own.withColumn("col_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def detect(boxes: DataFrame) -> DataFrame:
    """(page_id, table_no, row, col, text): rows and columns from 0 within their table."""
    own = columns(regions(rows(boxes)))
    r = F.dense_rank().over(Window.partitionBy("page_id", "table_no").orderBy("row_no")) - 1
    return own.groupBy("page_id", "table_no", "row_no", "col_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "id", "text"))), lambda s: s["text"]), " ").alias("text")).withColumn("row", r).select("page_id", "table_no", "row", (F.col("col_no") - 1).alias("col"), "text")


def chart(cells: DataFrame) -> DataFrame:
    """Series (page_id, table_no, series, at, value): the column with times names the points, every numeric one is a series."""
    head = cells.where("row = 0").select("page_id", "table_no", "col", F.col("text").alias("series"))
    body = cells.where("row > 0")
    time = r"^\d{4}([-/年.]\d{1,2})?月?$"
    shape = body.groupBy("page_id", "table_no", "col").agg(F.avg(F.col("text").rlike(time).cast("int")).alias("times"), F.avg(F.col("text").rlike(r"^-?[\d,]+(\.\d+)?$").cast("int")).alias("numbers"))
    at = shape.where("times >= 0.5").groupBy("page_id", "table_no").agg(F.min("col").alias("at_col"))
    labels = body.join(at, ["page_id", "table_no"]).where("col = at_col").select("page_id", "table_no", "row", "at_col", F.col("text").alias("at"))
    values = body.join(shape.where("numbers >= 0.5"), ["page_id", "table_no", "col"], "left_semi").join(head, ["page_id", "table_no", "col"]).join(labels, ["page_id", "table_no", "row"]).where("col <> at_col")
    return values.select("page_id", "table_no", "series", "at", F.regexp_replace("text", ",", "").cast("double").alias("value"))
