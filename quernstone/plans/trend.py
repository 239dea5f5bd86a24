"""Price trends: monthly means, the dominant series, a calendar filled from the month before, steps."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prices as P


def time_range(start: str, end: str, today: date, years: int = 10) -> tuple[str, str]:
    """Two months in order; an error for a bad form, a future month, or more than so many years."""
    for m in (start, end):
        if not re.fullmatch(r"(19|20)\d\d-(0[1-9]|1[0-2])", m):
            raise ValueError(f"not a month: {m}")
    start, end = sorted((start, end))
    if end > f"{today:%Y-%m}":
        raise ValueError(f"{end} is in the future")
    if (int(end[:4]) - int(start[:4])) * 12 + int(end[5:]) - int(start[5:]) > years * 12:
        raise ValueError(f"more than {years} years")
    return start, end


def price_trend(rows: DataFrame, start: str, end: str) -> DataFrame:
    """(material, ym, price, filled, delta) for every month of the range; price is null where it was filled."""
    own = rows.where(F.col("ym").between(start, end))
    series = P.dominant_series(P.monthly(own), start, end).select("material", "ym", "price")
    every = P.spine(series, ["material"], start, end).join(series, ["material", "ym"], "left")
    w = Window.partitionBy("material").orderBy("ym")
    filled = every.withColumn("filled", F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("delta", F.round(F.col("filled") - F.lag("filled").over(w), 4))
