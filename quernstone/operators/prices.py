"""Price records (material, spec, unit, price, ym), monthly series and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .tables import latest_per_key, match


def price_range(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least, mean and greatest price, counts, latest month, and the variation: population deviation over mean, from two prices on."""
    mean = F.avg("price")
    return rows.groupBy(*keys).agg(
        F.round(F.min("price"), 2).alias("low"), F.round(mean, 2).alias("mean"), F.round(F.max("price"), 2).alias("high"), F.count("*").alias("n"), F.countDistinct("unit").alias("units"),
        F.count_if(F.col("price") > 1000).alias("dear"), F.max("ym").alias("latest"), F.when((F.count("price") >= 2) & (mean > 0), F.round(F.stddev_pop("price") / mean, 4)).alias("cv"),
    )


def monthly(rows: DataFrame) -> DataFrame:
    return rows.groupBy("material", "ym", "spec", "unit").agg(N.half_up(F.avg("price"), 2).alias("price"), F.count("*").alias("n"))


def dominant_series(months: DataFrame, first: str, last: str) -> DataFrame:
    """Months of each material's most consistent (spec, unit): by distinct months, both ends there, rows, mean price."""
    s = months.groupBy("material", "spec", "unit").agg(
        F.countDistinct("ym").alias("months"), F.max(F.when(F.col("ym") == first, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("ym") == last, 1).otherwise(0)).alias("b"),
        F.sum("n").alias("total"), F.round(F.avg("price"), 4).alias("mean"),
    )
    order = [F.desc("months"), F.desc(F.col("a") * F.col("b")), F.desc("total"), F.desc("mean"), F.col("spec"), F.col("unit")]
    best = latest_per_key(s, ["material"], order).select("material", "spec", "unit")
    return months.join(best, ["material", "spec", "unit"], "left_semi")


def trend_points(rows: DataFrame, source_rank: Column) -> DataFrame:
    """The best row of each series and month: by source rank, then the smallest id."""
    own = rows.withColumn("series_key", F.concat_ws("|", "material", "spec", "unit")).withColumn("rank", source_rank)
    return latest_per_key(own, ["series_key", "ym"], [F.col("rank"), F.col("id")]).select("series_key", "ym", "id", "price")


def trend_relations(points: DataFrame) -> DataFrame:
    """Steps between consecutive points of a series, with the true number of months between them."""
    w = Window.partitionBy("series_key").orderBy("ym")
    own = points.withColumn("from_id", F.lag("id").over(w)).withColumn("old", F.lag("price").over(w)).withColumn("from_ym", F.lag("ym").over(w)).where("from_id is not null")
    delta = F.col("price") - F.col("old")
    return own.select(
        "series_key", "from_id", F.col("id").alias("to_id"), N.half_up(delta, 4).alias("delta"), F.when(F.col("old") != 0, N.half_up(delta / F.col("old") * 100, 4)).alias("pct"),
        N.direction(delta).alias("direction"), N.months_between(F.col("ym"), F.col("from_ym")).alias("months_apart"),
    )


def month_over_month(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change on the month before; none after a change of unit, no percentage of zero."""
    w = Window.partitionBy(*keys).orderBy("ym")
    own = series.withColumn("old", F.lag("price").over(w)).withColumn("old_unit", F.lag("unit").over(w))
    same = F.col("old").isNotNull() & (F.col("unit") == F.col("old_unit"))
    return own.select(
        *keys, "ym", "unit", "price", F.when(same, F.round(F.col("price") - F.col("old"), 4)).alias("delta"),
        F.when(same & (F.col("old") != 0), F.round((F.col("price") - F.col("old")) / F.col("old") * 100, 4)).alias("pct"), (same & (F.col("old") == 0)).alias("overflow"),
        (F.col("old").isNotNull() & (F.col("unit") != F.col("old_unit"))).alias("unit_changed"),
    )


def spine(rows: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """Every month from first to last for every key."""
    every = F.transform(F.sequence(F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    return rows.select(*keys).distinct().withColumn("ym", F.explode(every))


def missing_months(rows: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    return spine(rows, keys, first, last).join(rows.select(*keys, "ym").distinct(), [*keys, "ym"], "left_anti")


def slices(values: DataFrame, column: str, most: int = 256) -> DataFrame:
    """values with the number of the slice that each falls in, slices holding about as many rows each; splitters are taken from the values, and only they come to the driver."""
    from pyspark.ml.feature import Bucketizer

    own = values.withColumn("__x", F.col(column).cast("double"))
    cuts = own.where("__x is not null and not isnan(__x)").approxQuantile("__x", [i / most for i in range(1, most)], 1 / (4 * most))
    splits = [float("-inf"), *sorted({c for c in cuts if abs(c) < float("inf")}), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    return Bucketizer(splits=splits, inputCol="__x", outputCol="slice", handleInvalid="keep").transform(own).drop("__x")


def running_counts(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, c, upto): how often each value is there, and how many rows of the key are at or below it. No task sees all values of a key, nor all rows of a value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c"))
    own = slices(counts, column)
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # over one row a slice
    sums = own.groupBy(*keys, "slice").agg(F.sum("c").alias("s")).withColumn("before", F.sum("s").over(before) - F.col("s")).drop("s")
    inside = Window.partitionBy(*keys, "slice").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    here = match(own.withColumn("inside", F.sum("c").over(inside)), sums, [*keys, "slice"])
    return here.select(*keys, column, "c", (F.col("before") + F.col("inside")).alias("upto"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a column for each named share): exact percentiles, interpolated between the two values that the share falls between, of the values that aren't null."""
    own = running_counts(rows, value, keys)
    totals = own.groupBy(*keys).agg(F.max("upto").alias("__n"))
    own = match(own, totals, keys)
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(value).cast("double")))
    place = {name: (F.col("__n") - 1) * F.lit(p) for name, p in shares.items()}
    got = own.groupBy(*keys).agg(F.max("__n").alias("__n"), *[at(f(x)).alias(f"__{which}_{name}") for name, x in place.items() for which, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda name, x: (F.ceil(x) - x) * F.col(f"__low_{name}") + (x - F.floor(x)) * F.col(f"__high_{name}")
    return got.select(*keys, *[F.when(F.ceil(x) == F.floor(x), F.col(f"__low_{name}")).otherwise(between(name, x)).alias(name) for name, x in place.items()])


def number_stats(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, range, mean, median, population deviation, interpolated percentiles, sum."""
    sums = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"), F.round(F.avg(value), 4).alias("mean"),
        F.round(F.stddev_pop(value), 4).alias("std"), F.round(F.sum(value), 2).alias("total"),
    )
    shares = percentiles(rows, value, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}, keys)
    both = match(sums, shares, keys, "left")
    return both.select(*keys, "n", "low", "high", "mean", F.round("median", 6).alias("median"), "std", *[F.round(p, 6).alias(p) for p in ("p25", "p75", "p95", "p99")], "total")


def outliers(rows: DataFrame, value: str, keys: Sequence[str], method: str = "iqr", least: int = 5) -> DataFrame:
    """Rows outside 1.5 interquartile ranges, or more than 3 population deviations off, of groups with enough rows."""
    if method == "iqr":
        s = match(percentiles(rows, value, {"q1": 0.25, "q3": 0.75}, keys), rows.groupBy(*keys).agg(F.count(value).alias("__n")), keys)
        s = s.select(*keys, "__n", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("__low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("__high"))
    elif method == "zscore":
        s = rows.groupBy(*keys).agg(F.count(value).alias("__n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
        s = s.select(*keys, "__n", (F.col("m") - 3 * F.col("d")).alias("__low"), (F.col("m") + 3 * F.col("d")).alias("__high"))
    else:
        raise ValueError(f"no such method: {method}")
    return match(rows, s.where(F.col("__n") >= least), keys).where((F.col(value) < F.col("__low")) | (F.col(value) > F.col("__high"))).drop("__n", "__low", "__high")


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, rank) of each distinct value, ties at their mean: sums over slices of the values, then inside a slice, so that no task sees all values."""
    return running_counts(rows, column).select(column, (F.col("upto") - (F.col("c") - 1) / 2.0).alias("rank"))


def correlate(rows: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of each pair of 2 to 8 columns, the strongest first; Spearman on average ranks."""
    if not 2 <= len(columns) <= 8:
        raise ValueError("2 to 8 columns")
    if method == "spearman":
        for c in columns:
            rows = rows.join(average_ranks(rows, c).select(F.col(c).alias("__k"), F.col("rank").alias(f"__rank_{c}")), F.col(c) == F.col("__k")).drop("__k")
        source = {c: f"__rank_{c}" for c in columns}
    else:
        source = {c: c for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(source[a], source[b]), 4).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))
    return got.orderBy(F.desc(F.abs("r")), "a", "b").limit(10)


def forecast(rows: DataFrame, keys: Sequence[str], period: str, value: str, ahead: int, least: int = 3) -> DataFrame:
    """A least-squares line through the periods' means, carried on: (keys, step, value, low, high, r2)."""
    means = rows.groupBy(*keys, period).agg(F.avg(value).alias("y"))
    own = means.withColumn("x", (F.row_number().over(Window.partitionBy(*keys).orderBy(period)) - 1).cast("double"))
    fit = own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.stddev_pop("y").alias("sy"),
    ).where(F.col("n") >= least)
    fit = fit.withColumn("s", F.col("sy") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("r2", F.lit(1.0)))))
    y = F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("step"))
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    return out.select(*keys, "step", F.round(y, 2).alias("value"), F.round(y - 1.96 * F.col("s"), 2).alias("low"), F.round(y + 1.96 * F.col("s"), 2).alias("high"), F.round("r2", 4).alias("r2"))


def cluster(rows: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Rows with a cluster number, by K-means over standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    own = VectorAssembler(inputCols=list(columns), outputCol="__v", handleInvalid="skip").transform(rows)
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(own).transform(own)
    return KMeans(featuresCol="__s", predictionCol="cluster", k=max(2, min(k, 10)), seed=seed).fit(scaled).transform(scaled).drop("__v", "__s")


def spec_patterns(spec: str) -> list[str]:
    """LIKE patterns for a specification: itself, with its multiplication signs open, with its two numbers only."""
    import re

    from ..functions.text import escape_like

    out = [f"%{escape_like(spec)}%"]
    if re.search(r"[×xX*]", spec):
        out.append("%" + "%".join(escape_like(p) for p in re.split(r"[×xX*]", spec)) + "%")
    if m := re.search(r"(\d+)[×xX*](\d+)", spec):
        out.append(f"%{m[1]}%{m[2]}%")
    return list(dict.fromkeys(out))


def fees(rates: DataFrame, amount: Column, rate: Column) -> DataFrame:
    """Fee amounts from an amount and a rate in percent."""
    return rates.withColumn("fee", F.round(amount * rate / 100, 2))


def price_query(rows: DataFrame, material: str, k: int, spec: str | None = None, ym: str | None = None, aliases: Sequence[str] = ()) -> DataFrame:
    """Prices of a material, by stages until one has rows: as asked, by alias, by spec alone, in the nearest earlier month, in the first later one."""
    from .tables import staged, top_k

    month = F.lit(True) if ym is None else (F.col("ym").startswith(ym + "-") if len(ym) == 4 else F.col("ym") == ym)
    like = F.lit(True)
    if spec:
        like = F.lit(False)
        for p in spec_patterns(spec):
            like = like | F.col("spec").ilike(p)
    named, also = F.lower("material") == material.lower(), F.lower("material").isin([a.lower() for a in aliases])
    stages = [rows.where(named & like & month), rows.where(also & like & month)]
    if spec:
        stages.append(rows.where(like & month & F.lower("material").contains(material.lower())))
    if ym:
        own = rows.where((named | also) & like)
        before, after = own.where(F.col("ym") < ym).agg(F.max("ym").alias("m")), own.where(F.col("ym") > ym).agg(F.min("ym").alias("m"))
        stages += [own.join(F.broadcast(x), own.ym == x.m, "left_semi") for x in (before, after)]
    return top_k(staged(stages), k, F.desc("ym"), F.col("price"), F.col("id"))


#: The unit and the price that a page may show after a material's name, below each other or side by side.
SHOWN = [r"\s*\n([A-Za-z0-9㎡mM\?³²/\"]{1,8})\s*\n(\d+\.\d{2})", r"\s+([A-Za-z0-9㎡mM\?³²/\"]{1,8})\s+(\d+\.\d{2})"]


def anchor_prices(chunks: DataFrame, questions: DataFrame, k: int, answered: DataFrame | None = None, score: float = 0.85) -> DataFrame:
    """(query_id, rank, doc_id, page, unit, price, score): prices that pages of text show for questions (query_id, material, ym) which no earlier stage has answered (query_id).

    A page is an anchor if one of its chunks (chunk_id, doc_id, page, content) holds both the material, regardless of case, and the month, as
    2024年3月价格. All chunks of an anchor page are joined in order of their ids, and the unit and price after the material are read there; pages
    come by number, then document, and the first k that show a price count. One automaton finds the materials of all questions; months are keys of the join.
    """
    from .dictionary import occurrences

    open_ = questions if answered is None else questions.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    open_ = open_.where("trim(material) <> '' and ym rlike '^[0-9]{4}-[0-9]{2}$'").withColumn("month", F.concat(F.substring("ym", 1, 4), F.lit("-"), F.substring("ym", 6, 2)))
    shown = r"((?:19|20)\d{2})年(\d{1,2})月价格"
    month = lambda x: F.concat(F.regexp_extract(x, shown, 1), F.lit("-"), F.lpad(F.regexp_extract(x, shown, 2), 2, "0"))
    dated = chunks.withColumn("months", F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(shown), F.lit(0)), month))).where(F.size("months") > 0)
    held = occurrences(dated, open_, F.col("content"), "material", ["doc_id", "page", "months"], once=True)
    anchors = held.select("doc_id", "page", F.explode("months").alias("month"), F.col("name").alias("low")).distinct()
    pages = anchors.join(open_.select("query_id", "material", "month", F.lower("material").alias("low")), ["month", "low"]).select("query_id", "material", "doc_id", "page").distinct()
    wanted = chunks.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    texts = wanted.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("x")).select("doc_id", "page", F.array_join(F.transform("x", lambda c: F.coalesce(c["content"], F.lit(""))), "\n").alias("text"))
    own = pages.join(texts, ["doc_id", "page"])
    quoted = F.regexp_replace("material", r"([^\p{L}\p{N}\s])", r"\\$1")
    read = lambda p, i: F.call_function("regexp_extract", F.col("text"), F.concat(quoted, F.lit(p)), F.lit(i))
    found = own.select("query_id", "doc_id", "page", *[F.coalesce(*[F.nullif(read(p, i), F.lit("")) for p in SHOWN]).alias(n) for n, i in (("unit", 1), ("price", 2))]).where("price is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("page", "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "page", "unit", "price", F.lit(score).alias("score"))
