"""An index of vectors by inverted lists: coarse centroids, and in each centroid's list the residuals in one byte a component.

Vectors are scaled to length one, so cosine is an inner product. A list is a partition of a table, and a
question reads only the lists that it probes. Residuals are scored first, from the narrow column of codes; whole
vectors are read for the best of these only, and their scores are exact. Each list's radius, the
greatest distance of its vectors from the centroid, bounds what it can hold: where a least score is asked for, lists out
of reach are left out and nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import dot, norm
from .tables import SENT_ROWS, in_blocks, with_each

#: Rows that centroids are fitted on at most, about; lists of an index at most; candidates scored exactly, for each row asked for.
SAMPLE_ROWS, MOST_LISTS, REFINE = 50_000, 4096, 8


def unit(vector: Column) -> Column:
    """The vector at length one; null where it is null, zero, or holds nulls or numbers that aren't finite."""
    size = norm(vector)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine & (size > 0), F.transform(vector, lambda x: x.cast("double") / size))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


@dataclass
class VectorIndex:
    """Where an index lies; rows has (id, unit, code, step, others..., list), lists has (list, centroid, radius, n)."""

    spark: SparkSession
    path: str
    schema: StructType | None = None

    @property
    def rows(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/rows")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def write_index(rows: DataFrame, path: str, id_col: str, vector_col: str, lists: int | None = None, others: tuple[str, ...] = (), seed: int = 42) -> VectorIndex:
    """Index every row with a sound vector, all of one length.

    Centroids come from K-means over a sample of about SAMPLE_ROWS rows; the square root of the number of rows is their number unless
    one is given, MOST_LISTS at most. Lists that are large are dealt over several files.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("unit"), *others).where("unit is not null").withColumn("ml", array_to_vector("unit"))
    n = own.count()
    k = max(1, min(MOST_LISTS, lists or round(n**0.5)))
    sample = own.select("ml") if n <= SAMPLE_ROWS else own.select("ml").sample(SAMPLE_ROWS / n, seed)
    if n and k > 1:
        model = KMeans(featuresCol="ml", predictionCol="list", k=k, seed=seed, maxIter=10).fit(sample)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        own = model.transform(own)
    else:
        dim = own.select(F.size("unit")).first()
        centres, own = [[0.0] * (dim[0] if dim else 1)], own.withColumn("list", F.lit(0))
    known = spark.createDataFrame(list(enumerate(centres)), "list int, centroid array<double>")
    # one row for each list, MOST_LISTS at most
    own = own.drop("ml").join(F.broadcast(known), "list").withColumn("rest", _minus(F.col("unit"), F.col("centroid")))
    step = F.array_max(F.transform("rest", F.abs)) / 127
    code = F.transform("rest", lambda x: F.when(F.col("step") > 0, F.round(x / F.col("step"))).otherwise(0).cast("tinyint"))
    own = own.withColumn("step", step).withColumn("code", code)
    own = own.select("id", "unit", "code", "step", F.sqrt(dot(F.col("rest"), F.col("rest"))).alias("away"), *others, "list")
    own.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    made = VectorIndex(spark, path, own.schema)
    sizes = made.rows.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    known.join(sizes, "list").write.mode("overwrite").parquet(f"{path}/lists")
    return made


def _questions(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", unit(F.col("q")).alias("q")).where("q is not null")


def _near_lists(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """Each question with each list: (query_id, q, list, near, radius), near being its product with the centroid."""
    # lists are MOST_LISTS rows at most
    return asked.crossJoin(F.broadcast(index.lists)).withColumn("near", dot(F.col("q"), F.col("centroid"))).drop("centroid", "n")


def _in_lists(index: VectorIndex, probes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the lists that some question probes, with the questions that do. The names of the lists come to the driver, so that only their partitions are read."""
    names = [r.list for r in probes.select("list").distinct().collect()]
    return index.rows.select(*columns, "list").where(F.col("list").isin(names)).join(F.broadcast(probes), "list")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, refine: int = REFINE) -> DataFrame:
    """Rows (query_id, rank, id, score): k of the nearest rows in the `probes` lists nearest to each question (query_id, q), but that of its own id, by exact cosine rounded to four places, ties to the smaller id."""
    out = None
    for block in in_blocks(_questions(queries), "query_id", max(1, SENT_ROWS // max(1, probes))):
        by = Window.partitionBy("query_id").orderBy(F.desc("near"), "list")
        chosen = _near_lists(index, block).withColumn("r", F.row_number().over(by)).where(F.col("r") <= probes).select("query_id", "q", "list", "near")
        coded = _in_lists(index, chosen, ["id", "code", "step"]).where(F.col("id") != F.col("query_id"))
        rough = coded.withColumn("rough", F.col("near") + F.col("step") * dot(F.col("q"), F.col("code"))).select("query_id", "list", "id", "rough")
        best = rough.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "id"))).where(F.col("r") <= k * refine)
        # the best are k * refine rows a question of a block
        exact = _in_lists(index, chosen, ["id", "unit"]).join(best.select("query_id", "list", "id"), ["query_id", "list", "id"]).withColumn("score", F.round(dot(F.col("q"), F.col("unit")), 4))
        got = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        out = got if out is None else out.unionByName(got)
    return out


def within(index: VectorIndex, queries: DataFrame, least: float, others: tuple[str, ...] = (), live: Column | None = None) -> DataFrame:
    """Rows (query_id, id, others..., score) of all rows whose cosine with a question, rounded to four places, is at least so great, but that of its own id; live says which rows count.

    A list is read only if its centroid and radius can reach that score, a whole vector only if its residual's code and what rounding may hide can.
    """
    floor = least - 0.5e-4 - 1e-9
    out = None
    for block in in_blocks(_questions(queries), "query_id", max(1, SENT_ROWS // 64)):
        chosen = _near_lists(index, block).where(F.col("near") + F.col("radius") >= floor).select("query_id", "q", "list", "near")
        rows = _in_lists(index, chosen, ["id", "unit", "code", "step", *others]).where(F.col("id") != F.col("query_id"))
        rows = rows if live is None else rows.where(live)
        hidden = F.col("step") * 0.5 * F.aggregate("q", F.lit(0.0), lambda s, x: s + F.abs(x))
        rows = rows.where(F.col("near") + F.col("step") * dot(F.col("q"), F.col("code")) + hidden >= floor)
        got = rows.withColumn("score", F.round(dot(F.col("q"), F.col("unit")), 4)).where(F.col("score") >= least).select("query_id", "id", *others, "score")
        out = got if out is None else out.unionByName(got)
    return out


def by_scan(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each question by a scan of all rows, ties to the smaller id: what an audit holds search against."""
    rows = index.rows.select("id", "unit")
    pairs = with_each(rows, _questions(queries), "query_id", F.col("id") != F.col("query_id")).select("query_id", "id", F.round(dot(F.col("q"), F.col("unit")), 4).alias("score"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of a scan that a search found as well; scores count, so ties may be any."""
    floors = exact.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    hits = found.join(floors, "query_id").where("score >= floor").groupBy("query_id").agg(F.count("*").alias("hits"))
    got = floors.join(hits, "query_id", "left").agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return (got.hits or 0) / got.n if got.n else 1.0


def audited(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.9) -> tuple[int, float]:
    """(probes, recall): the number of lists to probe, doubled until a search of these questions reaches the target against a scan. All lists are as good as a scan."""
    exact = by_scan(index, queries, k).select("query_id", "id", "score").persist()
    try:
        lists, probes = index.lists.count(), 1
        while True:
            got = recall(search(index, queries, k, probes), exact)
            if got >= target or probes >= lists:
                return probes, got
            probes = min(lists, probes * 2)
    finally:
        exact.unpersist()


def cached_answers(index: VectorIndex, queries: DataFrame, least: float, created: str, now: Column, ttl_seconds: int, k: int = 1) -> DataFrame:
    """Rows (query_id, rank, id, created, score): of the stored questions that aren't older than the time to live, and not stored after now, the k nearest to each question, at or above a least cosine."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(created))
    near = within(index, queries, least, (created,), (age >= 0) & (age <= ttl_seconds))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", created, "score")
