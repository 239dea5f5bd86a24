"""Hybrid and cascade retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dictionary import occurrences
from ..operators.fusion import rrf

#: How many times k each leg fetches, by what is asked for (1 where nothing is given), and the least score of vectors.
FETCH = {
    "rule": {"vector": 1, "text": 3, "structured": 2, "literal": 3},
    "trend": {"vector": 1, "text": 1, "structured": 3, "literal": 1},
    "compare": {"vector": 1, "text": 2, "structured": 3, "literal": 2},
    "price": {"vector": 1, "text": 2, "structured": 3, "literal": 1},
}
LEAST_VECTOR = 0.40


def most_fetched(path: str, k: int) -> int:
    """Rows of a leg beyond which no intent fetches any."""
    return k * max(own.get(path, 1) for own in FETCH.values())


def fetched(legs: DataFrame, intents: DataFrame, k: int) -> DataFrame:
    """The rows of legs (path, query_id, chunk, rank, score) that each query's intent (query_id, intent) fetches from each path; vectors and views only from the least score on."""
    times = F.coalesce(*[F.when((F.col("intent") == i) & (F.col("path") == p), n) for i, own in FETCH.items() for p, n in own.items()], F.lit(1))
    near = ~F.col("path").isin("vector", "view") | (F.col("score") >= LEAST_VECTOR)
    return legs.join(intents, "query_id").where(near & (F.col("rank") <= times * k)).drop("intent")


def structured_hits(queries: DataFrame, rows: DataFrame, intents: DataFrame, k: int, score: float = 0.9) -> DataFrame:
    """(query_id, chunk, score) of the rows (chunk, p_partkey, name) whose name a question (query_id, query) holds, in order of their numbers, so many as its intent fetches; only intents that look for rows of tables get any."""
    named = occurrences(queries, rows.select("name").distinct(), F.col("query"), "name", ["query_id"], once=True)
    times = F.coalesce(*[F.when(F.col("intent") == i, F.lit(own["structured"])) for i, own in FETCH.items() if "structured" in own])
    found = named.select("query_id", "name").join(rows.withColumn("name", F.lower("name")), "name").join(intents, "query_id").where(times.isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("p_partkey"))
    return found.withColumn("r", rank).where(F.col("r") <= times * k).select("query_id", "chunk", F.lit(score).alias("score"))


def marked_hits(chunks: DataFrame, items: DataFrame, marker: str, strong: str, k: int, score: float = 0.97) -> DataFrame:
    """(query_id, chunk, score) of k chunks (chunk, content) with the item of a question (query_id, item) and a marker, those with the strong one first, then by number; where no chunk has both, of those with the item alone."""
    low = F.lower("content")
    marks = chunks.withColumns({"marked": low.contains(marker), "strong": low.contains(strong)})
    held = occurrences(marks, items, F.col("content"), "item", ["chunk", "marked", "strong"], once=True).withColumnRenamed("name", "item")
    by = Window.partitionBy("query_id")
    found = held.join(items.withColumn("item", F.lower("item")), "item").withColumn("anyone", F.max("marked").over(by))
    some = found.where("marked or not anyone")
    return some.withColumn("r", F.row_number().over(by.orderBy(F.desc("strong"), "chunk"))).where(F.col("r") <= k).select("query_id", "chunk", F.lit(score).alias("score"))


def hybrid(legs: DataFrame, k: int, gated: DataFrame | None = None) -> DataFrame:
    """The k best fused chunks of each query_id; rows of gated legs that fusion lacks come after them."""
    fused = rrf(legs, ["query_id"])
    if gated is not None:
        more = gated.join(fused.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti").groupBy("query_id", "chunk").agg(F.max("score").alias("score"))
        fused = fused.unionByName(more.withColumn("rrf_score", F.lit(None).cast("double")).withColumn("hits", F.lit(0)).withColumn("best_rank", F.lit(None).cast("int")))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rrf_score"), F.desc("score"), "chunk")
    return fused.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def cascade(seeds: DataFrame, graph: DataFrame, keyword: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Seeds (chunk, vector) scored further by graph counts and keyword scores; nothing but seeds comes out."""
    most = graph.agg(F.max("n").alias("most"))
    own = seeds.join(graph, "chunk", "left").join(keyword, "chunk", "left").crossJoin(F.broadcast(most))
    total = weights[0] * F.col("vector") + weights[1] * F.coalesce(F.col("n") / F.col("most"), F.lit(0.0)) + weights[2] * F.least(F.coalesce("score", F.lit(0.0)) / 10, F.lit(1.0))
    return own.select("chunk", F.round(total, 4).alias("score"))
