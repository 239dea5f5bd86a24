"""Retrieval in stages: recall by several ways, one row a candidate, coarse rank, rerank, fuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fusion as FU
from ..operators.tables import latest_per_key

#: How many candidates each way brings; the graph is asked for questions about entities only.
RECALL = {"vector": 30, "keyword": 20, "graph": 10}


def recalled(legs: dict[str, DataFrame], entity: DataFrame) -> DataFrame:
    """(query_id, chunk, vector, keyword, graph): each candidate of the legs (query_id, chunk, rank, score) once, with the score of each way that brought it and 0 for the others. entity has the query_ids whose graph leg counts."""
    every = None
    for path, leg in legs.items():
        own = leg.where(F.col("rank") <= RECALL[path]).select("query_id", "chunk", F.lit(path).alias("path"), "score")
        if path == "graph":
            own = own.join(entity.select("query_id").distinct(), "query_id", "left_semi")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("query_id", "chunk").agg(*[F.coalesce(F.max(F.when(F.col("path") == p, F.col("score"))), F.lit(0.0)).alias(p) for p in RECALL])


def multi_stage(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, day: Column, today: Column, score: Callable[[list[str], list[str]], list[float]] = FU.overlap_scores) -> DataFrame:
    """(query_id, rank, chunk, coarse, rerank, score) of the k best: of the recalled candidates the 2 k best by coarse rank go to the pair scorer, and five factors are fused.

    queries has (query_id, query), chunks (chunk, content, ...); day is an expression over chunks. Texts are fetched for what is reranked only.
    """
    ranked = candidates.withColumn("coarse", F.round(FU.coarse(F.col("vector"), F.col("keyword"), F.col("graph")), 6))
    few = latest_per_key(ranked, ["query_id"], [F.desc("coarse"), F.col("chunk")], 2 * k)
    pairs = few.join(chunks.withColumn("day", day), "chunk").join(queries, "query_id")
    scored = FU.pair_slot(pairs, "query", "content", score).withColumn("rerank", F.round("rerank", 6))
    graph = F.when(F.col("graph") > 0, F.col("graph"))
    fused = scored.withColumn("score", F.round(FU.five_factor(F.col("rerank"), F.col("vector"), F.col("keyword"), graph, F.col("day"), today), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk", "coarse", "rerank", "score")
