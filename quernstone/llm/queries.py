"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import doubling, fim, hnsw, kdtree, lattice, lexical, mixing, packing, pii, simhash, suffix, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.train(spark)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), mixing.tree(), mixing.tree_weights(), 3, 4, epochs=2, seed=7)
    return taken.select("doc_id", "__path.domain", "__path.lang", "__path.source", F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"))


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lattice.score(table(spark, sf_dir, "documents"), bucket(5) != 1, class_col="lang")
    return got.select("doc_id", F.coalesce(bucket(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def bucket(n: int):
    """crc32 of the id as text, modulo n: the folds that the models learn from and are held out of."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(bucket(5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.digest(doubling.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_top_k": op2_top_k, "op5_embedding_duplicates": op5_embedding_duplicates, "op6_simhash": op6_simhash, "op7_packing": op7_packing, "op8_pii": op8_pii, "op3_lattice_score": op3_lattice_score, "op4_warc": op4_warc, "op9_mixing": op9_mixing, "op10_toxicity": op10_toxicity, "op11_fill_in_middle": op11_fill_in_middle, "op12_lexical_search": op12_lexical_search, "op13_substring_dedup": op13_substring_dedup}
ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_substring_dedup": doubling.ORACLE,
    "op2_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
}
