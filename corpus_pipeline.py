"""From documents to packed training sequences: toxic documents go, near-duplicates go, personal data is masked, sources are mixed, what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import mixing, packing, pii, simhash, toxicity
from quernstone.llm.common import cut
from quernstone.llm.queries import bucket, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below one half; it learns from the labels of the same folds as op10.

    Rows are decided each by its own text, so repeated rows go or stay together and ids don't matter; a null or
    empty text has the score of an empty window. An empty table gives an empty one.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(bucket(5) != 0))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, decided by row: the one with the smallest id, a null one last. Null and empty texts are copies of each other."""
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found spans replaced by their kinds and n_chars counted anew; a null text stays null and has a null n_chars."""
    return pii.redact(docs, pii.train(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What three quarters of the tokens hold by the tree's weights, each row once at most; rows that repeat are taken each for itself, null and empty texts only where a leaf's prefix passes them."""
    taken = mixing.mix(docs, mixing.tree(), mixing.tree_weights(), 3, 4, epochs=1, seed=7)
    return taken.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, one row each; a null or empty text is its end token alone."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The network's and the trees' decisions have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again by the next. Empty documents give no pieces; columns beside those of documents go along until the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
