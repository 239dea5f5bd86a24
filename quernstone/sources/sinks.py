"""Writers that may run again: overwritten partitions, keyed upserts, logs of what is done."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import postings
from ..operators.tables import latest_per_key, upsert


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _swap(df: DataFrame, path: str) -> None:
    """Writes a table beside its old version, then puts it in its place.

    The old version is moved aside, not deleted, until the new one stands: whoever stops between finds it again by `exists`.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    fs, place = _fs(spark, path)
    new, old = (_fs(spark, path + end)[1] for end in (".new", ".old"))
    fs.delete(old, True)
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, place):
        raise OSError(f"can't put {path}.new in place")
    fs.delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; one that a swap left aside is put back first."""
    fs, place = _fs(spark, path)
    old = _fs(spark, path + ".old")[1]
    if not fs.exists(place) and fs.exists(old):
        fs.rename(old, place)
    return fs.exists(place)


def rebuild(df: DataFrame, path: str) -> None:
    """Delete, then write."""
    df.write.mode("overwrite").parquet(path)


def upsert_into(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column] = (), **keep) -> None:
    """New rows over those of the table at the path, the first of each key; see operators.tables.upsert."""
    if order:
        df = latest_per_key(df, keys, order)
    if exists(df.sparkSession, path):
        df = upsert(df.sparkSession.read.parquet(path), df, keys, **keep)
    _swap(df, path)


def delete_from(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """The table without the rows of the keys."""
    df = spark.read.parquet(path)
    _swap(df.join(keys.distinct(), keys.columns, "left_anti").select(*df.columns), path)


def once(spark: SparkSession, log: str, job: str, phase: str, key: str, work: Callable[[], None]) -> bool:
    """Runs work unless the log has (job, phase, key); says whether it ran."""
    row = spark.range(1).select(F.lit(job).alias("job"), F.lit(phase).alias("phase"), F.lit(key).alias("key"))
    if exists(spark, log) and spark.read.parquet(log).join(row, ["job", "phase", "key"], "left_semi").count():
        return False
    work()
    row.write.mode("append").parquet(log)
    return True


def stable_id(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def write_vectors(df: DataFrame, path: str, doc: str, chunk: str, buckets: int = 16) -> None:
    """Vectors under ids that hang on document and chunk alone, over those that are there; only buckets that get new ones are written again."""
    spark = df.sparkSession
    own = df.withColumn("id", stable_id(F.col(doc), F.col(chunk))).withColumn("bucket", F.pmod("id", F.lit(buckets)).cast("int"))
    if exists(spark, path):
        there = spark.read.parquet(path).join(F.broadcast(own.select("bucket").distinct()), "bucket", "left_semi")  # `buckets` rows at most
        rows = own.unionByName(there.join(own.select("id"), "id", "left_anti"), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(path + ".merged")
        own = spark.read.parquet(path + ".merged")
    own.write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(path)
    fs, merged = _fs(spark, path + ".merged")
    fs.delete(merged, True)


def write_postings(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content", buckets: int = 32) -> None:
    """An inverted index, in buckets by term."""
    own = postings(chunks, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def graph_tables(chunks: DataFrame, terms: Column) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of documents, chunks and the entities in them, each once."""
    own = chunks.select("doc_id", "chunk_id", F.explode(terms).alias("entity"))
    name = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"))
    vertices = own.select(F.inline(F.array(name("document", "doc_id"), name("chunk", "chunk_id"), name("entity", "entity")))).distinct()
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"))
    return vertices, own.select(F.inline(F.array(edge("has_chunk", "doc_id", "chunk_id"), edge("mentions", "chunk_id", "entity")))).distinct()


def mirror(df: DataFrame, put: Callable[[list], None], batch: int = 500) -> None:
    """Sends rows to another store in batches, from every partition."""

    def each(rows):
        held = []
        for r in rows:
            held.append(r.asDict())
            if len(held) == batch:
                put(held)
                held = []
        if held:
            put(held)

    df.foreachPartition(each)
