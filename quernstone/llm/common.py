"""What the training-data operators share: shared-folder tables, byte columns, words."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", "quernstone")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lost executors cost nothing made before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; bytes methods know ASCII only, which is what is asked for."""
    return text.lower().split() if text else []


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(text: bytes | None, size: int = 1 << 22):
    """The text's words `[^\\x20\\x09-\\x0D]+` as they are, in lists from pieces of about so many bytes."""
    at = 0
    while text and at < len(text):
        blank = _BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def loose(column: str):
    """The column as an expression that hides how its table is dealt out, so that a join on it deals both sides anew and adaptive execution may split a hot key."""
    return (F.col(column) + F.lit(0)).alias(column)


def named(column: str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    """A 64-bit hash of these columns. Hash functions pass nulls over, so each value goes in with a mark of whether it is there; nested values go in as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map", "variant")}
    parts = [x for c in columns for x in (named(c).isNull(), F.to_json(F.struct(named(c))) if c in nested else named(c).cast("string"))]
    return F.xxhash64(F.lit(seed), *parts)


def many(batches, rows: int = 1 << 17):
    """Record batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its own ways
        return None


def tidy(work):
    """Makes a worker hand freed memory back to the system: workers live on after a task, and an executor pays for all of theirs.

    Large blocks get mappings of their own, which end when they are freed, and what small ones leave is trimmed in the end.
    """

    @functools.wraps(work)
    def run(batches):
        libc = _libc()
        if libc is not None and hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            gc.collect()
            if libc is not None and hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run
