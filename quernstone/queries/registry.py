"""Where queries are registered, and the views of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with the SQL that says the same."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Price records: a line's part, type and brand as material, specification and unit.
PRICES_SQL = """prices AS (
    SELECT l_orderkey * 10 + l_linenumber AS id, p_name AS material, p_type AS spec, p_brand AS unit,
           l_extendedprice / l_quantity AS price, strftime(l_shipdate, '%Y-%m') AS ym, l_shipdate
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("p_name").alias("material"), F.col("p_type").alias("spec"),
        F.col("p_brand").alias("unit"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.date_format("l_shipdate", "yyyy-MM").alias("ym"), "l_shipdate",
    )


#: Chunks: the lines of documents, numbered apart for up to ten million lines a document.
CHUNKS_SQL = """chunks AS (
    SELECT doc_id * 10000000 + pos AS chunk_id, doc_id, pos AS page, source, trim(line, ' ') AS content
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
    WHERE trim(line, ' ') <> ''
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select((F.col("doc_id") * 10000000 + F.col("p") + 1).alias("chunk_id"), "doc_id", (F.col("p") + 1).cast("long").alias("page"), "source", F.trim("line").alias("content")).where("content <> ''")


#: The token expression in DuckDB.
def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[一-龥]|[a-zA-Z0-9_À-ɏ]+')"
