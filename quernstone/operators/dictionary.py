"""All names of a dictionary that texts hold, in one pass over each text.

The dictionary is made into one automaton (all names at once, by their common beginnings and failure links), sent to
the tasks as its names and built once a task. A dictionary that is too large to send comes in blocks, each a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Names and characters of a block of the dictionary at most, about.
MOST_NAMES, MOST_CHARS = 200_000, 4_000_000
#: Characters of a text between which its matches go out, so that no batch holds those of a whole long text.
PIECE = 1 << 16


def automaton(names: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for n in names:
        made.add_word(n, n)
    made.make_automaton()
    return made


def blocks(names: DataFrame, name: str) -> Iterator[list[str]]:
    """The distinct names, in lower case and without null and empty ones, in lists of bounded size."""
    own = names.select(F.lower(F.col(name)).alias("name")).where("name <> ''").distinct()
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size.n // MOST_NAMES), -(-size.chars // MOST_CHARS))
    for i in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i)
        if found := [r.name for r in part.collect()]:
            yield found


def occurrences(rows: DataFrame, names: DataFrame, text: Column, name: str, keep: list[str], once: bool = False) -> DataFrame:
    """(keep..., name, start, end) for each place, from 0 in characters, where the text in lower case holds a name; the name in lower case.

    once: each name once a text, at its first place. Names may overlap. A null text holds none, nor does any text an empty name.
    """
    spark = rows.sparkSession
    own = rows.select(F.struct(*keep).alias("row"), F.lower(text).alias("text")).where("text is not null")
    schema = StructType([StructField("row", own.schema["row"].dataType), StructField("name", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    out = None
    for found in blocks(names, name):
        sent = spark.sparkContext.broadcast(found)

        def each(batches, sent=sent):
            made = automaton(sent.value)
            for b in batches:
                at: list[int] = []
                hits: list[tuple[str, int, int]] = []
                for i, t in enumerate(b.column("text").to_pylist()):
                    seen = set()
                    for last, n in made.iter(t):
                        if once:
                            if n in seen:
                                continue
                            seen.add(n)
                        at.append(i)
                        hits.append((n, last + 1 - len(n), last + 1))
                        if len(hits) >= PIECE:
                            yield batch(b, at, hits)
                            at, hits = [], []
                if hits:
                    yield batch(b, at, hits)

        def batch(b, at, hits):
            n, s, e = zip(*hits)
            return pa.record_batch([b.column("row").take(pa.array(at)), pa.array(n), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["row", "name", "start", "end"])

        got = own.mapInArrow(each, schema).select("row.*", "name", "start", "end")
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], StructType([*own.schema["row"].dataType.fields, *schema.fields[1:]])) if out is None else out


def longest(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of the places (keys..., name, start, end) of each text those that a reader from the left takes: the first, of those that begin together the longest, and on from its end.

    Runs of places that overlap are told apart first, and only inside a run is one place taken after the other; no run crosses a place that nothing covers.
    """
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "name")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "name"))).alias("x"))
    place = "struct<start: int, back: int, name: string>"
    start = F.struct(F.lit(-1).alias("upto"), F.array().cast(f"array<{place}>").alias("taken"))
    step = lambda s, p: F.when(p["start"] >= s["upto"], F.struct((-p["back"]).alias("upto"), F.concat(s["taken"], F.array(p)).alias("taken"))).otherwise(s)
    taken = grouped.select(*keys, F.explode(F.aggregate("x", start, step)["taken"]).alias("p"))
    return taken.select(*keys, F.col("p.name").alias("name"), F.col("p.start").alias("start"), (-F.col("p.back")).alias("end"))


def extracted(rows: DataFrame, names: DataFrame, text: Column, name: str, keys: list[str], most: int = 4) -> DataFrame:
    """(keys..., names): the first `most` different names of each text that has one, longest matches from left to right, blanks left out of the text."""
    packed = F.regexp_replace(F.replace(F.replace(text, F.lit("～"), F.lit("~")), F.lit("㎡"), F.lit("m²")), r"[\x20\x09-\x0D\u00a0\u3000]+", "")
    taken = longest(occurrences(rows, names, packed, name, keys), keys)
    first = taken.groupBy(*keys, "name").agg(F.min("start").alias("start"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "name"))).where(F.col("r") <= most)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("x")).select(*keys, F.col("x.name").alias("names"))
