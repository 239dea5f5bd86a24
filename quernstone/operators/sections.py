"""Sections of documents as intervals of their lines, and contexts of a line by them.

A heading of a level holds all lines up to the next heading of its level or a higher one (a smaller number), exclusive. So a line's
ancestors are the headings whose intervals it lies in, at most one a level, and windows along a document find them; lines
are never paired with headings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Deepest level of a heading. Lines on either side, scores by kind of context, characters of a whole context.
DEEPEST, AROUND = 6, 2
SCORES = {"section": 0.7, "parent": 0.6, "before": 0.5, "after": 0.5}
MOST_CHARS = 2000


def intervals(lines: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """lines (doc_id, pos, level, ...), level 0 or null for what is no heading, with end: the last place that a heading holds, null for other lines."""
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    ends = [F.when(F.col("level") == n, F.coalesce(F.min(F.when(F.col("level").between(1, n), F.col("pos"))).over(after) - 1, last)) for n in range(1, deepest + 1)]
    return lines.withColumn("end", F.coalesce(*ends))


def ancestors(lines: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """lines with above: the headings (level, pos) that hold a line, the highest first; a heading isn't its own ancestor."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = intervals(lines, deepest)
    held = [F.last(F.when(F.col("level") == n, F.struct("pos", "end")), ignorenulls=True).over(before) for n in range(1, deepest + 1)]
    own = own.withColumn("open", F.array(*held))
    each = F.transform("open", lambda x, i: F.when(x["end"] >= F.col("pos"), F.struct((i + 1).alias("level"), x["pos"].alias("pos"))))
    return own.withColumn("above", F.filter(each, lambda x: x.isNotNull())).drop("open")


def contexts(lines: DataFrame, around: int = AROUND, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, pos, kind, ref, score): the lines that a line is to be read with: its section's heading, the heading above that one, and the lines before and after, as many on either side."""
    along = Window.partitionBy("doc_id").orderBy("pos")
    own = ancestors(lines, deepest)
    n = F.size("above")
    ref = lambda kind, pos: F.when(pos.isNotNull(), F.struct(F.lit(kind).alias("kind"), pos.alias("ref"), F.lit(SCORES[kind]).alias("score")))
    near = [ref("before" if d < 0 else "after", F.lead("pos", d).over(along) if d > 0 else F.lag("pos", -d).over(along)) for d in range(-around, around + 1) if d]
    up = lambda i: F.when(n >= i, F.element_at("above", -i)["pos"])
    every = own.withColumn("x", F.array(ref("section", up(1)), ref("parent", up(2)), *near))
    return every.select("doc_id", "pos", F.explode(F.filter("x", lambda c: c.isNotNull())).alias("x")).select("doc_id", "pos", "x.*")


def with_context(lines: DataFrame, around: int = AROUND, most: int = MOST_CHARS, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, pos, context): a line's content, then those of its contexts, best first, joined by line breaks and cut at so many characters. Each other line counts once, as what it is best for."""
    refs = contexts(lines, around, deepest).groupBy("doc_id", "pos", "ref").agg(F.max("score").alias("score"))
    texts = lines.select("doc_id", F.col("pos").alias("ref"), F.col("content").alias("text"))
    gathered = refs.join(texts, ["doc_id", "ref"]).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ref", "text"))).alias("x"))
    whole = F.concat_ws("\n", "content", F.transform("x", lambda c: c["text"]))
    return lines.join(gathered, ["doc_id", "pos"], "left").select("doc_id", "pos", F.substring(whole, 1, most).alias("context"))
