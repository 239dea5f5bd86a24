"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources gets a token budget. Each node's capacity is what the
leaves below it can give in the epochs allowed. From the root down, a node's budget is dealt out
among its children by weight; a child that can't take its share is filled to capacity and its
shortage goes to its siblings, and only what no sibling can take is missing further up. Because
capacities are known before budgets, one pass down does this exactly, in whole tokens.

A leaf with budget b takes whole epochs while they fit, and of the next one the longest prefix, in
that epoch's seeded order, whose tokens fit. Where the prefix ends is found by going down: sums over
slices of the order name the slice that it ends in, sums inside that slice the id, and where many
rows share that id, sums over slices of a hash of the rows, then of single hashes. Rows that are
equal in all columns are one row with a count, so no leaf, id or group of copies is ever in one
task. Texts are not shuffled: what a leaf takes is told by the place where its prefix ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, row_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order, and of a row's hash, that name a slice.
SLICE = 3
#: Equal rows that one task makes at most, where a prefix ends among them.
STRETCH = 100_000
#: Leaves that a broadcast may hold.
BROADCAST_LEAVES = 20_000


def tokens(text: Column) -> Column:
    """Words of the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, doc: Column) -> Column:
    """Where a document stands in an epoch: a hash of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def _dealt(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds budget to nodes, which have cap, weight and their parent's budget as b."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap") / F.col("weight"), child)
    df = nodes.withColumn("i", F.row_number().over(order))
    df = df.withColumn("taken", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    df = df.withColumn("left_w", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = F.col("cap") * F.col("left_w") <= F.col("weight") * (F.col("b") - F.col("taken"))
    df = df.withColumn("first", F.min(F.when(~full, F.struct("i", "taken", "left_w"))).over(w))
    share = F.expr("(weight * (b - first.taken)) div first.left_w")
    short = F.col("first").isNotNull() & (F.col("i") >= F.col("first.i"))
    return df.withColumn("budget", F.when(short, share).otherwise(F.col("cap"))).drop("i", "taken", "left_w", "first", "b")


def budgets(sizes: DataFrame, path: Sequence[str], weights: Sequence[Column], numerator: int, denominator: int, epochs: int) -> DataFrame:
    """Leaves (path..., size, budget); sizes has (path..., size), weights one integer column for each level."""
    caps = sizes.withColumn("cap", F.col("size") * epochs)
    above = caps.agg(F.expr(f"least((coalesce(sum(size), 0) * {numerator}L) div {denominator}L, coalesce(sum(cap), 0))").alias("b"))
    for level, weight in enumerate(weights):
        parent, own = list(path[:level]), list(path[: level + 1])
        nodes = caps.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("size").alias("size")).withColumn("weight", weight.cast("long"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))
        dealt = _dealt(nodes, parent, path[level])
        above = dealt.select(*own, F.col("budget").alias("b"))
    return dealt.select(*path, "size", "budget")


def mix(docs: DataFrame, path: dict[str, Column], weights: Sequence[Column], numerator: int, denominator: int, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each row as often as it is taken, with __path (its place in the tree), __tokens and __epoch.

    The budget is numerator / denominator of all tokens. Null names in the path are empty ones; null
    texts have no tokens; a leaf without tokens takes none of its documents. Rows that repeat are taken each
    for itself, also where a prefix ends among equal rows. Rows that share an id, null ones among them, are ordered by a hash of all
    columns, nulls told apart. Columns of docs that have the names of the three new ones are replaced; other names may be anything.
    Whole-number division may leave a few tokens of a budget undealt, fewer than a node has children.
    """
    names, kept = list(path), [c for c in docs.columns if c not in ("__path", "__tokens", "__epoch")]
    own = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in path.items()]
    # the caller's columns travel in one struct, so that no name of theirs can clash
    every = F.lower(F.lpad(F.hex(row_hash(docs, kept, seed)), 16, "0"))
    rows = docs.select(F.struct(*own).alias("__path"), tokens(named(text_col)).alias("__tokens"), named(id_col).alias("__id"), every.alias("__all"), F.struct(*[named(c) for c in kept]).alias("__row"))
    sizes = rows.groupBy(*[F.col("__path")[n].alias(n) for n in names]).agg(F.sum("__tokens").alias("size"))
    plan = budgets(sizes, names, weights, numerator, denominator, epochs).where("size > 0")
    plan = cut(plan.select(F.struct(*names).alias("__path"), F.expr("budget div size").alias("whole"), F.expr("budget % size").alias("rest")), "budgets")
    # few leaves go to all tasks; many are joined by shuffling, where adaptive execution splits hot ones
    small = plan.count() <= BROADCAST_LEAVES
    to_all = F.broadcast if small else (lambda df: df)
    placed = rows.join(to_all(plan.where("rest > 0")), "__path").select("__path", "rest", place(seed, F.col("whole"), F.col("__id")).alias("at"), F.col("__all").alias("h"), F.col("__tokens").alias("n"))
    keyed = cut(placed.groupBy("__path", "rest", "at", "h", "n").agg(F.count("*").alias("m")), "places")
    slices = {"at_slice": F.substring("at", 1, SLICE), "at": F.col("at"), "h_slice": F.substring("h", 1, SLICE), "h": F.col("h")}
    here, known = keyed.withColumn("t", F.col("n") * F.col("m")), ["__path"]
    for level, of in slices.items():
        # the prefix ends in the first slice by whose end the rest is used up; only its rows are looked at further
        sums = here.withColumn(level, of).groupBy(*known, level).agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.max("n").alias("n"))
        upto = sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*known).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)))
        edge = upto.where("upto > rest").groupBy(*known).agg(F.min(F.struct(level, (F.col("rest") - (F.col("upto") - F.col("t"))).alias("left"), "n")).alias("e"))
        edge = cut(edge.select(*known, F.col("e")[level].alias(level), F.col("e.left").alias("left"), F.col("e.n").alias("n")), "edges")
        known.append(level)
        if level != "h":
            here = here.withColumn(level, of).drop("rest").join(to_all(edge.drop("n").withColumnRenamed("left", "rest")), known)
    # of the rows at the edge, equal in all columns, so many fit
    edge = edge.select("__path", F.struct("at", "h").alias("edge"), F.expr("left div n").alias("fit"))
    plan = cut(plan.join(edge, "__path", "left").select("__path", "whole", "edge", "fit"), "prefixes")
    torn = plan.where("fit > 0").count() > 0
    at = F.struct(place(seed, F.col("whole"), F.col("__id")).alias("at"), F.col("__all").alias("h"))
    taken = rows.join(to_all(plan), "__path").withColumn("__at", at)
    split = F.coalesce((F.col("__at") == F.col("edge")) & (F.col("fit") > 0), F.lit(False))
    count = F.col("whole") + F.coalesce((F.col("__at") < F.col("edge")).cast("long"), F.lit(0))
    out = taken.where(~split & (count > 0)).select("__row", "__path", "__tokens", F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("__epoch"))
    if torn:  # a prefix ends among rows that are equal in all columns: as many of them as fit have one epoch more
        same = taken.where(split).groupBy("__path").agg(*[F.first(c).alias(c) for c in ("__row", "__tokens", "whole", "fit")], F.count("*").alias("there"))
        # in stretches that are dealt out, for there may be very many of them
        stretches = same.withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.col("there"), F.lit(STRETCH)))).repartition("__path", "lo")
        same = stretches.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + (STRETCH - 1), "there"))))
        count = F.col("whole") + (F.col("i") <= F.col("fit")).cast("long")
        out = out.unionByName(same.where(count > 0).select("__row", "__path", "__tokens", F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("__epoch")))
    return out.select("__row.*", "__path", "__tokens", "__epoch")


#: The tree of the tables here: sources by number make up domains.
def tree() -> dict[str, Column]:
    n = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    domain = F.when(n < 8, "web").when(n < 14, "books").when(n.isNotNull(), "forum").otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def tree_weights() -> list[Column]:
    return [
        F.when(F.col("domain") == "web", 4).when(F.col("domain") == "books", 4).otherwise(2),
        F.when(F.col("lang") == "en", 5).otherwise(2),
        F.when(F.col("source") == "src0", 1).otherwise(2),
    ]


ORACLE = r"""
    WITH own AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER) AS nr,
               CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n
        FROM documents
    ), rows_ AS (
        SELECT *, CASE WHEN nr < 8 THEN 'web' WHEN nr < 14 THEN 'books' WHEN nr IS NOT NULL THEN 'forum' ELSE 'other' END AS domain FROM own
    ), leaf AS (
        SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS size, CAST(2 * sum(n) AS BIGINT) AS cap FROM rows_ GROUP BY ALL
    ), d0 AS (
        SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE WHEN domain IN ('web', 'books') THEN 4 ELSE 2 END AS w,
               (SELECT least(CAST(sum(size) AS BIGINT) * 3 // 4, CAST(sum(cap) AS BIGINT)) FROM leaf) AS b
        FROM leaf GROUP BY domain
    ), d1 AS (
        SELECT *, row_number() OVER o AS i, coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
               sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw
        FROM d0 WINDOW o AS (ORDER BY cap / w, domain)
    ), d2 AS (
        SELECT *, min(CASE WHEN cap * lw > w * (b - taken) THEN {'i': i, 't': taken, 'l': lw} END) OVER () AS f FROM d1
    ), d AS (
        SELECT domain, CAST(CASE WHEN f IS NOT NULL AND i >= f.i THEN w * (b - f.t) // f.l ELSE cap END AS BIGINT) AS b FROM d2
    ), l0 AS (
        SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, CASE WHEN lang = 'en' THEN 5 ELSE 2 END AS w, any_value(d.b) AS b
        FROM leaf JOIN d USING (domain) GROUP BY domain, lang
    ), l1 AS (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cap / w, lang) AS i,
               coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
               sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw
        FROM l0
    ), l2 AS (
        SELECT *, min(CASE WHEN cap * lw > w * (b - taken) THEN {'i': i, 't': taken, 'l': lw} END) OVER (PARTITION BY domain) AS f FROM l1
    ), l AS (
        SELECT domain, lang, CAST(CASE WHEN f IS NOT NULL AND i >= f.i THEN w * (b - f.t) // f.l ELSE cap END AS BIGINT) AS b FROM l2
    ), s0 AS (
        SELECT domain, lang, source, cap, size, CASE WHEN source = 'src0' THEN 1 ELSE 2 END AS w, l.b FROM leaf JOIN l USING (domain, lang)
    ), s1 AS (
        SELECT *, row_number() OVER (PARTITION BY domain, lang ORDER BY cap / w, source) AS i,
               coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
               sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw
        FROM s0
    ), s2 AS (
        SELECT *, min(CASE WHEN cap * lw > w * (b - taken) THEN {'i': i, 't': taken, 'l': lw} END) OVER (PARTITION BY domain, lang) AS f FROM s1
    ), s AS (
        SELECT domain, lang, source, size, CAST(CASE WHEN f IS NOT NULL AND i >= f.i THEN w * (b - f.t) // f.l ELSE cap END AS BIGINT) AS b FROM s2 WHERE size > 0
    ), placed AS (
        SELECT r.*, s.b // s.size AS whole, s.b % s.size AS rest,
               sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('7:', s.b // s.size, ':', doc_id)), doc_id ROWS UNBOUNDED PRECEDING) AS upto
        FROM rows_ r JOIN s USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(1, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END + 1)) AS epoch
    FROM placed
"""
