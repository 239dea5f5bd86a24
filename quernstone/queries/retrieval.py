"""Search, fusion, reranking, evaluation, graph walks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import fusion as FU
from ..operators import graph as G
from ..operators import search as S
from ..operators import tables as O
from ..operators import text_index as X
from ..operators.understanding import intent
from ..sources.shared import fresh_path
from .registry import CHUNKS_SQL, chunks, query, sql_tokens, t

_COS = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@query(f"""
    SELECT e.vec_id, e.label, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE e.vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 20
""")
def similar_chunks(spark, sf):
    return S.similar_rows(t(spark, sf, "embeddings"), 0, 20, "vec_id", "embedding").select("vec_id", "label", "score")


@query(f"""
    SELECT e.vec_id, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
    WHERE round({_COS}, 4) >= 0.1 ORDER BY score DESC, vec_id LIMIT 8
""")
def vector_search(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q")).limit(1)
    return S.vector_search(e.crossJoin(F.broadcast(q)), F.col("q"), 8, "vec_id", "embedding", 0.1).select("vec_id", "score")


@query(f"""
    WITH {CHUNKS_SQL}, k AS (SELECT chunk_id, {sql_tokens('content')} AS t FROM chunks)
    SELECT chunk_id, round(len(list_filter(t, lambda x: x IN ('the', 'that'))) / len(t), 6) AS score FROM k
    WHERE list_contains(t, 'the') AND list_contains(t, 'that') ORDER BY score DESC, chunk_id LIMIT 20
""")
def keyword_search(spark, sf):
    return S.keyword_search(chunks(spark, sf), "That the", 20).select("chunk_id", "score")


_BM25 = f"""
    toks AS (SELECT doc_id AS chunk, {sql_tokens('text')} AS t FROM documents WHERE len({sql_tokens('text')}) > 0),
    tot AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
    asked AS (SELECT item_id AS query_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark),
    post AS (SELECT term, chunk, length, count(*) AS tf FROM (SELECT chunk, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    scored AS (SELECT query_id, chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 4) AS score
               FROM asked JOIN post USING (term) JOIN dfs USING (term), tot GROUP BY 1, 2),
    bm AS (SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INTEGER) AS rank, score FROM scored)
"""


def _asked(spark, sf):
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, sf):
    """The vectors of the questions (query_id, q, ql): those of the benchmark items' numbers."""
    items = t(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    return t(spark, sf, "embeddings").join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("ql"))


def _rows(spark, sf):
    return O.spread(t(spark, sf, "embeddings"))


def _docs(spark, sf):
    return O.spread(t(spark, sf, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


@query(f"WITH {_BM25} SELECT query_id, chunk, rank, score FROM bm WHERE rank <= 10")
def bm25_search(spark, sf):
    return S.bm25(_docs(spark, sf), _asked(spark, sf), 10)


_GRAMS = """flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9À-ɏ一-龥]+'), lambda w: len(w) > 0),
    lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"""


@query(f"""
    WITH q AS (SELECT list_distinct({_GRAMS.format("'promo brushed'")}) AS g), p AS (SELECT p_partkey, {_GRAMS.format("p_type || ' ' || p_name")} AS t FROM part),
    e AS (SELECT p_partkey, g, unnest(flatten(list_transform(range(1, len(t) + 1), lambda i: list_transform(range(i, len(t) + 1), lambda j: list_distinct(t[i:j]))))) AS x FROM p, q),
    s AS (SELECT p_partkey, round(max(len(list_intersect(g, x)) / (len(g) + len(x) - len(list_intersect(g, x)))), 4) AS score FROM e GROUP BY 1)
    SELECT p_partkey, score FROM s WHERE score > 0.12 ORDER BY score DESC, p_partkey LIMIT 30
""")
def word_similarity(spark, sf):
    p = t(spark, sf, "part").withColumn("label", F.concat_ws(" ", "p_type", "p_name"))
    return S.word_similarity(p, "promo brushed", S.LEAST_TEXT, 30, "p_partkey", "label").select("p_partkey", "score")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, 0.72 AS score FROM chunks WHERE contains(lower(content), 'that the') ORDER BY length(content), chunk_id LIMIT 15")
def literal_search(spark, sf):
    return S.literal_search(chunks(spark, sf), "That the", 15).select("chunk_id", F.col("score").cast("decimal(3,2)").alias("score"))


@query("""
    WITH c AS (SELECT doc_id AS chunk_id, text AS content FROM documents), s AS (
        SELECT 0 AS stage, * FROM c WHERE contains(lower(content), 'that it') AND length(content) < 600 UNION ALL
        SELECT 1, * FROM c WHERE contains(lower(content), 'that it') AND length(content) < 1200 UNION ALL
        SELECT 2, * FROM c WHERE contains(lower(content), 'that'))
    SELECT chunk_id, stage, substr(content, 1, 300) AS snippet FROM s WHERE stage = (SELECT min(stage) FROM s) ORDER BY stage, length(content), chunk_id LIMIT 12
""")
def category_search(spark, sf):
    return S.category_search(_docs(spark, sf).select("chunk_id", "content"), "that it", 12).select("chunk_id", "stage", "snippet")


@query(f"""
    WITH {CHUNKS_SQL}, h AS (SELECT chunk_id, (contains(lower(content), 'for'))::INT AS s, length(content) AS n FROM chunks
        WHERE page BETWEEN 1 AND 5 AND (contains(lower(content), 'with') OR contains(lower(content), 'from')) ORDER BY s DESC, n, chunk_id LIMIT 12)
    SELECT chunk_id, CAST(row_number() OVER (ORDER BY s DESC, n, chunk_id) AS INTEGER) AS rank, CAST(round(greatest(0.75, 0.98 - 0.03 * (row_number() OVER (ORDER BY s DESC, n, chunk_id) - 1)), 4) AS DOUBLE) AS score FROM h
""")
def rule_clause_search(spark, sf):
    got = S.clause_search(chunks(spark, sf), ["with", "from"], F.col("page").between(1, 5), "for", 12)
    return got.select("chunk_id", "rank", "score")


@query("""
    WITH probes AS (SELECT 0 AS i, 'dark blue plate' AS p UNION ALL SELECT row_number() OVER (ORDER BY n DESC, s), substr('dark blue plate', s, n) FROM range(3, 8) x(n), range(1, 14) y(s) WHERE s <= 16 - n)
    SELECT p_partkey, CAST(min(i) AS INTEGER) AS probe FROM part, probes WHERE contains(lower(p_type || chr(10) || p_name), p) GROUP BY 1 ORDER BY probe, p_partkey LIMIT 10
""")
def fragment_search(spark, sf):
    return S.fragments(t(spark, sf, "part"), "dark blue plate", 10, "p_partkey", ["p_type", "p_name"]).select("p_partkey", "probe")


_INTENT = """CASE WHEN regexp_matches(lower(text), 'trend|change|趋势|走势|变化') THEN 'trend' WHEN regexp_matches(lower(text), 'compare|versus|difference|比较|对比|区别') THEN 'compare'
    WHEN regexp_matches(lower(text), 'price|cost|how much|价格|单价|多少钱|造价') THEN 'price' WHEN regexp_matches(lower(text), 'rule|clause|standard|rate|费率|规定|条款|标准') THEN 'rule'
    WHEN regexp_matches(lower(text), 'what is|define|meaning|什么是|定义|含义') THEN 'definition' ELSE 'general' END"""


def _legs_sql(legs, more=""):
    return f"""
    {_BM25}, emb AS (SELECT e.vec_id AS chunk, q.vec_id AS query_id, round({_COS}, 4) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q WHERE e.vec_id <> q.vec_id),
    vec AS (SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INTEGER) AS rank, score FROM emb),
    lit AS (SELECT b.item_id AS query_id, d.doc_id AS chunk, CAST(row_number() OVER (PARTITION BY b.item_id ORDER BY length(d.text), d.doc_id) AS INTEGER) AS rank, 0.72 AS score
            FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
    {more}
    legs AS ({legs}),
    fused AS (SELECT query_id, chunk, round(sum(1 / (60.0 + rank)), 6) AS rrf_score, CAST(count(DISTINCT path) AS INTEGER) AS hits, min(rank) AS best_rank,
                     round(least(0.99, max(score) + least(0.12, 8 * sum(1 / (60.0 + rank)) + 0.03 * (count(DISTINCT path) - 1))), 4) AS score FROM legs GROUP BY 1, 2)
"""


_LEGS = _legs_sql("SELECT 'text' AS path, * FROM bm WHERE rank <= 20 UNION ALL SELECT 'vector', * FROM vec WHERE rank <= 20 UNION ALL SELECT 'literal', * FROM lit WHERE rank <= 10")
_BY_INTENT = _legs_sql("""
        SELECT 'text' AS path, bm.* FROM bm JOIN kinds USING (query_id) WHERE rank <= 8 * CASE intent WHEN 'rule' THEN 3 WHEN 'compare' THEN 2 WHEN 'price' THEN 2 ELSE 1 END UNION ALL
        SELECT 'vector', vec.* FROM vec WHERE rank <= 8 AND score >= 0.4 UNION ALL
        SELECT 'view', * FROM view_leg WHERE rank <= 8 AND score >= 0.4""", f"""
    pages AS (SELECT page, list(a ORDER BY i) AS embedding FROM (SELECT vec_id // 4 AS page, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
    seen AS (SELECT e.page * 4 AS chunk, q.vec_id AS query_id, round({_COS}, 4) AS score FROM pages e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q WHERE e.page <> q.vec_id // 4),
    view_leg AS (SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INTEGER) AS rank, score FROM seen),""")


_STORED: dict[tuple[str, str], X.TextIndex] = {}


def stored_index(spark, sf):
    """The text index of the documents, written once a session and folder; questions read buckets of it and no text."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = X.write_index(_docs(spark, sf), fresh_path(spark, "documents"), {"content": "content"})
    return _STORED[key]


def legs(spark, sf, words=20, near=20, held=10):
    """Ranked lists of three paths for all benchmark items: BM25 by a stored index, the vector of the same number, literal hits, each of so many rows."""
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    text = X.search(stored_index(spark, sf), asked, words, {"content": 1.0}, 0.0)
    vector = S.nearest(_rows(spark, sf), _vectors(spark, sf), near, "vec_id", "embedding").withColumnRenamed("id", "chunk")
    hits = S.literal_matches(docs.select("chunk_id", "content", F.length("content").alias("size")), asked, keep=["chunk_id", "size"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("size", "chunk_id"))
    literal = hits.withColumn("rank", rank).where(F.col("rank") <= held).select("query_id", F.col("chunk_id").alias("chunk"), "rank", F.lit(0.72).alias("score"))
    named = lambda df, path: df.select(F.lit(path).alias("path"), "query_id", "chunk", "rank", "score")
    return FU.union([named(text, "text"), named(vector, "vector"), named(literal, "literal")])


_TAILS = (" price", " trend of cost", " compare", " clause", " what is it", "")


@query(f"""
    WITH kinds AS (SELECT query_id, {_INTENT} AS intent FROM (SELECT item_id AS query_id, text || [' price', ' trend of cost', ' compare', ' clause', ' what is it', ''][item_id % 6 + 1] AS text FROM benchmark)), {_BY_INTENT},
    gate AS (SELECT query_id, intent, b.text, (SELECT w FROM (SELECT unnest({sql_tokens('b.text')}) AS w) ORDER BY length(w) DESC, w LIMIT 1) AS item FROM kinds JOIN benchmark b ON item_id = query_id),
    held AS (SELECT lit.query_id, chunk, score FROM lit JOIN kinds USING (query_id) WHERE rank <= 8 * CASE intent WHEN 'rule' THEN 3 WHEN 'compare' THEN 2 ELSE 1 END),
    structured AS (SELECT query_id, -1 - p_partkey AS chunk, 0.9 AS score FROM gate JOIN part ON contains(lower(text), split_part(p_name, ' ', 2)) WHERE intent IN ('rule', 'trend', 'compare', 'price')
                   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) <= 8 * CASE intent WHEN 'rule' THEN 2 ELSE 3 END),
    named AS (SELECT query_id, doc_id AS chunk, contains(lower(d.text), 'the') AS marked, contains(lower(d.text), 'the and') AS strong FROM gate JOIN documents d ON contains(lower(d.text), item) WHERE intent = 'rule'),
    formula AS (SELECT query_id, chunk, 0.97 AS score FROM (SELECT *, max(marked) OVER (PARTITION BY query_id) AS anyone FROM named) WHERE marked OR NOT anyone
                QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY strong DESC, chunk) <= 8),
    gated AS (SELECT query_id, chunk, max(score) AS score FROM (SELECT * FROM held UNION ALL SELECT * FROM structured UNION ALL SELECT * FROM formula) g WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = g.query_id AND f.chunk = g.chunk) GROUP BY 1, 2),
    every AS (SELECT query_id, chunk, rrf_score, hits, best_rank, score FROM fused UNION ALL SELECT query_id, chunk, NULL, 0, NULL, score FROM gated)
    SELECT query_id, chunk, rrf_score, hits, best_rank, CAST(score AS DOUBLE) AS score FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, score DESC, chunk) <= 30
""")
def hybrid_search(spark, sf):
    """The thirty best of all questions: text, vectors and views of pages are fused; literal hits, and price rows and rule texts where the question's intent lets them, come after. Price rows have negative numbers."""
    from ..plans import hybrid as H

    k, docs, asked = 8, _docs(spark, sf), _asked(spark, sf)
    tails = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("query_id") % 6 + 1).cast("int"))
    intents = asked.select("query_id", intent(F.concat("query", tails)).alias("intent"))
    three = legs(spark, sf, *[H.most_fetched(path, k) for path in ("text", "vector", "literal")])
    fused = FU.union([three.where("path <> 'literal'"), page_views(spark, sf, k)])
    literal = H.fetched(three.where("path = 'literal'"), intents, k).select("query_id", "chunk", "score")
    part = t(spark, sf, "part").select((-1 - F.col("p_partkey")).alias("chunk"), "p_partkey", F.split("p_name", " ")[1].alias("name"))
    few = O.latest_per_key(part, ["name"], [F.col("p_partkey")], H.most_fetched("structured", k))
    structured = H.structured_hits(asked, few, intents, k)
    item = F.element_at(F.array_sort(F.transform(T.tokens(F.col("query")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    formula = H.marked_hits(docs.select(F.col("chunk_id").alias("chunk"), "content"), asked.join(intents.where("intent = 'rule'"), "query_id").select("query_id", item.alias("item")), "the", "the and", k)
    return H.hybrid(H.fetched(fused, intents, k), 30, FU.union([literal, structured, formula]))


def page_views(spark, sf, k):
    """The leg of page views: pages are four vectors in a row and seen as their mean, and stand for their first chunk."""
    e = t(spark, sf, "embeddings").where("embedding is not null").select(F.expr("vec_id div 4").alias("page"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    added = F.aggregate("all", F.transform(F.element_at("all", 1), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    pages = e.groupBy("page").agg(F.collect_list("v").alias("all")).select("page", F.transform(added, lambda x: x / F.size("all")).alias("v"))
    pairs = O.with_each(pages, _vectors(spark, sf).select("query_id", "q"), "query_id", F.col("page") != F.expr("query_id div 4"))
    scored = pairs.select("query_id", (F.col("page") * 4).alias("chunk"), F.round(cosine(F.col("v"), F.col("q")), 4).alias("score")).where("score is not null")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk"))).where(F.col("rank") <= k)
    return ranked.select(F.lit("view").alias("path"), "query_id", "chunk", "rank", "score")


@query(f"WITH {_LEGS} SELECT query_id, chunk, rrf_score, hits, best_rank, score FROM fused")
def rrf_fusion(spark, sf):
    return FU.rrf(legs(spark, sf), ["query_id"])


@query(f"""
    WITH {_LEGS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, hits DESC, score DESC, chunk) AS n FROM fused)
    SELECT query_id, chunk, 'fused' AS via FROM o WHERE n <= 5 UNION ALL
    SELECT DISTINCT l.query_id, l.chunk, 'guaranteed' FROM legs l WHERE rank <= 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = l.query_id AND o.chunk = l.chunk AND n <= 5)
""")
def rrf_with_guarantees(spark, sf):
    return FU.rrf_guaranteed(legs(spark, sf), 5, 2, ["query_id"])


@query(f"""
    WITH {_LEGS} SELECT chunk, round(sum(CASE WHEN path = 'vector' THEN 0.6 ELSE 0.4 END / (60 + rank)), 6) AS score FROM legs GROUP BY 1
""")
def weighted_rrf(spark, sf):
    return FU.weighted_rrf(legs(spark, sf), 0.6, 0.4, "vector")


@query(f"""
    WITH {_LEGS}, c AS (SELECT query_id, chunk, max(CASE WHEN path = 'vector' THEN score END) AS vector, max(CASE WHEN path = 'text' THEN score / 100 END) AS keyword FROM legs GROUP BY 1, 2)
    SELECT query_id, chunk, floor(rrf_score * (CAST(w[1] AS DOUBLE) * coalesce(vector, 0.5) + CAST(w[2] AS DOUBLE) * 0.5 + CAST(w[3] AS DOUBLE) * coalesce(keyword, 0.5)) * 1000000 + 0.5) / 1000000 AS weighted
    FROM (SELECT f.query_id, f.chunk, f.rrf_score, c.vector, c.keyword, CASE WHEN regexp_matches(b.text, '[0-9]{{4,}}|^[0-9]+$') THEN [0.3, 0.2, 0.5] WHEN regexp_matches(b.text, '[工程|费率|标准|系数|费用]') THEN [0.4, 0.4, 0.2]
                 WHEN length(b.text) > 20 THEN [0.5, 0.3, 0.2] ELSE [0.4, 0.3, 0.3] END AS w
          FROM fused f JOIN c USING (query_id, chunk) JOIN benchmark b ON b.item_id = f.query_id)
""")
def adaptive_fusion(spark, sf):
    score = lambda path: F.when(F.col("path") == path, F.col("score"))
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fused = FU.rrf(legs(spark, sf), ["query_id"], vector=F.max(score("vector")), keyword=F.max(score("text") / 100))
    fused = fused.join(asked, "query_id").withColumn("graph", F.lit(None).cast("double"))
    return FU.weighted_fusion(fused, FU.adaptive_weights(F.col("text"))).select("query_id", "chunk", "weighted")


@query(f"""
    WITH {_LEGS}, c AS (SELECT query_id, chunk, max(CASE WHEN path = 'vector' THEN score END) AS v, max(CASE WHEN path = 'text' THEN score END) AS k FROM legs GROUP BY 1, 2)
    SELECT query_id, chunk, round(0.3 * coalesce(v, 0) + 0.2 * least(coalesce(k, 0) / 30, 1), 6) AS linear, round(0.6 * coalesce(v, 0) + 0.4 * coalesce(k, 0) / 30, 6) AS fallback,
           round(0.4 / (1 + exp(-coalesce(v, 0))) + 0.3 * (coalesce(v, 0) + 1) / 2 + 0.2 * least(coalesce(k, 0) / 10, 1) + 0.05 * 0.5 + 0.05 * exp(-ln(2) * (chunk % 700) / 365), 6) AS five,
           round(0.5 * coalesce(v, 0) + 0.3 * least(coalesce(k, 0) / 10, 1), 6) AS coarse
    FROM c
""")
def score_fusion(spark, sf):
    own = legs(spark, sf).groupBy("query_id", "chunk").agg(F.max(F.when(F.col("path") == "vector", F.col("score"))).alias("v"), F.max(F.when(F.col("path") == "text", F.col("score"))).alias("k"))
    v, k = F.coalesce("v", F.lit(0.0)), F.coalesce("k", F.lit(0.0))
    today = F.lit("2024-01-01").cast("date")
    day = F.date_sub(today, (F.col("chunk") % 700).cast("int"))
    r = lambda c, n: F.round(c, 6).alias(n)
    none = F.lit(None).cast("double")
    return own.select(
        "query_id", "chunk", r(FU.linear(none, F.col("v"), F.least(k / 30, F.lit(1.0))), "linear"), r(FU.fallback(F.col("v"), k / 30), "fallback"), r(FU.five_factor(v, v, k, none, day, today), "five"), r(FU.coarse(v, k, F.lit(0.0)), "coarse")
    )


_PAIRS = f"""
    pairs AS (SELECT query_id, chunk, bm.score / 100 AS score, list_distinct({sql_tokens('d.text')}) AS t, list_distinct({sql_tokens('b.text')}) AS q, d.text AS content
              FROM bm JOIN documents d ON d.doc_id = chunk JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)
"""


def _top10(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    top = S.bm25(docs, asked, 10).withColumn("score", F.col("score") / 100)
    return top.join(docs.select(F.col("chunk_id").alias("chunk"), "content"), "chunk").join(asked, "query_id")


@query(f"""
    WITH {_BM25}, {_PAIRS}, raw AS (SELECT query_id, chunk, round(0.7 * len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) + 0.3 * score, 6) AS r FROM pairs)
    SELECT query_id, chunk, round(CASE WHEN max(r) OVER w = min(r) OVER w THEN 0.5 ELSE (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END, 6) AS reranked
    FROM raw WINDOW w AS (PARTITION BY query_id)
""")
def jaccard_rerank(spark, sf):
    return FU.jaccard_rerank(_top10(spark, sf), F.col("query"), ["query_id"]).select("query_id", "chunk", "reranked")


@query()
def diversity_rerank(spark, sf):
    return FU.diversify(_top10(spark, sf), 5)


@query(f"""
    WITH r AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 4) DESC, e.vec_id) AS rank
               FROM embeddings e JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id),
    rel AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk FROM embeddings e JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id AND e.label = q.label),
    top AS (SELECT r.*, (rel.chunk IS NOT NULL)::INT AS hit FROM r LEFT JOIN rel USING (query_id, chunk) WHERE rank <= 10),
    g AS (SELECT query_id, sum(hit) AS hits, sum(hit / log2(rank + 1)) AS dcg, min(CASE WHEN hit = 1 THEN rank END) AS first FROM top GROUP BY 1),
    w AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
    SELECT query_id, coalesce(round(hits / 10, 6), 0) AS precision, coalesce(round(hits / n, 6), 0) AS recall, coalesce(round(1 / first, 6), 0) AS mrr,
           coalesce(round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6), 0) AS ndcg
    FROM w LEFT JOIN g USING (query_id)
""")
def ir_metrics(spark, sf):
    pairs = S.against_all(_rows(spark, sf), _vectors(spark, sf), "vec_id", "embedding").select("query_id", F.col("vec_id").alias("chunk"), "label", "ql", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk"))
    return FU.ir_metrics(pairs.withColumn("rank", rank), pairs.where("label = ql").select("query_id", "chunk"), 10)


@query(f"""
    WITH {_BM25}, x AS (SELECT query_id, rank, d.text AS content, bm.score / 100 AS score, length(d.text) // 3 AS cost FROM bm JOIN documents d ON d.doc_id = chunk WHERE rank <= 8),
    r AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM x), o AS (SELECT *, (used > 2000)::INT AS over, sum((used > 2000)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS overs FROM r)
    SELECT query_id, rank, CAST(CASE WHEN overs = 0 THEN length(content) ELSE least(length(content), (2000 - (used - cost)) * 3) END AS BIGINT) AS chars FROM o
    WHERE overs = 0 OR (overs = 1 AND over = 1 AND (2000 - (used - cost)) * 3 > 200 AND score > 0.05)
""")
def token_budget(spark, sf):
    own = _top10(spark, sf).select("query_id", "rank", "content", "score")
    return S.token_budget(own, ["query_id"], 2000, sure=0.05).select("query_id", "rank", F.length("content").cast("long").alias("chars"))


@query("""
    WITH c AS (SELECT event_id AS chunk_id, user_id, CASE event_id % 4 WHEN 0 THEN 'pgvector' WHEN 1 THEN 'fulltext' WHEN 2 THEN 'fee' ELSE 'other' END AS source, value / 400 AS score FROM events),
    m AS (SELECT *, score >= CASE source WHEN 'pgvector' THEN 0.4 WHEN 'fulltext' THEN 0.01 WHEN 'fee' THEN 0 ELSE 0.4 END AS ok, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, chunk_id) AS best FROM c)
    SELECT chunk_id, user_id, source, score FROM (SELECT *, max(ok::INT) OVER (PARTITION BY user_id) AS anyone FROM m) WHERE ok OR (anyone = 0 AND best = 1)
""")
def source_thresholds(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("pgvector", "fulltext", "fee", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    own = t(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), "user_id", kind.alias("source"), (F.col("value") / 400).alias("score"))
    return S.source_threshold(own, ["user_id"])


_EDGES = "edges AS (SELECT DISTINCT o_custkey AS source, o2 AS target FROM (SELECT o_custkey, lead(o_custkey) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS o2 FROM orders) WHERE o2 IS NOT NULL AND o2 <> o_custkey)"


def _edges(spark, sf):
    o = t(spark, sf, "orders")
    block = Window.partitionBy(F.expr("o_orderkey div 64")).orderBy("o_orderkey")
    own = o.select(F.col("o_custkey").alias("source"), F.lead("o_custkey").over(block).alias("target"))
    return own.where("target is not null and source <> target").distinct()


@query(f"""
    WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT DISTINCT source, 0 FROM edges WHERE source = (SELECT min(source) FROM edges) UNION SELECT target, depth + 1 FROM w JOIN edges ON source = node WHERE depth < 3)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1
""")
def recursive_expansion(spark, sf):
    e = _edges(spark, sf)
    first = e.agg(F.min("source").alias("m"))
    marked = e.crossJoin(F.broadcast(first))
    return G.walk(marked, F.col("source") == F.col("m"), 3)


@query(f"WITH {_EDGES} SELECT source, target FROM edges UNION SELECT target, source FROM edges")
def symmetric_closure(spark, sf):
    return G.closed(_edges(spark, sf))


_TREE = "tree AS (SELECT r_name AS path FROM region UNION ALL SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT r_name || '/' || n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""
    WITH {_TREE}, own AS (SELECT min(path) AS p FROM tree WHERE len(string_split(path, '/')) = 2)
    SELECT path, CASE WHEN path = string_split(p, '/')[1] THEN 'parent' WHEN starts_with(path, p || '/') THEN 'child' ELSE 'sibling' END AS relation
    FROM tree, own WHERE path <> p AND (path = string_split(p, '/')[1] OR (starts_with(path, p || '/') AND len(string_split(path, '/')) = 3) OR (starts_with(path, string_split(p, '/')[1] || '/') AND len(string_split(path, '/')) = 2))
""")
def upstream_downstream(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    two = n.select(F.concat_ws("/", "r_name", "n_name").alias("path"), "n_nationkey")
    three = t(spark, sf, "customer").join(two, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "path", "c_mktsegment").alias("path")).distinct()
    tree = t(spark, sf, "region").select(F.col("r_name").alias("path")).unionByName(two.select("path")).unionByName(three)
    return G.tree_relatives(tree, two.agg(F.min("path")).first()[0])


def _words_sql(n):
    return f"list_distinct(list_filter({sql_tokens(f'substr(text, 1, {n})')}, lambda w: length(w) >= 4))"


@query(f"""
    WITH d AS (SELECT doc_id, source, lang, source || '-' || lang AS section, {_words_sql(400)} AS t4, {_words_sql(200)} AS t2 FROM documents),
    q AS (SELECT e.vec_id, e.embedding, d.source AS concept FROM embeddings e JOIN d ON d.doc_id = e.vec_id WHERE e.vec_id IN (SELECT item_id FROM benchmark)),
    near AS (SELECT * FROM (SELECT q.vec_id AS query_id, q.concept, e.vec_id AS chunk, round({_COS}, 4) AS score FROM embeddings e, q WHERE e.vec_id <> q.vec_id)
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) <= 30),
    found AS (SELECT query_id, concept, unnest([source, lang]) AS term, score * 0.95 AS s, 'path' AS source, 0 AS way FROM near JOIN d ON doc_id = chunk
              UNION ALL SELECT query_id, concept, section, score * 0.9, 'section', 1 FROM near JOIN d ON doc_id = chunk
              UNION ALL SELECT query_id, concept, term, score * 0.7, 'term', 2 FROM (SELECT query_id, concept, score, unnest(t4) AS term FROM near JOIN d ON doc_id = chunk) WHERE NOT contains(term, concept)),
    one AS (SELECT query_id, concept, term, max(s) AS s, arg_min(source, way) AS source, min(way) AS way FROM found WHERE term <> concept AND length(term) >= 2 GROUP BY ALL),
    seeds AS (SELECT query_id, concept, term FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, term) <= 3),
    pick AS (SELECT s.query_id, s.concept, s.term AS seed, min(chunk) AS chunk FROM seeds s JOIN near n ON n.query_id = s.query_id JOIN d ON doc_id = chunk
           WHERE s.term = d.source OR s.term = d.lang OR s.term = section OR list_contains(t4, s.term) GROUP BY ALL),
    v AS (SELECT query_id, concept, seed, embedding FROM pick JOIN embeddings ON vec_id = chunk),
    hop AS (SELECT * FROM (SELECT q.query_id, q.concept, q.seed, e.vec_id AS chunk, round({_COS}, 4) AS score FROM embeddings e, v q)
            QUALIFY row_number() OVER (PARTITION BY query_id, seed ORDER BY score DESC, chunk) <= 5),
    more AS (SELECT query_id, concept, term, score * 0.5 AS s, 'hop2' AS source, 3 AS way FROM (SELECT query_id, concept, seed, score, unnest(t2) AS term FROM hop JOIN d ON doc_id = chunk) WHERE term <> concept AND term <> seed),
    two AS (SELECT query_id, term, max(s) AS s, arg_min(source, way) AS source FROM (SELECT * FROM one UNION ALL SELECT * FROM more) GROUP BY 1, 2)
    SELECT query_id, term, round(s, 4) AS score, source FROM two QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, term) <= 15
""")
def concept_neighbors(spark, sf):
    """For the source of each question's document, by its vector: terms in two hops."""
    words = lambda n: F.array_distinct(F.filter(T.tokens(F.substring("text", 1, n)), lambda w: F.length(w) >= 4))
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("name"), F.concat_ws("/", "source", "lang").alias("path"), F.concat_ws("-", "source", "lang").alias("section"), words(400).alias("terms"), words(200).alias("more_terms"))
    e = _rows(spark, sf)
    top = lambda pairs, keys, n: pairs.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= n)
    near = top(S.against_all(e, _vectors(spark, sf), "vec_id", "embedding").select("query_id", "vec_id", "score"), ["query_id"], G.NEAR).join(d, "vec_id")
    near = near.join(d.select(F.col("vec_id").alias("query_id"), F.col("name").alias("asked")), "query_id")

    def vectors(seeds):
        every = near.select("query_id", "vec_id", F.explode(F.array_union(F.array_union(F.split("path", "/"), F.array("section")), "terms")).alias("term"))
        first = every.join(seeds, ["query_id", "term"]).groupBy("query_id", "term").agg(F.min("vec_id").alias("vec_id"))
        return first.join(t(spark, sf, "embeddings"), "vec_id").select("query_id", "term", F.col("embedding").alias("q"))

    def nearest(asked, n):
        pairs = O.with_each(e, asked, "query_id").select("query_id", "term", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 4).alias("score"))
        return top(pairs, ["query_id", "term"], n).join(d.select("vec_id", "more_terms"), "vec_id")

    return G.concept_walk(near, F.col("asked"), vectors, nearest, 2, 15)


@query("""
    WITH c AS (SELECT lower(trim(p_name)) AS normalized, arg_max(p_name, p_name) AS concept_name FROM part GROUP BY 1),
    ev AS (SELECT lower(trim(p_name)) AS concept, CASE WHEN l_linenumber % 2 = 0 THEN 'price' ELSE 'text' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey),
    d AS (SELECT region.r_regionkey AS def_id, (SELECT min(normalized) FROM c WHERE normalized >= chr(97 + r_regionkey * 3)) AS name FROM region),
    hit AS (SELECT def_id, normalized, concept_name, max((normalized = name)::INT) OVER (PARTITION BY def_id, normalized) AS exact FROM d JOIN c ON contains(normalized, name) OR contains(name, normalized)),
    n AS (SELECT def_id, normalized, concept_name, exact, count(kind) AS links, count(*) FILTER (kind = 'price') AS prices, count(*) FILTER (kind = 'text') AS texts FROM hit LEFT JOIN ev ON concept = normalized GROUP BY ALL)
    SELECT def_id, concept_name, links, prices, texts FROM (SELECT *, row_number() OVER (PARTITION BY def_id ORDER BY exact DESC, links DESC, normalized) AS i FROM n) WHERE i = 1
""")
def concept_hit(spark, sf):
    part = t(spark, sf, "part")
    c = G.concepts(part, "p_name")
    ev = t(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.lower(F.trim("p_name")).alias("concept"), F.when(F.col("l_linenumber") % 2 == 0, "price").otherwise("text").alias("evidence_kind"))
    starts = t(spark, sf, "region").select(F.col("r_regionkey").alias("def_id"), F.char(97 + F.col("r_regionkey") * 3).alias("from"))
    d = starts.join(c, F.col("normalized") >= F.col("from")).groupBy("def_id").agg(F.min("normalized").alias("name"))
    return G.concept_hits(c, ev, d).select("def_id", "concept_name", "links", "prices", "texts")


@query(f"""
    WITH {_BM25}, seeds AS (SELECT e.vec_id AS chunk, round({_COS}, 4) AS v FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.vec_id <> 5 ORDER BY v DESC, chunk LIMIT 16),
    g AS (SELECT l_suppkey AS chunk, count(*) AS n FROM lineitem GROUP BY 1),
    k AS (SELECT chunk, score FROM bm WHERE query_id = 2)
    SELECT s.chunk, round(0.5 * v + 0.3 * coalesce(g.n / (SELECT max(n) FROM g), 0) + 0.2 * least(coalesce(k.score, 0) / 10, 1), 4) AS score
    FROM seeds s LEFT JOIN g USING (chunk) LEFT JOIN k USING (chunk)
""")
def cascade_retrieval(spark, sf):
    from ..plans.hybrid import cascade

    e = t(spark, sf, "embeddings")
    seeds = S.similar_rows(e, 5, 16, "vec_id", "embedding").select(F.col("vec_id").alias("chunk"), F.col("score").alias("vector"))
    g = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("chunk")).agg(F.count("*").alias("n"))
    k = S.bm25(_docs(spark, sf), _asked(spark, sf).where("query_id = 2"), 16, among=seeds).select("chunk", "score")
    return cascade(seeds, g, k)


@query(f"""
    WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, doc_id, list_distinct({sql_tokens('content')}) AS a, list_distinct({sql_tokens("'that the with in from'")}) AS q, content FROM chunks)
    SELECT chunk_id, CASE WHEN length(trim(content)) < 8 THEN round(0.6 * len(list_intersect(q, a)) / len(q), 4) ELSE round(least(1.0, 1.5 * len(list_intersect(q, a)) / len(q)), 4) END AS relevancy FROM x
""")
def answer_relevancy(spark, sf):
    from ..operators.learning import relevancy

    return chunks(spark, sf).select("chunk_id", relevancy(F.lit("that the with in from"), F.col("content")).alias("relevancy"))


@query(f"""
    WITH p AS (SELECT a.doc_id, {sql_tokens('a.text')} AS t0, list_distinct({sql_tokens('a.text')}) AS a, list_distinct({sql_tokens('b.text')}) AS c,
               list_filter(regexp_extract_all(a.text, '[0-9]+\\.?[0-9]*'), lambda n: length(n) >= 2) AS na, regexp_extract_all(b.text, '[0-9]+\\.?[0-9]*') AS nb
               FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.5 WHEN len(na) > 0 THEN round(0.6 * len(list_filter(na, lambda n: list_contains(nb, n))) / len(na) + 0.4 * least(1.0, 1.5 * len(list_intersect(a, c)) / len(a)), 4)
           ELSE round(least(1.0, 1.5 * len(list_intersect(a, c)) / len(a)), 4) END AS faithfulness FROM p
""")
def answer_faithfulness(spark, sf):
    from ..operators.learning import faithfulness

    d = t(spark, sf, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context"))
    return d.join(nxt, "doc_id").select("doc_id", faithfulness(F.col("text"), F.col("context")).alias("faithfulness"))
