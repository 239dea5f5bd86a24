"""Queries that read stored indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..operators import fusion as FU
from ..operators import prices as P
from ..operators import search as S
from ..operators import sections as SE
from ..operators import text_index as X
from ..operators import vector_index as V
from ..operators.learning import gap_transitions
from ..plans import multistage as MS
from ..sources.shared import fresh_path
from .registry import CHUNKS_SQL, chunks, query, sql_tokens, t
from .retrieval import _BM25, _COS, _asked, _docs, _rows, _vectors


@query()
def vector_index_search(spark, sf):
    """The ten nearest vectors of all questions by an index whose audit reached nine tenths of what a scan finds; recall and probes are given with each row."""
    index = V.write_index(t(spark, sf, "embeddings"), fresh_path(spark, "vectors"), "vec_id", "embedding")
    asked = _vectors(spark, sf).select("query_id", "q")
    probes, recall = V.audited(index, asked, 10)
    return V.search(index, asked, 10, probes).withColumns({"probes": F.lit(probes), "recall": F.lit(round(recall, 4))})


@query(f"""
    WITH entries AS (SELECT e.vec_id, e.embedding, v.ts FROM embeddings e JOIN events v ON v.event_id = e.vec_id WHERE v.ts <= TIMESTAMP '2024-01-02 12:00:00' AND epoch(TIMESTAMP '2024-01-02 12:00:00') - epoch(date_trunc('second', v.ts)) <= 86400),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.ts, round({_COS}, 4) AS score FROM entries e JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, ts, score FROM s WHERE score >= 0.3 QUALIFY rank <= 3
""")
def semantic_cache_nearest(spark, sf):
    """The three nearest stored questions of the last day, at a cosine of 0.3 or more: an entry is stored when the event of its number happened."""
    stored = t(spark, sf, "embeddings").join(t(spark, sf, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id")
    index = V.write_index(stored, fresh_path(spark, "cache"), "vec_id", "embedding", others=("ts",))
    return V.cached_answers(index, _vectors(spark, sf).select("query_id", "q"), 0.3, "ts", F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"), 86400, 3)


_FIELDS = {"content": "content", "section": "section"}


def _chunk_fields(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("section"))


@query(f"""
    WITH toks AS (SELECT doc_id AS chunk, 'content' AS field, 2.0 AS boost, {sql_tokens('text')} AS t FROM documents UNION ALL SELECT doc_id, 'section', 1.5, {sql_tokens("concat_ws(' ', source, lang)")} FROM documents),
    own AS (SELECT *, len(t) AS length FROM toks WHERE len(t) > 0), tot AS (SELECT field, count(*) AS n, avg(length) AS mean FROM own GROUP BY 1),
    asked AS (SELECT item_id AS query_id, unnest(list_distinct({sql_tokens("text || ' src' || (item_id % 20) || ' en'")})) AS term FROM benchmark),
    post AS (SELECT term, chunk, field, boost, length, count(*) AS tf FROM (SELECT chunk, field, boost, length, unnest(t) AS term FROM own) GROUP BY ALL),
    dfs AS (SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2),
    s AS (SELECT query_id, chunk, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s
          FROM asked JOIN post USING (term) JOIN dfs USING (term, field) JOIN tot USING (field) GROUP BY ALL),
    best AS (SELECT query_id, chunk, round(max(s) + 0.3 * (sum(s) - max(s)), 4) AS score FROM s GROUP BY 1, 2)
    SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INTEGER) AS rank, score, round(least(score / 30, 1), 6) AS unified FROM best QUALIFY rank <= 10
""")
def fielded_search(spark, sf):
    """The ten best documents of all questions over two fields, from a stored index, and the score as the unified search counts it."""
    index = X.write_index(_chunk_fields(spark, sf), fresh_path(spark, "text"), _FIELDS)
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" src"), (F.col("item_id") % 20).cast("string"), F.lit(" en")).alias("query"))
    return X.search(index, asked, 10).withColumn("unified", F.round(F.least(F.col("score") / 30, F.lit(1.0)), 6))


@query(f"""
    WITH toks AS (SELECT p_partkey AS chunk, 'content' AS field, 2.0 AS boost, {sql_tokens('p_name')} AS t FROM part UNION ALL SELECT p_partkey, 'section', 1.5, {sql_tokens("p_type || ' ' || p_brand")} FROM part),
    own AS (SELECT *, len(t) AS length FROM toks WHERE len(t) > 0), tot AS (SELECT field, count(*) AS n, avg(length) AS mean FROM own GROUP BY 1),
    asked AS (SELECT query_id, unnest(list_distinct({sql_tokens('q')})) AS term FROM (SELECT p_size AS query_id, min(p_name || ' ' || p_type) AS q FROM part GROUP BY 1)),
    post AS (SELECT term, chunk, field, boost, length, count(*) AS tf FROM (SELECT chunk, field, boost, length, unnest(t) AS term FROM own) GROUP BY ALL),
    dfs AS (SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2),
    s AS (SELECT query_id, chunk, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s
          FROM asked JOIN post USING (term) JOIN dfs USING (term, field) JOIN tot USING (field) GROUP BY ALL),
    best AS (SELECT query_id, chunk, round(max(s) + 0.3 * (sum(s) - max(s)), 4) AS score FROM s GROUP BY 1, 2)
    SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INTEGER) AS rank, score FROM best QUALIFY rank <= 5
""")
def price_row_search(spark, sf):
    """The five best price rows for a name and type of each size."""
    part = t(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"), F.concat_ws(" ", "p_type", "p_brand").alias("section"))
    index = X.write_index(rows, fresh_path(spark, "prices"), _FIELDS)
    return X.search(index, part.groupBy(F.col("p_size").alias("query_id")).agg(F.min(F.concat_ws(" ", "p_name", "p_type")).alias("query")), 5)


@query(f"""
    WITH names AS (SELECT DISTINCT w FROM (SELECT unnest({sql_tokens('text')}) AS w FROM benchmark) WHERE length(w) >= 6), p AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS p FROM names),
    m AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[\\x20\\x09-\\x0D\\x{{00a0}}\\x{{3000}}]+', '', 'g')), p) AS m FROM documents, p WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i)[1:4], '|') AS names FROM m WHERE len(m) > 0
""")
def material_extraction(spark, sf):
    """The first four names of a dictionary, all longer words of the questions, in each document."""
    names = t(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("name")).where("length(name) >= 6")
    return D.extracted(t(spark, sf, "documents"), names, F.col("text"), "name", ["doc_id"]).select("doc_id", F.array_join("names", "|").alias("names"))


_PAIR = f"""
    pairs AS (SELECT c.*, {sql_tokens('b.text')} AS q, {sql_tokens('d.text')} AS t FROM cand c JOIN documents d ON d.doc_id = chunk JOIN benchmark b ON b.item_id = query_id),
    grams AS (SELECT *, list_distinct(list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1])) AS q2, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS t2 FROM pairs),
    paired AS (SELECT *, round(coalesce(len(list_intersect(list_distinct(q), t)) / nullif(len(list_distinct(q)), 0), 0) + 0.5 * coalesce(len(list_intersect(q2, t2)) / nullif(len(q2), 0), 0), 6) AS rerank FROM grams)
"""


@query(f"""
    WITH {_BM25}, cand AS (SELECT query_id, chunk FROM bm WHERE rank <= 20), {_PAIR}
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk) AS INTEGER) AS place, chunk, rerank FROM paired WHERE rerank >= 0.1 QUALIFY place <= 5
""")
def pair_rerank_search(spark, sf):
    """The five best of the twenty documents that BM25 finds for a question, by a scorer of pairs, from 0.1 on."""
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    top = S.bm25(docs, asked, 20).join(docs.select(F.col("chunk_id").alias("chunk"), "content"), "chunk").join(asked, "query_id")
    return FU.pair_rerank(top, 5, 0.1).select("query_id", "place", "chunk", "rerank")


@query(f"""
    WITH {_BM25}, v AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk, round({_COS}, 4) AS score FROM embeddings e JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id)
                       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) <= 30),
    g AS (SELECT b.item_id AS query_id, d.doc_id AS chunk, 0.5 AS score FROM benchmark b JOIN documents o ON o.doc_id = b.item_id JOIN documents d ON d.source = o.source AND d.doc_id <> o.doc_id
          WHERE regexp_matches(lower(b.text), '[a-z]{{12,}}') QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) <= 10),
    legs AS (SELECT query_id, chunk, score AS vector, NULL AS keyword, NULL AS graph FROM v UNION ALL SELECT query_id, chunk, NULL, score, NULL FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, chunk, NULL, NULL, score FROM g),
    one AS (SELECT query_id, chunk, coalesce(max(vector), 0) AS vector, coalesce(max(keyword), 0) AS keyword, coalesce(max(graph), 0) AS graph FROM legs GROUP BY 1, 2),
    cand AS (SELECT *, round(0.5 * vector + 0.3 * least(keyword / 10, 1) + 0.2 * graph, 6) AS coarse FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, chunk) <= 10), {_PAIR},
    fused AS (SELECT query_id, chunk, coarse, rerank, round(0.4 / (1 + exp(-rerank)) + 0.3 * (vector + 1) / 2 + 0.2 * least(keyword / 10, 1) + 0.05 * CASE WHEN graph > 0 THEN graph ELSE 0.5 END + 0.05 * exp(-ln(2) * (chunk % 700) / 365), 6) AS score FROM paired)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INTEGER) AS rank, chunk, coarse, rerank, score FROM fused QUALIFY rank <= 5
""")
def multi_stage_search(spark, sf):
    """Five documents for each question by stages; questions with a long name also ask the graph, here documents of the same source."""
    docs, asked, d = _docs(spark, sf), _asked(spark, sf), t(spark, sf, "documents")
    by = Window.partitionBy("query_id")
    vector = S.against_all(_rows(spark, sf), _vectors(spark, sf), "vec_id", "embedding").select("query_id", F.col("vec_id").alias("chunk"), "score").withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "chunk")))
    entity = asked.where(F.lower("query").rlike("[a-z]{12,}"))
    own = d.select(F.col("doc_id").alias("query_id"), "source").join(entity.select("query_id"), "query_id")
    same = d.select(F.col("doc_id").alias("chunk"), "source").join(own, "source").where("chunk <> query_id").select("query_id", "chunk", F.lit(0.5).alias("score"), F.row_number().over(by.orderBy("chunk")).alias("rank"))
    candidates = MS.recalled({"vector": vector, "keyword": S.bm25(docs, asked, 20), "graph": same}, entity)
    today = F.lit("2024-01-01").cast("date")
    day = F.date_sub(today, (F.col("chunk") % 700).cast("int"))
    return MS.multi_stage(candidates, asked, docs.select(F.col("chunk_id").alias("chunk"), "content"), 5, day, today)


@query("""
    WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' ELSE 'repair' END AS kind FROM events WHERE event_type IN ('error', 'purchase', 'click') AND ts <= TIMESTAMP '2024-01-29 00:00:00'),
    c AS (SELECT *, (kind = 'fail' AND lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM 'pass')::INT AS cut FROM e WHERE kind <> 'repair' UNION ALL SELECT *, 0 FROM e WHERE kind = 'repair'),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM c),
    r AS (SELECT user_id, stretch, min(CASE WHEN kind = 'fail' THEN ts END) AS fail, arg_min(ts, (ts, event_id)) FILTER (kind = 'pass') AS p, arg_min(event_id, (ts, event_id)) FILTER (kind = 'pass') AS pid,
                 arg_min(ts, (ts, event_id)) FILTER (kind = 'repair') AS a, arg_min(event_id, (ts, event_id)) FILTER (kind = 'repair') AS aid FROM s GROUP BY 1, 2),
    x AS (SELECT *, lead(fail) OVER (PARTITION BY user_id ORDER BY stretch) AS nxt, p + INTERVAL 6 HOUR AS deadline FROM r),
    y AS (SELECT *, (p IS NOT NULL AND deadline <= TIMESTAMP '2024-01-29 00:00:00' AND (nxt IS NULL OR nxt > deadline)) AS done, (a IS NOT NULL AND (p IS NULL OR a < p OR (a = p AND aid < pid))) AS asked FROM x)
    SELECT user_id, a AS at, 'open_task' AS action, 'open' AS old, 'open' AS new FROM y WHERE asked UNION ALL SELECT user_id, p, 'close_task', 'open', 'open' FROM y WHERE asked AND p IS NOT NULL
    UNION ALL SELECT user_id, p, 'observe', 'open', 'observing' FROM y WHERE p IS NOT NULL UNION ALL SELECT user_id, deadline, 'resolve', 'observing', 'resolved' FROM y WHERE done
    UNION ALL SELECT user_id, nxt, 'reopen', CASE WHEN done THEN 'resolved' ELSE 'observing' END, 'open' FROM y WHERE p IS NOT NULL AND nxt IS NOT NULL
""")
def gap_lifecycle(spark, sf):
    """What becomes of each user's gap up to a day: errors fail, purchases pass, clicks ask for a repair, six hours of observation."""
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "click", "repair")
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("kind"))
    return gap_transitions(e, "user_id", 6 * 3600, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))


_LINES = "l AS (SELECT doc_id, pos, content, CASE WHEN len(string_split(content, ' ')) <= 2 THEN len(string_split(content, ' ')) ELSE 0 END AS level FROM (SELECT doc_id, page AS pos, content FROM chunks))"


@query(f"""
    WITH {CHUNKS_SQL}, {_LINES},
    h AS (SELECT a.doc_id, a.pos, a.level, coalesce(min(b.pos) - 1, 9223372036854775807) AS fin FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.level BETWEEN 1 AND a.level WHERE a.level > 0 GROUP BY ALL),
    up AS (SELECT l.doc_id, l.pos, h.pos AS ref, row_number() OVER (PARTITION BY l.doc_id, l.pos ORDER BY h.level DESC) AS i FROM l JOIN h ON h.doc_id = l.doc_id AND h.pos < l.pos AND l.pos <= h.fin),
    n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l)
    SELECT doc_id, pos, 'section' AS kind, ref, 0.7::DOUBLE AS score FROM up WHERE i = 1 UNION ALL SELECT doc_id, pos, 'parent', ref, 0.6 FROM up WHERE i = 2
    UNION ALL SELECT a.doc_id, a.pos, CASE WHEN b.k < a.k THEN 'before' ELSE 'after' END, b.pos, 0.5 FROM n a JOIN n b ON a.doc_id = b.doc_id AND abs(a.k - b.k) BETWEEN 1 AND 2
""")
def section_context(spark, sf):
    """What each line of each document is to be read with; lines of one word are headings, those of two words headings below them."""
    words = F.size(F.split("content", " "))
    lines = chunks(spark, sf).select("doc_id", F.col("page").alias("pos"), "content", F.when(words <= 2, words).otherwise(0).alias("level"))
    return SE.contexts(lines)


@query("""
    WITH q AS (SELECT row_number() OVER (ORDER BY p_name) AS query_id, p_name AS material, min(strftime(l_shipdate, '%Y-%m')) AS ym FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 2),
    asked AS (SELECT * FROM q WHERE query_id > 3),
    x AS (SELECT query_id, l_orderkey AS page, arg_min(printf('%.2f', l_extendedprice), l_linenumber) AS price,
                 max((strftime(l_shipdate, '%Y-%m') = ym)::INT) AS anchor
          FROM asked JOIN part ON contains(lower(p_name), lower(material)) JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page) AS INTEGER) AS rank, page AS doc_id, page, 't' AS unit, price, CAST(0.85 AS DOUBLE) AS score FROM x WHERE anchor = 1 QUALIFY rank <= 5
""")
def anchor_price_fallback(spark, sf):
    """Prices that pages show, for each material in its first month; a page is an order, whose lines give a chunk with name and month and one with name, unit and price. The first three questions count as answered."""
    # lines of one number in an order stand as they do in the table, which is how the SQL's arg_min meets them
    lines = t(spark, sf, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    line = lines.join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    chunk = lambda n, text: F.struct(F.struct("l_linenumber", "file", "row", F.lit(n).alias("n")).alias("chunk_id"), text.alias("content"))
    head = F.concat(F.col("p_name"), F.lit(" "), F.date_format("l_shipdate", "yyyy"), F.lit("年"), F.month("l_shipdate").cast("string"), F.lit("月价格"))
    shown = F.concat_ws(" ", "p_name", F.lit("t"), F.format_string("%.2f", "l_extendedprice"))
    chunks_ = line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.inline(F.array(chunk(0, head), chunk(1, shown))))
    months = line.groupBy(F.col("p_name").alias("material")).agg(F.min(F.date_format("l_shipdate", "yyyy-MM")).alias("ym"))
    q = months.select(F.row_number().over(Window.orderBy("material")).cast("long").alias("query_id"), "material", "ym")  # one row a name
    return P.anchor_prices(chunks_, q, 5, q.where("query_id <= 3"))
