"""Look-ups by pattern, page, session and neighbouring terms, and edits of JSON and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from .registry import CHUNKS_SQL, chunks, query, sql_tokens, t


@query("""
    SELECT p_partkey, p_name ILIKE '%RED%' OR p_name ILIKE 'b_ue%' AS by_name, len(list_filter(string_split(p_name, ' '), lambda a: a ILIKE '%RED%' OR a ILIKE 'b_ue%')) > 0 AS by_alias FROM part
""")
def ilike_any(spark, sf):
    patterns = ["%RED%", "b_ue%"]
    aliases = F.split("p_name", " ")
    return t(spark, sf, "part").select("p_partkey", T.ilike_any(F.col("p_name"), patterns).alias("by_name"), F.exists(aliases, lambda a: T.ilike_any(a, patterns)).alias("by_alias"))


@query("""
    SELECT event_id, json_exists(j, '$.k') AS has_k, json_exists(j, '$.none') AS has_none, json_extract_string(json_merge_patch(j, '{"k": null}'), '$.type') AS type, json_exists(json_merge_patch(j, '{"k": null}'), '$.k') AS still
    FROM (SELECT event_id, json_merge_patch(CAST(props AS JSON), json_object('type', event_type)) AS j FROM events)
""")
def json_edit(spark, sf):
    j = F.concat(F.regexp_replace("props", r"\}\s*$", ', "type": "'), F.col("event_type"), F.lit('"}'))
    own = t(spark, sf, "events").select("event_id", j.alias("j")).withColumn("left", T.json_without(F.col("j"), "k"))
    return own.select("event_id", T.json_has(F.col("j"), "k").alias("has_k"), T.json_has(F.col("j"), "none").alias("has_none"), F.get_json_object("left", "$.type").alias("type"), T.json_has(F.col("left"), "k").alias("still"))


@query(f"""
    WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, unnest(list_distinct({sql_tokens('content')})) AS term FROM chunks WHERE contains(lower(content), 'license'))
    SELECT term, count(*) AS n, min(chunk_id) AS sample_chunk FROM x WHERE NOT contains(term, 'license') AND NOT contains('license', term) GROUP BY 1 ORDER BY n DESC, term LIMIT 20
""")
def entity_cooccur(spark, sf):
    return S.cooccurring_terms(chunks(spark, sf), "license", T.tokens(F.col("content")), 20)


@query(f"""
    WITH {CHUNKS_SQL}, x AS (SELECT *, {sql_tokens('content')} AS toks, length(content) AS size FROM chunks),
    a AS (SELECT chunk_id, doc_id, page, 0 AS leg, 0 AS score, size FROM x WHERE contains(lower(content), 'under the') ORDER BY size, chunk_id LIMIT 12),
    b AS (SELECT chunk_id, doc_id, page, 1 AS leg, CAST(len(list_filter(toks, lambda w: w IN ('under', 'the'))) AS INTEGER) AS score, size FROM x WHERE list_contains(toks, 'under') AND list_contains(toks, 'the') ORDER BY score DESC, size, chunk_id LIMIT 12)
    SELECT chunk_id, doc_id, page, leg, score FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM a)) ORDER BY leg, score DESC, size, chunk_id LIMIT 12
""")
def pdf_page_search(spark, sf):
    return S.page_search(chunks(spark, sf), "under the", 12)


@query(f"""
    SELECT conv_id, count(*) AS hits, min(turn) AS first_turn FROM conversations WHERE list_contains({sql_tokens('text')}, 'the') AND list_contains({sql_tokens('text')}, 'of') GROUP BY 1 ORDER BY hits DESC, conv_id LIMIT 10
""")
def session_search(spark, sf):
    return S.session_search(t(spark, sf, "conversations"), "of the", 10)


@query(f"""
    WITH {CHUNKS_SQL} SELECT d.doc_id, coalesce(c.n, 0) AS text_chunks, coalesce(l.n, 0) AS labels
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)
""")
def registry_counts(spark, sf):
    return S.refreshed_counts(t(spark, sf, "documents").select("doc_id"), "doc_id", {"text_chunks": chunks(spark, sf), "labels": t(spark, sf, "labels")})
