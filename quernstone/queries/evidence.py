"""Evidence lookups, importers, routes, root causes, evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import learning as L
from ..operators import search as S
from ..operators import tables as O
from .registry import CHUNKS_SQL, chunks, query, sql_tokens, t
from .retrieval import _BM25, _COS, _asked, _docs


@query(f"""
    WITH {_BM25}, k AS (SELECT chunk, score FROM bm WHERE query_id = 4 AND rank <= 10), v AS (SELECT e.vec_id AS chunk, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 4) q WHERE e.vec_id <> 4 ORDER BY score DESC, chunk LIMIT 10),
    u AS (SELECT chunk, score, 0 AS leg FROM k UNION ALL SELECT chunk, score, 1 FROM v), d AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY leg, score DESC) AS i FROM u)
    SELECT chunk, leg, score FROM d WHERE i = 1 ORDER BY leg, score DESC, chunk LIMIT 15
""")
def text_search(spark, sf):
    words = S.bm25(_docs(spark, sf), _asked(spark, sf).where("query_id = 4"), 10).select("chunk", "score")
    near = S.similar_rows(t(spark, sf, "embeddings"), 4, 10, "vec_id", "embedding").select(F.col("vec_id").alias("chunk"), "score")
    return S.first_of_each([words, near], "chunk", 15, F.desc("score")).select("chunk", "leg", "score")


@query("""
    WITH h AS (SELECT 'part' AS kind, p_partkey AS ref FROM part UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 'event', event_id FROM events)
    SELECT kind, ref, p_name AS evidence FROM h JOIN part ON kind = 'part' AND ref = p_partkey UNION ALL SELECT kind, ref, n_name FROM h JOIN nation ON kind = 'nation' AND ref = n_nationkey UNION ALL SELECT kind, ref, event_type FROM h JOIN events ON kind = 'event' AND ref = event_id
""")
def evidence_materialiser(spark, sf):
    part, nation, ev = t(spark, sf, "part"), t(spark, sf, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), t(spark, sf, "events")
    kind = lambda df, name, key: df.select(F.lit(name).alias("kind"), F.col(key).alias("ref"))
    hits = kind(part, "part", "p_partkey").unionByName(kind(nation, "nation", "n_nationkey")).unionByName(kind(ev, "event", "event_id"))
    tables = {"part": (part, "p_partkey", F.col("p_name")), "nation": (nation, "n_nationkey", F.col("n_name")), "event": (ev, "event_id", F.col("event_type"))}
    return S.materialise(hits, tables).select("kind", "ref", "evidence")


@query("""
    WITH n AS (SELECT DISTINCT p_name AS name, [split_part(p_name, ' ', 2), upper(p_name)] AS aliases FROM part), q AS (SELECT * FROM (VALUES (1, 'gear'), (2, 'the red gear of it'), (3, 'BLUE PLATE'), (4, 'a plate')) v(query_id, query)),
    m AS (SELECT query_id, name, CASE WHEN len(list_filter(aliases, lambda a: lower(a) = lower(query))) > 0 THEN 'alias' WHEN contains(lower(name), lower(query)) THEN 'name_has_query' WHEN contains(lower(query), lower(name)) THEN 'query_has_name'
          WHEN len(list_filter(aliases, lambda a: contains(lower(query), lower(a)))) > 0 THEN 'query_has_alias' END AS how FROM n, q)
    SELECT * FROM m WHERE how IS NOT NULL
""")
def reverse_alias_expansion(spark, sf):
    names = t(spark, sf, "part").select(F.col("p_name").alias("name"), F.array(F.split("p_name", " ")[1], F.upper("p_name")).alias("aliases")).distinct()
    asked = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(s).alias("query")) for i, s in ((1, "gear"), (2, "the red gear of it"), (3, "BLUE PLATE"), (4, "a plate"))])))
    return S.alias_matches(names, F.broadcast(asked))


@query()
def concept_path(spark, sf):
    e = t(spark, sf, "embeddings")
    ends = {r.vec_id: [float(x) for x in r.embedding] for r in e.where("vec_id IN (0, 1)").collect()}
    met = S.concept_path(e.where("vec_id > 1"), ends[0], ends[1], 3, "vec_id", "embedding")
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, met))).alias("step", "vec_id"))


@query("""
    SELECT p_partkey AS table_id, p_name AS material, p_type AS spec, CASE WHEN p_partkey % 2 = 0 THEN 'm²' ELSE 't' END AS unit, round(p_retailprice, 2) AS price FROM part WHERE p_partkey % 5 <> 0
""")
def price_table_import(spark, sf):
    k = F.col("p_partkey")
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.cast("string").alias("text"))
    number = F.format_string("%.2f", F.col("p_retailprice"))
    price = F.when(k % 5 == 0, "none").when(k % 2 == 0, F.concat(F.lit("¥"), number)).otherwise("")
    unit = F.when(k % 5 == 0, "t").when(k % 2 == 0, "㎡").otherwise(F.concat(F.lit("t "), number))
    head = [cell(0, i, F.lit(h)) for i, h in enumerate(("名称", "规格", "单位", "含税价"))]
    body = [cell(1, 0, F.col("p_name")), cell(1, 1, F.col("p_type")), cell(1, 2, unit), cell(1, 3, price)]
    cells = t(spark, sf, "part").select(k.alias("table_id"), F.inline(F.array(*head, *body)))
    return I.price_rows(cells, ["table_id"]).select("table_id", "material", "spec", "unit", "price")


@query("""
    SELECT c_custkey AS doc_id, CAST(1 AS BIGINT) AS page, 'steel' AS material, 't' AS unit, CAST(round(abs(c_acctbal), 2) AS DOUBLE) AS price, CAST(2 AS BIGINT) AS other FROM customer WHERE c_custkey % 3 <> 0
""")
def chart_page_recovery(spark, sf):
    k = F.col("c_custkey")
    page = lambda n, text: F.struct(F.lit(n).cast("long").alias("page"), text.alias("text"))
    number = F.format_string("%.2f", F.abs(F.col("c_acctbal")))
    shown = F.when(k % 3 != 0, F.concat(F.lit("row 4 steel t "), number, F.lit(" end"))).otherwise("nothing")
    pages = t(spark, sf, "customer").select(k.alias("doc_id"), F.inline(F.array(page(1, F.lit("chart of steel")), page(2, shown), page(9, F.lit("steel kg 1.00")))))
    wanted = t(spark, sf, "customer").where(k % 3 != 0).select(k.alias("doc_id"), F.lit(1).cast("long").alias("page"), F.lit("steel").alias("material"))
    return I.recovered_prices(pages, wanted)


@query("""
    SELECT DISTINCT s_suppkey AS table_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE lower(p_name) LIKE '%gear%' AND l_quantity > 45
""")
def tables_by_entity(spark, sf):
    p = t(spark, sf, "part").where(T.contains_ci(F.col("p_name"), "gear"))
    line = t(spark, sf, "lineitem").where("l_quantity > 45").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t(spark, sf, "supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("s_suppkey").alias("table_id"))


@query(f"""
    WITH p AS (SELECT a.conv_id, list_distinct({sql_tokens('a.text')}) AS q, list_distinct({sql_tokens('b.text')}) AS r, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    s AS (SELECT conv_id, CASE WHEN len(q) = 0 THEN 0.5 WHEN length(trim(text, ' ')) < 8 THEN round(0.6 * len(list_intersect(q, r)) / len(q), 4) ELSE round(least(1.0, 1.5 * len(list_intersect(q, r)) / len(q)), 4) END AS v FROM p)
    SELECT conv_id, count(*) AS n, round(avg(v), 3) AS relevancy FROM s GROUP BY 1
""")
def evaluation_runner(spark, sf):
    c = t(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    own = c.join(nxt, ["conv_id", "turn"]).select("conv_id", L.relevancy(F.col("text"), F.col("answer")).alias("v"))
    return own.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("relevancy"))


@query("""
    WITH h AS (SELECT user_id % 12 AS route, strftime(ts, '%H') AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY bad DESC, hour) AS i FROM h)
    SELECT route, hour, bad, CASE WHEN bad / n >= 0.4 THEN 'systemic' WHEN bad >= 5 THEN 'hotspot' ELSE 'sporadic' END AS cause, CASE WHEN bad >= 10 THEN 'high' WHEN bad >= 5 THEN 'medium' ELSE 'low' END AS priority FROM r WHERE i = 1
""")
def root_cause(spark, sf):
    h = t(spark, sf, "events").groupBy((F.col("user_id") % 12).alias("route"), F.date_format("ts", "HH").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    top = O.latest_per_key(h, ["route"], [F.desc("bad"), F.col("hour")])
    cause = F.when(F.col("bad") / F.col("n") >= 0.4, "systemic").when(F.col("bad") >= 5, "hotspot").otherwise("sporadic")
    return top.select("route", "hour", "bad", cause.alias("cause"), F.when(F.col("bad") >= 10, "high").when(F.col("bad") >= 5, "medium").otherwise("low").alias("priority"))


@query(f"""
    WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE contains(lower(content), 'idiot') OR contains(lower(content), 'token =') OR contains(lower(content), 'license')
""")
def error_blacklist(spark, sf):
    words = F.array(F.lit("idiot"), F.lit("token ="), F.lit("license"))
    return chunks(spark, sf).where(F.exists(words, lambda w: F.contains(F.lower("content"), w))).select("chunk_id")


@query(f"""
    WITH {CHUNKS_SQL}, p AS (SELECT doc_id, page // 5 AS page, sum(length(content)) AS n FROM chunks GROUP BY 1, 2)
    SELECT CASE WHEN n < 40 THEN 'ocr' WHEN n < 400 THEN 'hybrid' ELSE 'native' END AS route, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars FROM p GROUP BY 1
""")
def ocr_route_metrics(spark, sf):
    p = chunks(spark, sf).groupBy("doc_id", F.floor(F.col("page") / 5).alias("page")).agg(F.sum(F.length("content")).alias("n"))
    route = F.when(F.col("n") < 40, "ocr").when(F.col("n") < 400, "hybrid").otherwise("native")
    return p.groupBy(route.alias("route")).agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


@query(f"""
    WITH {CHUNKS_SQL}, p AS (SELECT doc_id, page, sum(length(content)) AS n FROM chunks GROUP BY 1, 2) SELECT doc_id, page FROM p WHERE n < 15
""")
def blindspots(spark, sf):
    return chunks(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length("content")).alias("n")).where("n < 15").select("doc_id", "page")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem), w(node, depth) AS (SELECT (SELECT min(source) FROM e), 0 UNION SELECT target, depth + 1 FROM w JOIN e ON source = node WHERE depth < 2),
    d AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
    SELECT d.node, CAST(depth AS INTEGER) AS depth, p_name AS evidence FROM d JOIN part ON p_partkey = node
""")
def graph_search(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    first = e.agg(F.min("source").alias("m"))
    reached = G.walk(e.crossJoin(F.broadcast(first)), F.col("source") == F.col("m"), 2)
    return reached.join(t(spark, sf, "part"), F.col("node") == F.col("p_partkey")).select("node", "depth", F.col("p_name").alias("evidence"))


@query("""
    WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1)
    SELECT count(*) AS users, CAST(sum(errors) AS BIGINT) AS errors, round(avg(errors / n), 4) AS mean_rate, count(*) FILTER (errors / n > 0.3) AS failing, count(*) FILTER (errors = 0) AS clean FROM n
""")
def architecture_health(spark, sf):
    n = t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    rate = F.col("errors") / F.col("n")
    return n.agg(F.count("*").alias("users"), F.sum("errors").alias("errors"), F.round(F.avg(rate), 4).alias("mean_rate"), F.count_if(rate > 0.3).alias("failing"), F.count_if(F.col("errors") == 0).alias("clean"))
