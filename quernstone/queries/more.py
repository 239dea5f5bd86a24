"""Further operators: question understanding, topology, logs, audits, evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion as FU
from ..operators import search as S
from ..operators import tables as O
from ..operators import understanding as U
from .registry import CHUNKS_SQL, PRICES_SQL, chunks, prices, query, sql_tokens, t
from .retrieval import _BM25, _COS, _asked, _docs, _rows, _vectors


@query("""
    WITH q AS (SELECT item_id, text || CASE item_id % 6 WHEN 0 THEN ' price' WHEN 1 THEN ' trend of cost' WHEN 2 THEN ' compare' WHEN 3 THEN ' clause' WHEN 4 THEN ' what is it' ELSE '' END AS s FROM benchmark),
    i AS (SELECT item_id, CASE WHEN regexp_matches(lower(s), 'trend|change') THEN 'trend' WHEN regexp_matches(lower(s), 'compare|versus|difference') THEN 'compare' WHEN regexp_matches(lower(s), 'price|cost|how much') THEN 'price'
          WHEN regexp_matches(lower(s), 'rule|clause|standard|rate') THEN 'rule' WHEN regexp_matches(lower(s), 'what is|define|meaning') THEN 'definition' ELSE 'general' END AS intent FROM q)
    SELECT item_id, intent, CASE intent WHEN 'rule' THEN 'text' WHEN 'definition' THEN 'graph' WHEN 'general' THEN 'hybrid' ELSE 'series' END AS store FROM i
""")
def intent_classify(spark, sf):
    tails = F.element_at(F.array(*map(F.lit, (" price", " trend of cost", " compare", " clause", " what is it", ""))), (F.col("item_id") % 6 + 1).cast("int"))
    own = t(spark, sf, "benchmark").select("item_id", U.intent(F.concat("text", tails)).alias("intent"))
    return own.withColumn("store", U.store(F.col("intent")))


@query(f"""
    SELECT item_id, CASE WHEN len({sql_tokens('text')}) <= 3 THEN 'KEYWORD' WHEN len({sql_tokens('text')}) > 12 THEN 'SEMANTIC' ELSE 'HYBRID' END AS kind, len({sql_tokens('text')}) AS n FROM benchmark
""")
def query_classifier(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", U.kind(F.col("text")).alias("kind"), F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@query("""
    WITH p AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(trim(text, ' '), '\\s*(?:[?？;；]|\\band\\b|以及|并且|另外)\\s*'), lambda x: length(x) >= 3)) AS p FROM benchmark)
    SELECT item_id, len(p) AS n, array_to_string(list_sort(p), '|') AS parts FROM p
""")
def query_decompose(spark, sf):
    p = U.parts(F.col("text"))
    return t(spark, sf, "benchmark").select("item_id", F.size(p).cast("long").alias("n"), F.array_join(F.array_sort(p), "|").alias("parts"))


@query()
def sub_query_fan_out(spark, sf):
    docs = _docs(spark, sf)
    return U.fan_out(_asked(spark, sf), lambda asked: S.bm25(docs, asked, 20))


@query(f"""
    WITH v AS (SELECT vec_id AS chunk, embedding FROM embeddings), s AS (SELECT e.chunk, round({_COS}, 4) AS score FROM v e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY score DESC, chunk LIMIT 30)
    SELECT s.chunk, s.score, d.lang, CASE WHEN d.doc_id % 3 = 0 THEN 'raw' ELSE 'page_summary' END AS view FROM s JOIN documents d ON d.doc_id = s.chunk
""")
def multi_view_search(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1)
    views = e.select(F.col("vec_id").alias("chunk"), "embedding").crossJoin(F.broadcast(q))
    parents = t(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "lang", F.when(F.col("doc_id") % 3 == 0, "raw").otherwise("page_summary").alias("view"))
    return S.by_view(views, parents, F.col("q"), 30, "chunk", "embedding").select("chunk", "score", "lang", "view")


@query(f"""
    WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)), c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)),
    b AS (SELECT q.qid, max(round({_COS}, 4)) AS best FROM q, c e GROUP BY 1)
    SELECT qid, best, best < 0.55 AS gap FROM b
""")
def find_knowledge_gaps(spark, sf):
    q = _vectors(spark, sf)
    known = _rows(spark, sf).join(q, F.col("vec_id") == F.col("query_id"), "left_anti")
    best = S.against_all(known, q, "vec_id", "embedding").groupBy(F.col("query_id").alias("qid")).agg(F.max("score").alias("best"))
    return best.withColumn("gap", F.col("best") < 0.55)


@query(f"""
    WITH p AS (SELECT q.vec_id AS x, e.vec_id AS y, round({_COS}, 4) AS s FROM embeddings e JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id)
    SELECT x, y, s FROM p WHERE s > 0.3
""")
def repeat_questions(spark, sf):
    pairs = S.against_all(_rows(spark, sf), _vectors(spark, sf), "vec_id", "embedding")
    return pairs.select(F.col("query_id").alias("x"), F.col("vec_id").alias("y"), F.col("score").alias("s")).where("s > 0.3")


@query("""
    WITH g AS (SELECT user_id AS edge, max(ts) AS last, count(*) AS n FROM events GROUP BY 1)
    SELECT edge, 'stale' AS kind FROM g WHERE last < TIMESTAMP '2024-01-30 00:00:00' UNION ALL SELECT edge, 'spike' FROM g WHERE n > 80
""")
def topology_anomalies(spark, sf):
    g = t(spark, sf, "events").groupBy(F.col("user_id").alias("edge")).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    old = g.where(F.col("last") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("edge", F.lit("stale").alias("kind"))
    return old.unionByName(g.where("n > 80").select("edge", F.lit("spike").alias("kind")))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def contract_violations(spark, sf):
    return O.top_k(t(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", "ts"), 100, F.desc("ts"), F.desc("event_id"))


@query("""
    WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), x AS (SELECT unnest(['tool_' || (user_id % 7), 'tool_' || (event_id % 5)]) AS tool FROM r)
    SELECT tool, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, tool LIMIT 20
""")
def learning_summary_tools(spark, sf):
    r = O.top_k(t(spark, sf, "events"), 500, F.desc("ts"), F.desc("event_id"))
    tool = lambda c: F.concat(F.lit("tool_"), c.cast("string"))
    own = r.select(F.explode(F.array(tool(F.col("user_id") % 7), tool(F.col("event_id") % 5))).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))
    return O.top_k(own, 20, F.desc("n"), F.col("tool"))


@query("""
    WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failure' WHEN value < 20 THEN 'weak' WHEN value < 400 THEN 'good' END AS quality, event_type = 'error' AS refused, CASE WHEN value < 100 THEN value / 100 END AS confidence
               FROM events ORDER BY ts DESC, event_id DESC LIMIT 500),
    f AS (SELECT CASE WHEN value >= 50 THEN 1 WHEN value < 10 THEN -1 ELSE 0 END AS rating FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 500)
    SELECT 'runs' AS part, '' AS key, count(*) AS n, NULL::DOUBLE AS value FROM r UNION ALL SELECT 'refused', '', count(*) FILTER (refused), NULL FROM r
    UNION ALL SELECT 'confidence', '', count(confidence), coalesce(round(avg(confidence), 3), 0) FROM r
    UNION ALL SELECT 'quality', k.q, (SELECT count(*) FROM r WHERE quality = k.q), NULL FROM (VALUES ('good'), ('weak'), ('failure')) k(q)
    UNION ALL SELECT 'quality', 'unknown', count(*), NULL FROM r WHERE quality IS NULL HAVING count(*) > 0
    UNION ALL SELECT * FROM (SELECT 'tool', tool, count(*) AS n, NULL FROM (SELECT unnest(['tool_' || (user_id % 7), 'tool_' || (event_id % 5)]) AS tool FROM r) GROUP BY tool ORDER BY n DESC, tool LIMIT 20)
    UNION ALL SELECT 'type', event_type, count(*), NULL FROM r GROUP BY 2
    UNION ALL SELECT 'feedback', 'positive', count(*) FILTER (rating > 0), NULL FROM f UNION ALL SELECT 'feedback', 'negative', count(*) FILTER (rating < 0), NULL FROM f UNION ALL SELECT 'feedback', 'total', count(*), NULL FROM f
""")
def learning_summary(spark, sf):
    from ..operators.learning import run_summary

    e, tool = t(spark, sf, "events"), (lambda c: F.concat(F.lit("tool_"), c.cast("string")))
    v, error = F.col("value"), F.col("event_type") == "error"
    runs = e.select("ts", "event_id", F.when(error, "failure").when(v < 20, "weak").when(v < 400, "good").alias("quality"), error.alias("refused"), F.when(v < 100, v / 100).alias("confidence"),
                    F.array(tool(F.col("user_id") % 7), tool(F.col("event_id") % 5)).alias("tools"), F.col("event_type").alias("query_type"))
    told = e.where("event_type = 'click'").select("ts", "event_id", F.when(v >= 50, 1).when(v < 10, -1).otherwise(0).alias("rating"))
    late = [F.desc("ts"), F.desc("event_id")]
    return run_summary(runs, told, late, late)


@query("""
    WITH b AS (SELECT event_type, CASE WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE 'inf' END AS le FROM events)
    SELECT event_type, le, count(*) AS n FROM b GROUP BY 1, 2
""")
def metric_histogram(spark, sf):
    le = F.when(F.col("value") <= 10, "10").when(F.col("value") <= 50, "50").when(F.col("value") <= 100, "100").otherwise("inf")
    return t(spark, sf, "events").groupBy("event_type", le.alias("le")).agg(F.count("*").alias("n"))


@query("""
    WITH y AS (SELECT unnest(['1995', '1996', '1997', '2009']) AS year), want AS (SELECT year, f FROM y, (SELECT unnest(['MAIL', 'R', 'N', 'A', 'X']) AS f)), have AS (SELECT DISTINCT strftime(l_shipdate, '%Y') AS year, l_returnflag AS f FROM lineitem)
    SELECT year, f AS missing FROM want WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.year = want.year AND contains(have.f, want.f))
""")
def fee_audit(spark, sf):
    want = spark.range(1).select(F.explode(F.array(*map(F.lit, ("1995", "1996", "1997", "2009")))).alias("year")).select("year", F.explode(F.array(*map(F.lit, ("MAIL", "R", "N", "A", "X")))).alias("missing"))
    have = t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("y"), F.col("l_returnflag").alias("f")).distinct()
    for block in O.in_blocks(have, "f"):
        want = want.join(block, (F.col("year") == F.col("y")) & F.col("f").contains(F.col("missing")), "left_anti")
    return want


@query("""
    SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY rank, name) AS i FROM (
        SELECT doc_id, 'label' || quality AS name, 0 AS rank FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT vec_id, 'vec' || label, 1 FROM embeddings UNION ALL SELECT doc_id, source, 2 FROM documents)) WHERE i = 1
""")
def doc_name_enrichment(spark, sf):
    s = lambda c: F.col(c).cast("string")
    a = t(spark, sf, "labels").where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("label"), s("quality")).alias("name"), F.lit(0).alias("rank"))
    b = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("vec"), s("label")).alias("name"), F.lit(1).alias("rank"))
    c = t(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.lit(2).alias("rank"))
    return O.latest_per_key(FU.union([a, b, c]), ["doc_id"], [F.col("rank"), F.col("name")]).select("doc_id", "name")


@query("""
    WITH s AS (SELECT doc_id AS chunk, round(doc_id % 37 / 37.0, 4) AS v, round(doc_id % 23 / 23.0, 4) AS r, CASE doc_id % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'keyword' WHEN 2 THEN 'graph' ELSE 'x' END AS source FROM documents)
    SELECT chunk, round(v * 0.3 + r * 0.5 + CASE WHEN source IN ('keyword', 'graph') THEN v * 0.1 ELSE 0 END, 6) AS fused FROM s
""")
def source_feature_fusion(spark, sf):
    i = F.col("doc_id")
    part = lambda n: F.round(i % n / float(n), 4)
    source = F.element_at(F.array(*map(F.lit, ("vector", "keyword", "graph", "x"))), (i % 4 + 1).cast("int"))
    return t(spark, sf, "documents").select(i.alias("chunk"), F.round(FU.by_source(source, part(37), part(23)), 6).alias("fused"))


@query("""
    WITH legs AS (SELECT doc_id AS chunk, CASE doc_id % 3 WHEN 0 THEN 0.5 END AS v, NULL::DOUBLE AS k FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0.7 END, doc_id % 9 / 9.0 FROM documents)
    SELECT chunk, max(CAST(v AS DOUBLE)) AS v, max(k) AS k FROM legs GROUP BY 1
""")
def candidate_merge(spark, sf):
    d = t(spark, sf, "documents")
    i = F.col("doc_id")
    a = d.where("doc_id % 2 = 0").select(i.alias("chunk"), F.when(i % 3 == 0, 0.5).alias("v"), F.lit(None).cast("double").alias("k"))
    b = d.select(i.alias("chunk"), F.when(i % 5 == 0, 0.7).alias("v"), (i % 9 / 9.0).alias("k"))
    return FU.merge_candidates(a.unionByName(b), ["v", "k"])


@query(f"""
    WITH {CHUNKS_SQL} SELECT chunk_id, doc_id FROM chunks JOIN (SELECT doc_id AS d, lang FROM documents) x ON doc_id = d WHERE lang = 'en' AND page BETWEEN 2 AND 4 AND length(content) / 100.0 >= 0.5
""")
def metadata_filters(spark, sf):
    lang = t(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return chunks(spark, sf).where(F.col("page").between(2, 4) & (F.length("content") / 100 >= 0.5)).join(lang, "doc_id").select("chunk_id", "doc_id")


@query("""
    SELECT s_suppkey, p FROM (SELECT s_suppkey, r_name || '/' || n_name || '/' || s_name AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE p LIKE 'ASIA/%' OR p LIKE 'EUROPE/%'
""")
def path_prefix(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("/", "r_name", "n_name", "s_name").alias("p"))
    return p.where(F.col("p").startswith("ASIA/") | F.col("p").startswith("EUROPE/"))


@query("""
    WITH a AS (SELECT n_nationkey, [lower(n_name), substr(n_name, 1, 3), n_name || '!'] AS aliases FROM nation)
    SELECT n_nationkey FROM a WHERE len(list_filter(aliases, lambda x: contains(lower(x), '1'))) > 0
""")
def alias_exists(spark, sf):
    a = F.array(F.lower("n_name"), F.substring("n_name", 1, 3), F.concat("n_name", F.lit("!")))
    return t(spark, sf, "nation").where(F.exists(a, lambda x: F.lower(x).contains("1"))).select("n_nationkey")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{2,}')) AS numbers, regexp_extract(text, '([0-9]{4,})', 1) AS first FROM documents")
def regex_extract(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).cast("long").alias("numbers"), F.regexp_extract("text", "([0-9]{4,})", 1).alias("first"))


@query("SELECT 1 AS id, round(sqrt(16.0) + 2.5 * 4 - 10 / 4.0, 6) AS value")
def calculator(spark, sf):
    return spark.range(1).select(F.lit(1).alias("id"), F.round(U.calculator("sqrt(16) + 2.5*4 - 10/4"), 6).alias("value"))


@query("""
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)error|fail') THEN 'failure' END, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'article' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END], lambda x: x IS NOT NULL), ',') AS findings FROM conversations
""")
def review_findings(spark, sf):
    got = U.listed(F.col("text"), {"failure": "(?i)error|fail", "article": r"(?i)\bthe\b", "number": "[0-9]"})
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(got, ",").alias("findings"))


@query("""
    SELECT pattern, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, event_type || ':' || CAST(json_extract_string(props, '$.k') AS BIGINT) // 20 AS pattern FROM events) GROUP BY 1 HAVING count(*) >= 3
""")
def curator_promotion(spark, sf):
    pattern = F.concat_ws(":", "event_type", F.floor(F.get_json_object("props", "$.k").cast("long") / 20).cast("string"))
    return t(spark, sf, "events").groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).where("n >= 3")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def decision_log(spark, sf):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf, "events").where(F.col("event_type").isin("error", "purchase") & (F.col("ts") >= at("2024-01-05")) & (F.col("ts") < at("2024-01-12")) & k.between(10, 20)).select("event_id", "user_id")


@query(f"""
    WITH {PRICES_SQL}, y AS (SELECT material, substr(ym, 1, 4) AS period, avg(price) AS v FROM prices GROUP BY 1, 2)
    SELECT material, period, floor(v * 100 + 0.5) / 100 AS v FROM y WHERE period BETWEEN '1996' AND '1998' AND contains(lower(material), 'a')
""")
def time_series_query(spark, sf):
    y = prices(spark, sf).groupBy("material", F.substring("ym", 1, 4).alias("period")).agg(F.avg("price").alias("v"))
    return y.where(F.col("period").between("1996", "1998") & T.contains_ci(F.col("material"), "a")).withColumn("v", F.floor(F.col("v") * 100 + 0.5) / 100)


@query(f"""
    WITH {_BM25}, h AS (SELECT query_id, max((chunk % 10 = query_id % 10)::INT) AS hit, min(CASE WHEN chunk % 10 = query_id % 10 THEN rank END) AS first FROM bm WHERE rank <= 10 GROUP BY 1)
    SELECT count(*) AS queries, round(avg(hit), 4) AS hit_rate, round(avg(coalesce(1 / first, 0)), 4) AS mrr, avg(hit) >= 0.25 AS accepted FROM h
""")
def layer_evaluation(spark, sf):
    top = S.bm25(_docs(spark, sf), _asked(spark, sf), 10)
    hit = F.col("chunk") % 10 == F.col("query_id") % 10
    h = top.groupBy("query_id").agg(F.max(hit.cast("int")).alias("hit"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    return h.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), (F.avg("hit") >= 0.25).alias("accepted"))


@query("""
    WITH q AS (SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))), 1, 16) AS h FROM documents),
    c AS (SELECT h, min(doc_id) AS entry FROM q GROUP BY 1)
    SELECT doc_id, entry FROM q JOIN c USING (h) WHERE doc_id > entry
""")
def semantic_cache_lookup(spark, sf):
    q = t(spark, sf, "documents").select("doc_id", T.question_hash(F.col("text")).alias("h"))
    cache = q.groupBy("h").agg(F.min("doc_id").alias("entry"))
    return q.join(cache, "h").where("doc_id > entry").select("doc_id", "entry")


@query("""
    SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00') GROUP BY 1
""")
def purge_expired(spark, sf):
    e = t(spark, sf, "events")
    live = e.where(F.col("ts") >= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("user_id").distinct()
    return e.join(live, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events), s AS (SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1)
    SELECT s.user_id, n, top, l.event_type AS last_type, (l.event_type IS DISTINCT FROM 'click') AS changed FROM s JOIN l ON s.user_id = l.user_id AND l.i = 1
""")
def change_detection(spark, sf):
    e = t(spark, sf, "events")
    last = O.latest_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("last_type"))
    s = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return s.join(last, "user_id").withColumn("changed", ~F.col("last_type").eqNullSafe(F.lit("click")))


@query("""
    WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders)
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(i AS INTEGER) AS rank FROM n WHERE i <= 3
""")
def top_rows_per_concept(spark, sf):
    own = t(spark, sf, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    return own.where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""
    SELECT stage, doc_id FROM (SELECT 0 AS stage, doc_id FROM documents WHERE contains(lower(source), 'src19') AND lang = 'xx' UNION ALL SELECT 1, doc_id FROM documents WHERE contains(lower(source), 'src19')) WHERE stage = 1 ORDER BY doc_id LIMIT 12
""")
def catalog_map(spark, sf):
    d = t(spark, sf, "documents")
    hit = T.contains_ci(F.col("source"), "src19")
    return O.top_k(O.staged([d.where(hit & (F.col("lang") == "xx")), d.where(hit)]), 12, F.col("doc_id")).select("stage", "doc_id")


@query("""
    WITH a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS n, 0 AS p FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 5)),
    b AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS n, 1 AS p FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 5))
    SELECT event_id, CAST(row_number() OVER (ORDER BY n, p) AS INTEGER) AS position FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def topology_interleave(spark, sf):
    from ..operators.graph import interleave

    order = [F.desc("value"), F.col("event_id")]
    top = lambda kind: O.top_k(t(spark, sf, "events").where(F.col("event_type") == kind).select("event_id", "value"), 5, *order)
    return interleave([top("click"), top("error")], order).select("event_id", "position")
