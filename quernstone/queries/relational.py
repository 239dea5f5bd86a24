"""Scans, filters, joins, aggregates, windows, sets, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as O
from .registry import CHUNKS_SQL, PRICES_SQL, chunks, prices, query, t


@query("""
    SELECT l_returnflag AS bucket, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_linestatus = 'O'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200
""")
def aggregate_query(spark, sf):
    got = O.aggregate(t(spark, sf, "lineitem"), "l_returnflag", "sum", "l_extendedprice", "l_linestatus = 'O'")
    return got.select("bucket", F.round("value", 2).alias("value"))


_TABLES = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _listed(name):
    columns = _TABLES[name].split()
    return f"SELECT '{name}' AS name, count(*) AS n_rows, {len(columns)} AS n_columns, '{','.join(columns[:6])}' AS first_columns FROM {name}"


@query(" UNION ALL ".join(map(_listed, _TABLES)))
def list_tables(spark, sf):
    out = None
    for name in _TABLES:
        df = t(spark, sf, name)
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns[:6])).alias("first_columns"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""
    SELECT 1 AS ordinal, 'c_custkey' AS "column", 'bigint' AS type, count(c_custkey) AS non_null FROM customer
    UNION ALL SELECT 2, 'c_name', 'string', count(c_name) FROM customer UNION ALL SELECT 3, 'c_nationkey', 'int', count(c_nationkey) FROM customer
    UNION ALL SELECT 4, 'c_acctbal', 'double', count(c_acctbal) FROM customer UNION ALL SELECT 5, 'c_mktsegment', 'string', count(c_mktsegment) FROM customer
""")
def describe_table(spark, sf):
    return O.describe(t(spark, sf, "customer"))


@query("SELECT doc_id, lang, source FROM documents WHERE lower(source) LIKE '%src1%' ORDER BY doc_id LIMIT 100")
def list_documents(spark, sf):
    df = t(spark, sf, "documents").where(T.contains_ci(F.col("source"), "src1")).select("doc_id", "lang", "source")
    return O.top_k(df, 100, F.col("doc_id"), most=100)


@query(f"""
    WITH {CHUNKS_SQL}, seed AS (SELECT min(chunk_id) AS id, min_by(doc_id, chunk_id) AS doc FROM chunks WHERE page = 3)
    SELECT chunk_id, c.doc_id, abs(chunk_id - seed.id) AS distance FROM chunks c, seed WHERE c.doc_id = seed.doc
    ORDER BY distance, chunk_id LIMIT 5
""")
def fetch_chunk(spark, sf):
    c = chunks(spark, sf)
    seed = c.where("page = 3").agg(F.min("chunk_id").alias("id"), F.min_by("doc_id", "chunk_id").alias("doc"))
    near = c.join(F.broadcast(seed), F.col("doc_id") == F.col("doc")).select("chunk_id", "doc_id", F.abs(F.col("chunk_id") - F.col("id")).alias("distance"))
    return O.top_k(near, 5, F.col("distance"), F.col("chunk_id"))


@query("""
    SELECT count(*) AS n, round(count(embedding) / count(*), 3) AS coverage, min(label) AS least, max(label) AS most FROM embeddings
""")
def stats_overview(spark, sf):
    return t(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.round(F.count("embedding") / F.count("*"), 3).alias("coverage"), F.min("label").alias("least"), F.max("label").alias("most"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sql_query(spark, sf):
    t(spark, sf, "orders").createOrReplaceTempView("quern_orders")
    return O.read_only_sql(spark, "SELECT o_orderstatus, count(*) AS n FROM quern_orders GROUP BY 1")


@query("""
    SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%e%' OR p_type ILIKE '%st%') AND NOT regexp_matches(p_name, '^[0-9.]+$')
      AND NOT regexp_matches(p_name, '(fee|元)$')
""")
def noise_filter(spark, sf):
    p = t(spark, sf, "part")
    return p.where((F.col("p_name").ilike("%e%") | F.col("p_type").ilike("%st%")) & ~F.col("p_name").rlike("^[0-9.]+$") & ~F.col("p_name").rlike("(fee|元)$")).select("p_partkey", "p_name")


@query(f"""
    WITH {PRICES_SQL}
    SELECT id, ym, price FROM prices WHERE ym LIKE '1997-%' AND ym >= '1997-03' AND ym <= '1997-05'
""")
def period_filter(spark, sf):
    return prices(spark, sf).where(F.col("ym").like("1997-%") & F.col("ym").between("1997-03", "1997-05")).select("id", "ym", "price")


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90
""")
def json_predicate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf, "events").where(k > 90).select("event_id", k.alias("k"))


@query(f"""
    WITH {CHUNKS_SQL}
    SELECT chunk_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(content) ORDER BY chunk_id) AS n FROM chunks) WHERE n = 1
""")
def content_dedupe(spark, sf):
    from ..operators.search import content_dedupe as dedupe

    return dedupe(chunks(spark, sf), [F.col("chunk_id")]).select("chunk_id", "doc_id")


@query("""
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def latest_event_per_key(spark, sf):
    return O.latest_per_key(t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""
    WITH n AS (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL)
    SELECT a.l_suppkey AS source, b.l_suppkey AS target, least(10, count(*)) AS weight FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
    GROUP BY 1, 2 HAVING count(*) >= 2
""")
def cooccurrence_join(spark, sf):
    from ..operators.graph import cooccurrence

    return cooccurrence(t(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey", least=2)


@query(f"""
    WITH {CHUNKS_SQL}, names AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS name FROM part UNION SELECT 'idiot' UNION SELECT 'example.com')
    SELECT name, count(*) AS hits FROM names JOIN chunks ON contains(lower(content), lower(name)) GROUP BY 1
""")
def containment_join(spark, sf):
    from ..operators.graph import containment_join as join

    own = t(spark, sf, "part").select(F.split("p_type", " ")[0].alias("name")).distinct()
    names = own.unionByName(spark.range(1).select(F.explode(F.array(F.lit("idiot"), F.lit("example.com"))).alias("name"))).distinct()
    return join(chunks(spark, sf), names, "content", "name").groupBy("name").agg(F.count("*").alias("hits"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_join(spark, sf):
    o = t(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1"))
    return t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'")
    return t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
    SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN LATERAL (
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true
""")
def lateral_latest_row(spark, sf):
    last = O.latest_per_key(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return t(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
    WITH e AS (SELECT user_id, count(*) AS n, max(event_type) AS kind FROM events WHERE user_id % 7 <> 0 GROUP BY 1),
         a AS (SELECT user_id, count(*) + (user_id % 5 = 0)::INT AS n, max(event_type) AS kind FROM events WHERE user_id % 11 <> 0 GROUP BY 1)
    SELECT coalesce(e.user_id, a.user_id) AS user_id,
           CASE WHEN a.user_id IS NULL THEN 'missing' WHEN e.user_id IS NULL THEN 'stale' ELSE 'mismatched' END AS kind,
           CASE WHEN a.user_id IS NULL OR e.user_id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN e.n IS DISTINCT FROM a.n THEN 'n' END, CASE WHEN e.kind IS DISTINCT FROM a.kind THEN 'kind' END], lambda x: x IS NOT NULL), ',') END AS fields
    FROM e FULL JOIN a ON e.user_id = a.user_id
    WHERE a.user_id IS NULL OR e.user_id IS NULL OR e.n IS DISTINCT FROM a.n OR e.kind IS DISTINCT FROM a.kind
""")
def projection_drift(spark, sf):
    ev = t(spark, sf, "events")
    n = F.count("*")
    e = ev.where("user_id % 7 <> 0").groupBy("user_id").agg(n.alias("n"), F.max("event_type").alias("kind"))
    a = ev.where("user_id % 11 <> 0").groupBy("user_id").agg((n + (F.col("user_id") % 5 == 0).cast("int")).alias("n"), F.max("event_type").alias("kind"))
    return O.drift(e, a, ["user_id"], ["n", "kind"])


@query(f"""
    WITH {PRICES_SQL}, m AS (SELECT material, ym, round(avg(price), 2) AS price FROM prices WHERE substr(ym, 6, 2) IN ('02', '05', '09') GROUP BY 1, 2),
    asked AS (SELECT DISTINCT material, '1996-' || mm AS ym FROM prices, (SELECT unnest(['01', '04', '05', '12']) AS mm)),
    p AS (SELECT a.material, a.ym, max_by(m.ym, m.ym) FILTER (m.ym <= a.ym) AS prev, min(m.ym) FILTER (m.ym > a.ym) AS nxt FROM asked a LEFT JOIN m ON a.material = m.material GROUP BY 1, 2)
    SELECT p.material, p.ym, coalesce(prev, nxt) AS found_at, m.price, CASE WHEN prev IS NOT NULL THEN 'previous' WHEN nxt IS NOT NULL THEN 'following' ELSE 'none' END AS fallback
    FROM p LEFT JOIN m ON m.material = p.material AND m.ym = coalesce(prev, nxt)
""")
def as_of_price(spark, sf):
    p = prices(spark, sf)
    m = p.where(F.substring("ym", 6, 2).isin("02", "05", "09")).groupBy("material", "ym").agg(F.round(F.avg("price"), 2).alias("price"))
    asked = p.select("material").distinct().select("material", F.explode(F.array(*[F.lit("1996-" + x) for x in ("01", "04", "05", "12")])).alias("ym"))
    return O.as_of(asked, m, ["material"], "ym", "price")


@query(f"""
    WITH {PRICES_SQL} SELECT material, round(min(price), 2) AS low, round(avg(price), 2) AS mean, round(max(price), 2) AS high, count(*) AS n, count(DISTINCT unit) AS units,
           count(*) FILTER (WHERE price > 1000) AS dear, max(ym) AS latest, round(stddev_pop(price) / avg(price), 4) AS cv
    FROM prices GROUP BY 1
""")
def price_range(spark, sf):
    from ..operators.prices import price_range as ranged

    return ranged(prices(spark, sf), ["material"])


@query(f"""
    WITH {PRICES_SQL}, c AS (SELECT material, spec, count(*) AS n FROM prices GROUP BY 1, 2)
    SELECT material, spec, n FROM (SELECT *, row_number() OVER (PARTITION BY material ORDER BY n DESC, spec) AS i FROM c) WHERE i = 1
""")
def most_common_spec(spark, sf):
    c = prices(spark, sf).groupBy("material", "spec").agg(F.count("*").alias("n"))
    return O.latest_per_key(c, ["material"], [F.desc("n"), F.col("spec")])


@query("""
    SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors,
           round(avg(CASE WHEN event_type = 'purchase' THEN value END), 4) AS mean_purchase
    FROM events GROUP BY 1
""")
def daily_buckets(spark, sf):
    day = F.date_format(F.from_utc_timestamp("ts", "Asia/Shanghai"), "yyyy-MM-dd")
    return t(spark, sf, "events").groupBy(day.alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("mean_purchase")
    )


@query("""
    SELECT coalesce(json_extract_string(props, '$.source'), 'unknown') AS source, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def source_breakdown(spark, sf):
    return t(spark, sf, "events").groupBy(F.coalesce(F.get_json_object("props", "$.source"), F.lit("unknown")).alias("source"), "event_type").agg(F.count("*").alias("n"))


@query("""
    SELECT n_regionkey AS region, array_to_string(list_sort(list(n_name)), ',') AS nations, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) >= 2
""")
def array_agg_having(spark, sf):
    return t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"), F.count("*").alias("n")).where("n >= 2")


@query("""
    SELECT 'both' AS kind, c_nationkey AS nation FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customers_only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
""")
def key_sets(spark, sf):
    c, s = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).select(F.lit("both").alias("kind"), "nation").unionByName(c.subtract(s).select(F.lit("customers_only").alias("kind"), "nation"))


@query("""
    SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + user_id % 3)::INT AS turn_index FROM events
""")
def turn_numbering(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, sf, "events").select("user_id", "event_id", (n + F.col("user_id") % 3).cast("int").alias("turn_index"))


@query("""
    SELECT event_id, user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) > 0.3 AS failing
    FROM events
""")
def rolling_failure_rate(spark, sf):
    from ..operators.learning import rolling_failure

    return rolling_failure(t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 10, 0.3).select("event_id", "user_id", "failing")


@query("""
    WITH old AS (SELECT p_partkey AS id, p_name AS name, p_size AS vec FROM part WHERE p_partkey % 3 <> 0),
         new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 END AS vec FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.vec ELSE coalesce(n.vec, o.vec) END AS vec
    FROM old o FULL JOIN new n ON o.id = n.id
""")
def upsert_keep_embedding(spark, sf):
    old, new = _old_new(spark, sf)
    return O.upsert(old, new, ["id"], keep_if_null=["vec"])


@query("""
    WITH old AS (SELECT p_partkey AS id, p_name AS name, p_size AS vec FROM part WHERE p_partkey % 3 <> 0),
         new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 END AS vec FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name,
           CASE WHEN n.id IS NULL THEN o.vec ELSE coalesce(n.vec, CASE WHEN o.name IS NOT DISTINCT FROM n.name THEN o.vec END) END AS vec
    FROM old o FULL JOIN new n ON o.id = n.id
""")
def upsert_if_unchanged(spark, sf):
    old, new = _old_new(spark, sf)
    return O.upsert(old, new, ["id"], keep_if_same={"vec": "name"})


def _old_new(spark, sf):
    p = t(spark, sf, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("vec"))
    new = p.where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).alias("vec")
    )
    return old, new


@query("""
    SELECT user_id, event_id FROM (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1)
    UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1
""")
def insert_ignore(spark, sf):
    ev = t(spark, sf, "events")
    old = ev.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return O.insert_ignore(old, ev.where("event_type = 'error'").select("user_id", "event_id"), ["user_id"], [F.col("event_id")])


@query("""
    SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50) GROUP BY 1
""")
def drop_stale(spark, sf):
    ev = t(spark, sf, "events")
    return O.drop_stale(ev.groupBy("user_id").agg(F.count("*").alias("n")), ev.where("event_type = 'purchase' AND value > 50"), ["user_id"])


@query("""
    WITH c AS (SELECT lower(p_name) AS normalized, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT normalized, arg_max(name, (n, name)) AS concept_name, CAST(sum(n) AS BIGINT) AS n, count(*) AS spellings FROM c GROUP BY 1
""")
def concept_upsert(spark, sf):
    from ..operators.graph import concepts

    return concepts(t(spark, sf, "part"), "p_name").select("normalized", "concept_name", "n", "spellings")


@query(f"""
    WITH {PRICES_SQL}, s AS (
        SELECT 0 AS stage, id, price FROM prices WHERE material = 'no such thing' UNION ALL
        SELECT 1, id, price FROM prices WHERE spec LIKE '%COPPER%' AND ym = '1990-01' UNION ALL
        SELECT 2, id, price FROM prices WHERE ym = '1998-07')
    SELECT stage, id, price FROM s WHERE stage = (SELECT min(stage) FROM s)
""")
def staged_fallback(spark, sf):
    p = prices(spark, sf).select("id", "price", "material", "spec", "ym")
    stages = [p.where("material = 'no such thing'"), p.where("spec LIKE '%COPPER%' AND ym = '1990-01'"), p.where("ym = '1998-07'")]
    return O.staged([s.select("id", "price") for s in stages]).select("stage", "id", "price")
