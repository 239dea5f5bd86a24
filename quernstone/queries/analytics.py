"""Series, trends, statistics, conveniences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import prices as P
from ..operators import tables as O
from .registry import PRICES_SQL, prices, query, t

_MONTHLY = f"WITH {PRICES_SQL}, m AS (SELECT material, ym, spec, unit, floor(avg(price) * 100.0 + 0.5) / 100.0 AS price, count(*) AS n FROM prices GROUP BY ALL)"


@query(f"{_MONTHLY} SELECT * FROM m")
def monthly_average(spark, sf):
    return P.monthly(prices(spark, sf))


@query(f"""
    {_MONTHLY}, s AS (SELECT material, spec, unit, count(DISTINCT ym) AS months, max((ym = '1995-03')::INT) * max((ym = '1998-03')::INT) AS both_ends, sum(n) AS total, round(avg(price), 4) AS mean FROM m GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material ORDER BY months DESC, both_ends DESC, total DESC, mean DESC, spec, unit) AS i FROM s) WHERE i = 1)
    SELECT m.material, m.ym, m.spec, m.unit, m.price FROM m JOIN b ON m.material = b.material AND m.spec = b.spec AND m.unit = b.unit
""")
def dominant_series(spark, sf):
    return P.dominant_series(P.monthly(prices(spark, sf)), "1995-03", "1998-03").select("material", "ym", "spec", "unit", "price")


_POINTS = f"""
    {PRICES_SQL}, pts AS (SELECT series_key, ym, id, price FROM (
        SELECT concat_ws('|', material, spec, unit) AS series_key, ym, id, price, row_number() OVER (PARTITION BY material, spec, unit, ym ORDER BY id % 3, id) AS i FROM prices) WHERE i = 1)
"""


@query(f"WITH {_POINTS} SELECT series_key, ym, id, price FROM pts")
def trend_points(spark, sf):
    return P.trend_points(prices(spark, sf), F.col("id") % 3)


@query(f"""
    WITH {_POINTS}, l AS (SELECT *, lag(id) OVER w AS from_id, lag(price) OVER w AS old, lag(ym) OVER w AS from_ym FROM pts WINDOW w AS (PARTITION BY series_key ORDER BY ym))
    SELECT series_key, from_id, id AS to_id, floor((price - old) * 10000.0 + 0.5) / 10000.0 AS delta, floor((price - old) / old * 100 * 10000.0 + 0.5) / 10000.0 AS pct, CASE WHEN price > old THEN 'up' WHEN price < old THEN 'down' ELSE 'flat' END AS direction,
           (CAST(substr(ym, 1, 4) AS INT) - CAST(substr(from_ym, 1, 4) AS INT)) * 12 + CAST(substr(ym, 6, 2) AS INT) - CAST(substr(from_ym, 6, 2) AS INT) AS months_apart
    FROM l WHERE from_id IS NOT NULL
""")
def trend_relations(spark, sf):
    return P.trend_relations(P.trend_points(prices(spark, sf), F.col("id") % 3))


@query(f"""
    WITH {PRICES_SQL}, s AS (SELECT material, ym, min(unit) AS unit, round(avg(price), 2) AS price FROM prices GROUP BY 1, 2), l AS (SELECT *, lag(price) OVER w AS old, lag(unit) OVER w AS ou FROM s WINDOW w AS (PARTITION BY material ORDER BY ym))
    SELECT material, ym, unit, price, CASE WHEN old IS NOT NULL AND unit = ou THEN round(price - old, 4) END AS delta, CASE WHEN old IS NOT NULL AND unit = ou AND old <> 0 THEN round((price - old) / old * 100, 4) END AS pct,
           coalesce(old IS NOT NULL AND unit = ou AND old = 0, false) AS overflow, coalesce(old IS NOT NULL AND unit <> ou, false) AS unit_changed FROM l
""")
def month_over_month(spark, sf):
    s = prices(spark, sf).groupBy("material", "ym").agg(F.min("unit").alias("unit"), F.round(F.avg("price"), 2).alias("price"))
    return P.month_over_month(s, ["material"])


@query(f"""
    WITH {PRICES_SQL}, s AS (SELECT DISTINCT material, spec, ym FROM prices WHERE substr(ym, 6, 2) <> '06' AND hash(material) IS NOT NULL), k AS (SELECT DISTINCT material, spec FROM s),
    m AS (SELECT strftime(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS ym)
    SELECT k.material, k.spec, m.ym FROM k, m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.material = k.material AND s.spec = k.spec AND s.ym = m.ym)
""")
def calendar_gaps(spark, sf):
    return P.missing_months(prices(spark, sf).where(F.substring("ym", 6, 2) != "06"), ["material", "spec"], "1996-01", "1997-12")


@query(f"""
    WITH {PRICES_SQL}, x AS (SELECT * FROM prices WHERE material = (SELECT min(material) FROM prices)), a AS (SELECT max(ym) AS m FROM x WHERE ym < '1990-01'), b AS (SELECT min(ym) AS m FROM x WHERE ym > '1990-01')
    SELECT id, ym, round(price, 2) AS price, 3 AS stage FROM x, b WHERE x.ym = b.m ORDER BY ym DESC, x.price, id LIMIT 10
""")
def price_query(spark, sf):
    p = prices(spark, sf)
    name = p.agg(F.min("material")).first()[0]
    return P.price_query(p, name, 10, ym="1990-01").select("id", "ym", F.round("price", 2).alias("price"), "stage")


@query(f"""
    {_MONTHLY}, s AS (SELECT material, spec, unit, count(DISTINCT ym) AS months, max((ym = '1996-01')::INT) * max((ym = '1996-12')::INT) AS both_ends, sum(n) AS total, round(avg(price), 4) AS mean FROM m WHERE ym BETWEEN '1996-01' AND '1996-12' GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material ORDER BY months DESC, both_ends DESC, total DESC, mean DESC, spec, unit) AS i FROM s) WHERE i = 1),
    d AS (SELECT m.material, m.ym, m.price FROM m JOIN b ON m.material = b.material AND m.spec = b.spec AND m.unit = b.unit WHERE m.ym BETWEEN '1996-01' AND '1996-12'),
    sp AS (SELECT k.material, strftime(g, '%Y-%m') AS ym FROM (SELECT DISTINCT material FROM b) k, (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS g)),
    f AS (SELECT sp.material, sp.ym, d.price, last_value(d.price IGNORE NULLS) OVER (PARTITION BY sp.material ORDER BY sp.ym) AS filled FROM sp LEFT JOIN d ON d.material = sp.material AND d.ym = sp.ym)
    SELECT material, ym, price, filled, round(filled - lag(filled) OVER (PARTITION BY material ORDER BY ym), 4) AS delta FROM f
""")
def price_trend(spark, sf):
    from ..plans.trend import price_trend as plan

    return plan(prices(spark, sf), "1996-01", "1996-12")


@query("""
    SELECT l_shipmode AS key, * EXCLUDE (l_shipmode) FROM (SELECT l_returnflag AS l_shipmode, count(l_quantity) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 4) AS mean, quantile_cont(l_quantity, 0.5) AS median,
        round(stddev_pop(l_quantity), 4) AS std, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.95) AS p95, quantile_cont(l_quantity, 0.99) AS p99, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1)
""")
def number_stats(spark, sf):
    return P.number_stats(t(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]).withColumnRenamed("l_returnflag", "key")


@query("""
    WITH s AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
    SELECT event_id, e.event_type, value FROM events e JOIN s ON e.event_type = s.event_type WHERE n >= 5 AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
""")
def outliers_iqr(spark, sf):
    return P.outliers(t(spark, sf, "events"), "value", ["event_type"]).select("event_id", "event_type", "value")


@query("""
    WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY 1)
    SELECT event_id, e.event_type, value FROM events e JOIN s ON e.event_type = s.event_type WHERE n >= 5 AND (value < m - 3 * d OR value > m + 3 * d)
""")
def outliers_zscore(spark, sf):
    return P.outliers(t(spark, sf, "events"), "value", ["event_type"], "zscore").select("event_id", "event_type", "value")


@query("""
    SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 4) FROM lineitem
        UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 4) FROM lineitem) ORDER BY abs(r) DESC LIMIT 10
""")
def correlate_pearson(spark, sf):
    return P.correlate(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""
    WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
    SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(r.a, r.b), 4) AS r FROM r
""")
def correlate_spearman(spark, sf):
    return P.correlate(t(spark, sf, "part"), ["p_size", "p_retailprice"], "spearman")


@query(f"""
    WITH {PRICES_SQL}, m AS (SELECT material, ym, avg(price) AS y FROM prices GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY material ORDER BY ym) - 1 AS x FROM m),
    f AS (SELECT material, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, stddev_pop(y) * sqrt(greatest(0, 1 - coalesce(regr_r2(y, x), 1))) AS s FROM x GROUP BY 1 HAVING count(*) >= 3)
    SELECT material, CAST(step AS INTEGER) AS step, round(a + b * (n - 1 + step), 2) AS value, round(a + b * (n - 1 + step) - 1.96 * s, 2) AS low, round(a + b * (n - 1 + step) + 1.96 * s, 2) AS high, round(r2, 4) AS r2 FROM f, (SELECT unnest([1, 2, 3]) AS step)
""")
def forecast_series(spark, sf):
    return P.forecast(prices(spark, sf), ["material"], "ym", "price", 3)


@query()
def cluster_records(spark, sf):
    return P.cluster(t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""
    SELECT c_custkey, round(c_acctbal - 5000, 4) AS abs_change, round((c_acctbal - 5000) / 5000 * 100, 4) AS pct_change, round((c_acctbal - 5000) / 5000 * 100 * 100, 2) AS bp_change, CASE WHEN c_acctbal > 5000 THEN 'up' WHEN c_acctbal < 5000 THEN 'down' ELSE 'flat' END AS direction FROM customer
""")
def compare_values(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", *N.compared(F.lit(5000.0), F.col("c_acctbal")))


@query("SELECT p_partkey, round(p_size * CAST(0.001 AS DOUBLE), 8) AS metres, round(p_retailprice / 10000, 6) AS wan FROM part")
def unit_convert(spark, sf):
    return t(spark, sf, "part").select("p_partkey", N.convert(F.col("p_size"), "mm", "m").alias("metres"), F.round(N.convert(F.col("p_retailprice"), "元", "万元"), 6).alias("wan"))


@query("""
    SELECT o_orderkey, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due, quarter(o_orderdate) AS quarter,
           (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS months FROM orders
""")
def date_math(spark, sf):
    d = F.to_date("o_orderdate")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.datediff(d, F.lit("1995-01-01")).alias("days"), F.date_format(F.date_add(d, 30), "yyyy-MM-dd").alias("due"), F.quarter(d).alias("quarter"), N.months_between(F.date_format(d, "yyyy-MM"), F.lit("1995-01")).alias("months")
    )


@query("""
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) * 1000 ELSE epoch_us(ts) // 1000 // 1000 * 1000 END AS ms FROM events
""")
def epoch_normaliser(spark, sf):
    s = N.epoch_seconds(F.col("ts"))
    return t(spark, sf, "events").select("event_id", N.epoch_millis(F.when(F.col("user_id") % 3 == 0, s).otherwise(s * 1000)).alias("ms"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1997-03' WHEN 1 THEN '1997-03' WHEN 2 THEN '1997-03' WHEN 3 THEN '1997' ELSE NULL END AS period FROM part
""")
def period_normaliser(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("1997-3", "199703", "1997年3月", "1997", "march"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", T.period(raw).alias("period"))


@query("""
    SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))), 1, 16) AS hash FROM documents
""")
def question_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.question_hash(F.col("text")).alias("hash"))


@query("""
    WITH e AS (SELECT s_suppkey, s_acctbal, s_acctbal * 0.14 / 100 AS f FROM supplier)
    SELECT s_suppkey, CAST(rate AS DOUBLE) AS rate, round(s_acctbal * rate / 100, 2) AS fee FROM supplier, (SELECT unnest([0.25, 0.5, 1.0]) AS rate)
""")
def fee_calculation(spark, sf):
    r = t(spark, sf, "supplier").withColumn("rate", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))))
    return P.fees(r, F.col("s_acctbal"), F.col("rate")).select("s_suppkey", "rate", "fee")


@query("""
    SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1
""")
def metric_stats(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 4).alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("""
    SELECT n_name AS label, json_object('type', 'bar', 'title', n_name, 'x', list_transform(range(n_regionkey + 1), lambda i: CAST(i AS VARCHAR)))::VARCHAR AS spec FROM nation
""")
def chart_spec(spark, sf):
    x = F.transform(F.sequence(F.lit(0), F.col("n_regionkey")), lambda i: i.cast("string"))
    return t(spark, sf, "nation").select(F.col("n_name").alias("label"), F.to_json(F.struct(F.lit("bar").alias("type"), F.col("n_name").alias("title"), x.alias("x"))).alias("spec"))


@query("""
    SELECT n_name AS entity, q FROM nation, (SELECT unnest(['what', 'who', 'when', 'where', 'why', 'how']) AS w), (SELECT 1), LATERAL (SELECT w || ' ' || n_name || '?' AS q)
""")
def expand_question(spark, sf):
    words = F.explode(F.array(*map(F.lit, ("what", "who", "when", "where", "why", "how")))).alias("w")
    return t(spark, sf, "nation").select(F.col("n_name").alias("entity"), words).select("entity", F.concat("w", F.lit(" "), "entity", F.lit("?")).alias("q"))


@query("""
    WITH m AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS running FROM m
""")
def running_totals(spark, sf):
    m = t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return m.withColumn("running", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("""
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def rollup_extension(spark, sf):
    name = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c))
    got = t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(name("l_returnflag").alias("flag"), name("l_linestatus").alias("status"), F.count("*").alias("n"))
    return got.select("flag", "status", "n")
