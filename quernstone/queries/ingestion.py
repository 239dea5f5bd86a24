"""Blocks, chunks, tables, views, OCR quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import layout as LY
from ..operators import tablegrid as TG
from ..operators import tables as O
from .registry import CHUNKS_SQL, chunks, query, sql_tokens, t


@query("""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seq, text FROM (
        SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0)) AS text,
               generate_subscripts(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0), 1) AS pos FROM documents)
""")
def text_blocks(spark, sf):
    return I.paragraphs(t(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query()
def chunk_blocks(spark, sf):
    c = chunks(spark, sf)
    kind = F.when(F.col("page") % 9 == 0, "table_row").otherwise("text")
    return I.chunk_blocks(c.select("doc_id", F.floor(F.col("page") / 4).alias("page"), F.col("page").alias("seq"), kind.alias("type"), F.col("content").alias("text")))


@query("""
    SELECT doc_id, CAST((s - 1) // 450 AS INTEGER) AS n, CAST(s AS INTEGER) AS start, substr(text, s, 500) AS piece FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 450)) AS s FROM documents) WHERE s = 1 OR s - 1 + 50 < length(text)
""")
def overlapping_windows(spark, sf):
    return I.text_windows(t(spark, sf, "documents"), "doc_id", "text")


@query("""
    SELECT page_id, len(regexp_extract_all(html, '(?s)<tr[^>]*>')) AS n_rows, len(regexp_extract_all(html, '<li[^>]*>')) AS n_items FROM pages
""")
def html_structure(spark, sf):
    rows = F.regexp_count("html", F.lit("(?s)<tr[^>]*>")).cast("long")
    return t(spark, sf, "pages").select("page_id", rows.alias("n_rows"), F.regexp_count("html", F.lit("<li[^>]*>")).cast("long").alias("n_items"))


@query("""
    WITH r AS (SELECT s_suppkey, [['name', 'unit', 'price'], [s_name, 'kg', CAST(s_nationkey AS VARCHAR)]] AS x FROM supplier)
    SELECT s_suppkey, '| ' || array_to_string(x[1], ' | ') || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || array_to_string(x[2], ' | ') || ' |' AS md FROM r
""")
def markdown_table(spark, sf):
    rows = F.array(F.array(F.lit("name"), F.lit("unit"), F.lit("price")), F.array("s_name", F.lit("kg"), F.col("s_nationkey").cast("string")))
    return t(spark, sf, "supplier").select("s_suppkey", I.markdown_table(rows).alias("md"))


@query("""
    SELECT p_partkey AS table_id, CAST(1 AS INTEGER) AS row, p_name AS name, p_type AS spec, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS unit, CAST(p_size AS VARCHAR) AS extra FROM part
""")
def cells_to_rows(spark, sf):
    p = t(spark, sf, "part")
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.cast("string").alias("text"))
    head = [cell(0, i, F.lit(h)) for i, h in enumerate(("材料名称", "规格型号", "单位", "odd"))]
    body = [cell(1, 0, F.col("p_name")), cell(1, 1, F.col("p_type")), cell(1, 2, F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise(" ")), cell(1, 3, F.col("p_size"))]
    cells = p.select(F.col("p_partkey").alias("table_id"), F.inline(F.array(*head, *body)))
    got = I.cells_to_rows(cells, ["table_id"])
    c = lambda k: F.col("cells")[k]
    return got.select("table_id", "row", c("material_name").alias("name"), c("spec").alias("spec"), c("unit").alias("unit"), c("col_3").alias("extra"))


@query(f"""
    WITH {CHUNKS_SQL}, p AS (SELECT chunk_id, doc_id, page // 3 AS page, content FROM chunks), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY chunk_id) AS i FROM p),
    s AS (SELECT doc_id, page, substr(string_agg(content, chr(10) ORDER BY chunk_id), 1, 1200) AS x FROM n WHERE i <= 6 GROUP BY 1, 2)
    SELECT chunk_id, 'raw' AS view_type, length(content) AS n FROM p UNION ALL SELECT chunk_id, 'page_summary', length(x) FROM p JOIN s ON p.doc_id = s.doc_id AND p.page = s.page
""")
def page_views(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "doc_id", F.floor(F.col("page") / 3).alias("page"), "content")
    return I.page_views(c).where("view_type <> 'semantic_terms'").select("chunk_id", "view_type", F.length("text").cast("long").alias("n"))


@query(f"""
    WITH {CHUNKS_SQL}, w AS (SELECT doc_id, page, unnest(list_distinct({sql_tokens('content')})) AS w FROM chunks), d AS (SELECT DISTINCT doc_id, page, w FROM w WHERE length(w) >= 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY encode(w)) AS i FROM d)
    SELECT c.chunk_id, substr(x.terms, 1, 900) AS terms FROM chunks c JOIN (SELECT doc_id, page, string_agg(w, ' | ' ORDER BY i) AS terms FROM r WHERE i <= 24 GROUP BY 1, 2) x ON c.doc_id = x.doc_id AND c.page = x.page
""")
def semantic_terms(spark, sf):
    got = I.page_views(chunks(spark, sf)).where("view_type = 'semantic_terms'")
    return got.select("chunk_id", F.col("text").alias("terms"))


@query("""
    SELECT b.doc_id, count(*) AS blocks, count(*) FILTER (b.c < 0.7) AS low_blocks, round(avg(b.c), 4) AS confidence FROM (SELECT doc_id, round((doc_id * 7 + pos * 13) % 100 / 100.0, 2) AS c FROM (
        SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> '') b GROUP BY 1
""")
def ocr_confidence(spark, sf):
    c = chunks(spark, sf).select("doc_id", F.lit("text").alias("type"), F.col("content").alias("text"), F.round((F.col("doc_id") * 7 + F.col("page") * 13) % 100 / 100, 2).alias("confidence"))
    n = c.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    return I.ocr_quality(c).join(n, "doc_id").select("doc_id", "blocks", "low_blocks", "confidence")


_BOXES = "boxes AS (SELECT o_orderkey // 100 AS page_id, o_orderkey AS id, CAST(o_orderkey % 7 * 40 AS DOUBLE) AS x, CAST(o_orderkey % 11 * 25 AS DOUBLE) AS y, 30.0 AS w, 20.0 AS h, o_orderpriority AS text FROM orders)"


def _boxes(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(F.floor(k / 100).cast("long").alias("page_id"), k.alias("id"), (k % 7 * 40).cast("double").alias("x"), (k % 11 * 25).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(20.0).alias("h"), F.col("o_orderpriority").alias("text"))


@query(f"""
    WITH {_BOXES} SELECT a.page_id, a.id AS id1, b.id AS id2 FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.id < b.id AND a.x <= b.x + b.w + 1 AND b.x <= a.x + a.w + 1 AND a.y <= b.y + b.h + 1 AND b.y <= a.y + a.h + 1
""")
def box_overlaps(spark, sf):
    return I.overlapping_boxes(_boxes(spark, sf), ["page_id"])


@query(f"""
    WITH {_BOXES}, a AS (SELECT *, coalesce((abs(y + h / 2 - lag(y + h / 2) OVER (PARTITION BY page_id ORDER BY y, id)) >= 40)::INT, 1) AS brk FROM boxes),
    r AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY page_id ORDER BY y, id) AS BIGINT) AS row_no FROM a)
    SELECT page_id, id, row_no FROM r
""")
def layout_rows(spark, sf):
    return LY.rows(_boxes(spark, sf)).select("page_id", "id", "row_no")


@query(f"""
    WITH {_BOXES}, a AS (SELECT *, coalesce((abs(y + h / 2 - lag(y + h / 2) OVER (PARTITION BY page_id ORDER BY y, id)) >= 20)::INT, 1) AS brk FROM boxes),
    r AS (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY y, id) AS row_no FROM a), c AS (SELECT page_id, row_no, count(*) AS cells FROM r GROUP BY 1, 2),
    b AS (SELECT *, sum((cells < 2)::INT) OVER (PARTITION BY page_id ORDER BY row_no) AS table_no FROM c), g AS (SELECT page_id, table_no FROM b WHERE cells >= 2 GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(cells) >= 4)
    SELECT r.page_id, r.id, CAST(b.table_no AS BIGINT) AS table_no FROM r JOIN b ON r.page_id = b.page_id AND r.row_no = b.row_no AND b.cells >= 2 JOIN g ON g.page_id = b.page_id AND g.table_no = b.table_no
""")
def table_regions(spark, sf):
    return LY.regions(LY.rows(_boxes(spark, sf), gap=20.0)).select("page_id", "id", "table_no")


@query("""
    SELECT d.doc_id, coalesce(l.n, 0) AS labelled, coalesce(b.n, 0) AS embedded, array_to_string(list_filter([CASE WHEN l.n IS NULL THEN 'labelled' END, CASE WHEN b.n IS NULL THEN 'embedded' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id LEFT JOIN (SELECT vec_id AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) b ON d.doc_id = b.doc_id
""")
def store_completeness(spark, sf):
    return I.completeness(t(spark, sf, "documents"), {"labelled": t(spark, sf, "labels"), "embedded": t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")})


@query("""
    SELECT doc_id, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 3000 THEN 'medium' ELSE 'large' END AS route FROM documents
""")
def route_by_size(spark, sf):
    return I.route_by_size(t(spark, sf, "documents"), "n_chars", 500, 3000).select("doc_id", "route")


@query("""
    WITH f AS (SELECT c_custkey AS id, 'doc' || (c_custkey % 100) || CASE c_custkey % 7 WHEN 0 THEN '_merged_ocr.json' WHEN 1 THEN '_ocr.json' ELSE '_chunk_' || (c_custkey % 7) || '.json' END AS name, c_custkey % 100 AS d,
               CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS r FROM customer)
    SELECT id, name FROM f WHERE r = (SELECT min(r) FROM f g WHERE g.d = f.d)
""")
def ocr_file_choice(spark, sf):
    k = F.col("c_custkey")
    end = F.when(k % 7 == 0, "_merged_ocr.json").when(k % 7 == 1, "_ocr.json").otherwise(F.concat(F.lit("_chunk_"), (k % 7).cast("string"), F.lit(".json")))
    files = t(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("doc"), (k % 100).cast("string"), end).alias("name"))
    return I.pick_ocr_files(files).select("id", "name")


@query("""
    SELECT 'doc' || (l_orderkey // 50) AS base, count(*) AS pages, string_agg(l_comment, chr(10) ORDER BY l_linenumber, l_orderkey, l_comment) AS text FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS l_comment FROM lineitem) GROUP BY 1
""")
def ocr_chunk_merge(spark, sf):
    own = t(spark, sf, "lineitem")
    parts = own.select(F.concat(F.lit("doc"), F.expr("l_orderkey div 50").cast("string"), F.lit("_chunk_"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_orderkey").alias("page"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return I.merge_ocr_chunks(parts)


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'm³' ELSE 'm²' END AS unit, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS price FROM part
""")
def price_cell_cleaning(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "n/a").otherwise(F.concat(F.lit("¥ "), F.col("p_size").cast("string"), F.lit(" 元")))
    return t(spark, sf, "part").select("p_partkey", I.clean_unit(F.when(k % 3 == 0, "中砂").otherwise("pipe"), F.lit("㎡?")).alias("unit"), I.clean_price(raw).alias("price"))


@query(f"""
    WITH d AS (SELECT doc_id, unnest({sql_tokens('text')}) AS w FROM documents), v AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS name FROM d WHERE length(w) >= 14 UNION SELECT 'chunk', 'c' || doc_id FROM d WHERE length(w) >= 14 UNION SELECT 'entity', w FROM d WHERE length(w) >= 14)
    SELECT kind, count(*) AS n FROM v GROUP BY 1
""")
def graph_write(spark, sf):
    from ..sources.sinks import graph_tables

    c = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    vertices, _ = graph_tables(c, F.filter(T.distinct_tokens(F.col("text")), lambda w: F.length(w) >= 14))
    return vertices.groupBy("kind").agg(F.count("*").alias("n"))


@query("""
    SELECT event_id, json_object('kind', event_type, 'user', user_id)::VARCHAR AS payload FROM events
""")
def payload_builder(spark, sf):
    return t(spark, sf, "events").select("event_id", I.payload(kind=F.col("event_type"), user=F.col("user_id")).alias("payload"))


@query(f"""
    WITH {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS i, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS used FROM chunks)
    SELECT doc_id, count(*) AS taken, CAST(max(used) AS BIGINT) AS chars FROM n WHERE i <= 3 AND used <= 4000 GROUP BY 1
""")
def context_builder(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    own = chunks(spark, sf).withColumn("used", F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return O.latest_per_key(own, ["doc_id"], [F.col("chunk_id")], 3).where("used <= 4000").groupBy("doc_id").agg(F.count("*").alias("taken"), F.max("used").alias("chars"))


@query(f"""
    WITH {CHUNKS_SQL} SELECT chunk_id, lag(content) OVER w AS before, lead(content) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)
""")
def neighbour_context(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    return chunks(spark, sf).select("chunk_id", F.lag("content").over(w).alias("before"), F.lead("content").over(w).alias("after"))


_MERGED = """
    p AS (SELECT p_partkey // 20 AS table_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS INTEGER) AS row, p_name, p_type, p_retailprice, p_partkey FROM part)
"""


def _merged_cells(spark, sf):
    """Price tables of twenty parts each: a head, then a row a part, neighbouring rows of one type sharing its cell, and the unit above a price that spans both their columns where there is none."""
    along = Window.partitionBy("table_id").orderBy("row")
    p = t(spark, sf, "part").withColumn("table_id", F.expr("p_partkey div 20")).withColumn("row", F.row_number().over(Window.partitionBy("table_id").orderBy("p_partkey")))
    p = p.withColumn("new", F.coalesce((F.lag("p_type").over(along) != F.col("p_type")).cast("int"), F.lit(1)))
    p = p.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("down", F.count("*").over(Window.partitionBy("table_id", "run")))
    cell = lambda seq, text, down, across: F.struct(F.lit(seq).alias("seq"), text.cast("string").alias("text"), down.cast("int").alias("rowspan"), across.cast("int").alias("colspan"))
    one, none = F.lit(1), F.lit(None)
    bare = F.col("p_partkey") % 7 == 0
    first = F.when(F.col("new") == 1, cell(0, F.col("p_type"), F.col("down"), one))
    body = F.filter(F.array(first, cell(1, F.col("p_name"), none, one), F.when(~bare, cell(2, F.lit("t"), one, one)), cell(3, F.format_string("%.2f", "p_retailprice"), one, F.when(bare, 2).otherwise(1))), lambda c: c.isNotNull())
    head = F.array(cell(0, F.lit("规格"), one, one), cell(1, F.lit("名称"), one, one), cell(2, F.lit("单位和价格"), one, F.lit(2)))
    heads = p.select("table_id").distinct().select("table_id", F.lit(0).alias("row"), F.inline(head))
    return heads.unionByName(p.select("table_id", "row", F.inline(body)))


@query(f"""
    WITH {_MERGED}, n AS (SELECT *, coalesce(p_type <> lag(p_type) OVER (PARTITION BY table_id ORDER BY row), true) AS fresh, p_partkey % 7 = 0 AS bare FROM p)
    SELECT DISTINCT table_id, CAST(0 AS INTEGER) AS row, CAST(c AS INTEGER) AS col, ['规格', '名称', '单位和价格', '单位和价格'][c + 1] AS text, c = 3 AS merged FROM p, range(0, 4) r(c)
    UNION ALL SELECT table_id, row, 0, p_type, NOT fresh FROM n UNION ALL SELECT table_id, row, 1, p_name, false FROM n
    UNION ALL SELECT table_id, row, 2, CASE WHEN bare THEN printf('%.2f', p_retailprice) ELSE 't' END, false FROM n UNION ALL SELECT table_id, row, 3, printf('%.2f', p_retailprice), bare FROM n
""")
def merged_cell_grid(spark, sf):
    return TG.grid(_merged_cells(spark, sf))


@query(f"""
    WITH {_MERGED} SELECT table_id, row, p_type AS name, p_name AS spec, CASE WHEN p_partkey % 7 <> 0 THEN 't' END AS unit, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS price FROM p
""")
def grid_price_lines(spark, sf):
    """Price lines of the tables with merged cells: the first text column counts as the name, the second as the specification; a bare price lies in the units' column too and is no unit."""
    own = TG.price_lines(TG.grid(_merged_cells(spark, sf)))
    return own.withColumn("unit", F.when(F.col("unit").rlike(TG.UNIT), F.col("unit")))
