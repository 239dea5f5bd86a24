"""From blocks and cells to chunks, rows, views and records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Headers of a table and what they name.
HEADER_KEYS = {
    "项目": "material_name", "材料": "material_name", "材料名称": "material_name",
    "名称": "material_name", "品名": "material_name", "工料名称": "material_name",
    "规格": "spec", "规格型号": "spec", "型号": "spec", "规格及型号": "spec",
    "单位": "unit", "计量单位": "unit",
    "单价": "price", "价格": "price", "含税单价": "price", "除税单价": "price",
    "市场价": "price", "信息价": "price", "综合单价": "price",
    "时间": "period", "期号": "period", "年月": "period", "时期": "period",
    "编号": "code", "代码": "code", "编码": "code",
}
#: Words in the header of a price table that name a column.
HEADERS = {"name": ["材料", "名称", "name", "item"], "spec": ["规格", "型号", "spec"], "unit": ["单位", "unit"], "price_taxed": ["含税"], "price_untaxed": ["除税", "不含税"], "price": ["价格", "单价", "price"]}
#: Words that give a fee's category, the first that fits, and materials sold by volume.
FEE_CATEGORIES = [
    ("安全文明", "安全文明施工费"), ("文明施工", "安全文明施工费"), ("赶工", "赶工措施费"), ("夜间", "夜间施工增加费"), ("总包", "总承包服务费"), ("总承包", "总承包服务费"),
    ("企业管理", "企业管理费"), ("利润", "利润"), ("担保", "履约担保手续费"), ("计日工", "计日工"),
]
OTHER_FEES = "其他项目费"
BY_VOLUME = ["中砂", "碎石", "碎石5~25", "碎石5～25", "石粉渣"]
MAX_PRICE = 1_000_000.0


def paragraphs(texts: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One block for each paragraph that isn't empty, trimmed, in order."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
    return texts.select(*keys, F.posexplode(parts).alias("seq", "text"))


def csv_blocks(rows: DataFrame, key: str, cells: str, order: str) -> DataFrame:
    """A header block and a `name: value | ...` block for each row that isn't empty; cells beyond the header are col<i>."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    own = rows.withColumn("n", F.row_number().over(w)).withColumn("header", F.first(cells).over(w))
    name = lambda i: F.when(i < F.size("header"), F.element_at("header", i + 1)).otherwise(F.concat(F.lit("col"), i.cast("string")))
    pairs = F.transform(F.col(cells), lambda c, i: F.when(F.trim(c) != "", F.concat(name(i), F.lit(": "), F.trim(c))))
    body = F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")
    text = F.when(F.col("n") == 1, F.array_join("header", " | ")).otherwise(body)
    return own.select(key, "n", F.when(F.col("n") == 1, "caption").otherwise("table_row").alias("type"), text.alias("text")).where("text <> ''")


def chunk_blocks(blocks: DataFrame, max_chars: int = 400) -> DataFrame:
    """Text blocks (doc_id, page, seq, type, text) merged within a page up to a size; other types stay alone; long ones are cut.

    What a block joins hangs on those before it, so blocks are dealt out by document, sorted by Spark, and read
    in one pass that holds one chunk at a time.
    """
    names = ["doc_id", "chunk_index", "page", "type", "text"]

    def each(batches):
        doc = at = None
        held: list[str] = []
        out: list[tuple] = []
        n = 0

        def put(page, kind, text):
            nonlocal n
            out.append((doc, n, page, kind, text))
            n += 1

        def flush():
            if held:
                put(at, "text", "\n\n".join(held))
                held.clear()

        def batch():
            got = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)
            out.clear()
            return got

        for b in batches:
            for new, page, kind, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if new != doc:
                    flush()
                    doc, at, n = new, None, 0
                if kind != "text" or page != at:
                    flush()
                at = page
                if kind != "text":
                    put(page, kind, text)
                    continue
                if held and sum(map(len, held)) + len(text) + 2 > max_chars:
                    flush()
                    if len(text) > max_chars:
                        for k in range(0, len(text), max_chars):
                            put(page, "text", text[k : k + max_chars])
                        continue
                held.append(text)
            if out:
                yield batch()
        flush()
        if out:
            yield batch()

    own = blocks.where("text is not null").select(F.col("doc_id").cast("long"), F.col("page").cast("long"), "seq", "type", "text")
    return own.repartition("doc_id").sortWithinPartitions("doc_id", "page", "seq").mapInArrow(each, "doc_id long, chunk_index long, page long, type string, text string")


def text_windows(texts: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Overlapping windows; the last ends with the text."""
    return texts.select(key, F.posexplode(T.windows(F.col(text), size, overlap)).alias("n", "w")).select(key, "n", F.col("w.start").alias("start"), F.col("w.piece").alias("piece"))


def header_key(header: Column, position: Column) -> Column:
    out = F.concat(F.lit("col_"), position.cast("string"))
    for key, words in reversed(list(HEADERS.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(header).contains(w)
        out = F.when(hit, key).otherwise(out)
    return out


def exact_key(header: Column, position: Column) -> Column:
    """What a header names by HEADER_KEYS, else col_<position>."""
    known = [F.when(F.trim(header) == h, F.lit(k)) for h, k in HEADER_KEYS.items()]
    return F.coalesce(*known, F.concat(F.lit("col_"), position.cast("string")))


def cells_to_rows(cells: DataFrame, keys: Sequence[str], named: Callable[[Column, Column], Column] = exact_key) -> DataFrame:
    """Cells (keys, row, col, text) to one map for each row below the first, by mapped header, else col_<i>; empty cells are left out, and of columns with one name the last counts."""
    head = cells.where("row = 0").select(*keys, "col", named(F.col("text"), F.col("col")).alias("name"))
    body = cells.where("row > 0 AND trim(coalesce(text, '')) <> ''").join(head, [*keys, "col"], "left")
    pair = F.struct(F.coalesce("name", F.concat(F.lit("col_"), F.col("col").cast("string"))).alias("name"), F.trim("text").alias("text"), F.col("col").alias("col"))
    got = body.groupBy(*keys, "row").agg(F.reverse(F.sort_array(F.collect_list(F.struct(F.col("col"), pair.alias("p"))))).alias("d"))
    got = got.withColumn("c", F.transform("d", lambda x: x["p"]))
    last = F.filter("c", lambda x, i: ~F.exists(F.slice(F.col("c"), 1, i), lambda y: y["name"] == x["name"]))
    return got.select(*keys, "row", F.map_from_entries(F.transform(F.reverse(last), lambda x: F.struct(x["name"], x["text"]))).alias("cells"))


def markdown_table(rows: Column) -> Column:
    """Arrays of cells as a Markdown table, the first row as its header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(rows, 1))))
    return F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line)), "\n")


def page_views(chunks: DataFrame, first: int = 6, chars: int = 1200) -> DataFrame:
    """Three views of each chunk (chunk_id, doc_id, page, content): itself, its page's first chunks, its page's distinct terms."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("chunk_id")
    own = chunks.withColumn("n", F.row_number().over(w))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n")
    summary = own.where(F.col("n") <= first).groupBy("doc_id", "page").agg(F.substring(parts, 1, chars).alias("summary"))
    words = own.select("doc_id", "page", F.explode(T.distinct_tokens(F.col("content"))).alias("w")).where(F.length("w") >= 4).groupBy("doc_id", "page").agg(F.substring(F.array_join(F.slice(F.array_sort(F.collect_set("w")), 1, 24), " | "), 1, 900).alias("terms"))
    joined = chunks.join(summary, ["doc_id", "page"], "left").join(words, ["doc_id", "page"], "left")
    view = lambda kind, c: F.struct(F.lit(kind).alias("view_type"), F.coalesce(F.col(c), F.lit("")).alias("text"))
    return joined.select("chunk_id", F.inline(F.array(view("raw", "content"), view("page_summary", "summary"), view("semantic_terms", "terms")))).where("text <> ''")


def fee_rates(texts: DataFrame, key: str, text: str, year: str) -> DataFrame:
    """Fee names with least, greatest and recommended rates in percent, from sentences; per mille are tenths."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"(?<=\p{IsHan})\s+(?=\p{IsHan})", ""), "％", "%")
    num = r"(\d+(?:\.\d+)?)\s*([%‰])"
    pattern = rf"([\p{{IsHan}}]{{2,20}}?)(?:费率|率)?参考范围(?:为|：|:)\s*{num}\s*[～~]\s*{num}[，,、。]?\s*推荐费率(?:为|：|:)?\s*{num}"
    found = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
    own = texts.select(key, F.explode(found).alias("s"))
    g = lambda i: F.regexp_extract("s", pattern, i)
    rate = lambda i: F.round(g(i).cast("double") / F.when(g(i + 1) == "‰", 10.0).otherwise(1.0), 4)
    category = F.lit(OTHER_FEES)
    for word, name in reversed(FEE_CATEGORIES):
        category = F.when(g(1).contains(word), name).otherwise(category)
    return own.select(key, g(1).alias("fee_name"), category.alias("fee_category"), rate(2).alias("rate_min"), rate(4).alias("rate_max"), rate(6).alias("rate_recommended"), F.lit(year).alias("standard_year")).dropDuplicates([key, "fee_name", "rate_min", "rate_max", "rate_recommended"])


def clean_price(text: Column) -> Column:
    v = F.regexp_replace(text, r"[^\d.\-]", "").try_cast("double")
    return F.when(F.abs(v) <= MAX_PRICE, v)


def clean_unit(material: Column, unit: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(unit, F.lit(""))), "㎡", "m²"), r"\?", "")
    return F.when(u.isin("m", "m²") & material.isin(BY_VOLUME), "m³").otherwise(u)


def split_unit_price(text: Column) -> Column:
    """(unit, price, rest) of a cell where unit and price run together."""
    p = r"^\s*([A-Za-z²³\p{IsHan}/]{1,6})?\s*(\d+(?:\.\d+)?)\s*(.*)$"
    return F.struct(F.regexp_extract(text, p, 1).alias("unit"), clean_price(F.regexp_extract(text, p, 2)).alias("price"), F.trim(F.regexp_extract(text, p, 3)).alias("rest"))


def page_price(pages: DataFrame, key: str, text: str, material: str) -> DataFrame:
    """(unit, price) of a material from a page's lines: its line, then a unit's, then a price's."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    at = F.array_position(lines, material)
    own = pages.select(key, lines.alias("l"), at.alias("at")).where("at > 0")
    nxt = own.select(key, F.get("l", F.col("at").cast("int")).alias("unit"), F.get("l", (F.col("at") + 1).cast("int")).alias("price"))
    return nxt.where(F.col("price").rlike(r"^\d+(\.\d+)?$")).select(key, clean_unit(F.lit(material), F.col("unit")).alias("unit"), "price")


def materials_text(text: Column) -> Column:
    """name, unit, price of `name unit price` runs in a text."""
    p = r"([\p{L}][\p{L}\d~×]*)\s+(m³|m²|m|t|kg|km)\s+(\d+\.\d{2})"
    return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, p, 1).alias("name"), F.regexp_extract(s, p, 2).alias("unit"), F.regexp_extract(s, p, 3).cast("double").alias("price")))


def completeness(registry: DataFrame, stores: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """For each registered document its rows in every store, and which stores lack it."""
    out = registry.select(key)
    for name, df in stores.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    counts = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in stores]
    lacks = F.array_join(F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in stores]), lambda x: x.isNotNull()), ",")
    return out.select(key, *counts, lacks.alias("missing"))


def ocr_pages(raw: DataFrame, column: str) -> DataFrame:
    """Blocks of OCR documents (JSON text: doc_id, pages of blocks and tables), in order; a table is one block."""
    schema = "doc_id STRING, pages ARRAY<STRUCT<page_number: INT, text_blocks: ARRAY<STRUCT<text: STRING, confidence: DOUBLE>>, tables: ARRAY<STRUCT<html: STRING, markdown: STRING>>>>"
    doc = raw.select(F.from_json(column, schema).alias("d")).select("d.doc_id", F.explode("d.pages").alias("p"))
    block = lambda kind, text, conf: F.struct(F.lit(kind).alias("type"), text.alias("text"), conf.alias("confidence"))
    none = F.array().cast("array<struct<type:string,text:string,confidence:double>>")
    texts = F.coalesce(F.transform("p.text_blocks", lambda b: block("text", b["text"], b["confidence"])), none)
    tables = F.coalesce(F.transform("p.tables", lambda x: block("table", F.coalesce(x["html"], x["markdown"]), F.lit(None).cast("double"))), none)
    return doc.select("doc_id", F.col("p.page_number").alias("page"), F.posexplode(F.concat(texts, tables)).alias("seq", "b")).select("doc_id", "page", "seq", "b.type", "b.text", "b.confidence").where("trim(coalesce(text, '')) <> ''")


def route_by_size(files: DataFrame, size: str = "length", small: int = 10 << 20, medium: int = 50 << 20) -> DataFrame:
    return files.withColumn("route", F.when(F.col(size) < small, "small").when(F.col(size) < medium, "medium").otherwise("large"))


def pick_ocr_files(files: DataFrame, name: str = "name") -> DataFrame:
    """One file for each document: the merged one, else the main one, else its chunks."""
    from .tables import latest_per_key

    n = F.col(name)
    rank = F.when(n.contains("_merged_"), 0).when(n.contains("_chunk_"), 2).otherwise(1)
    label = F.regexp_replace(F.regexp_replace(n, r"\.json$", ""), r"(_merged)?_ocr$|_chunk_.*$", "")
    own = files.withColumn("label", label).withColumn("rank", rank)
    best = latest_per_key(own.select("label", "rank").distinct(), ["label"], [F.col("rank")])
    return own.join(best, ["label", "rank"], "left_semi")


def merge_ocr_chunks(parts: DataFrame) -> DataFrame:
    """Chunk files (name, page, text) to whole documents, pages in chunk order."""
    base = F.regexp_extract("name", r"^(.*?)_chunk_(\d+)", 1)
    number = F.regexp_extract("name", r"^(.*?)_chunk_(\d+)", 2).cast("int")
    own = parts.select(base.alias("base"), F.struct(number.alias("part"), "page", "text").alias("x"))
    return own.groupBy("base").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("text"))


def ocr_quality(blocks: DataFrame, key: str = "doc_id", low: float = 0.7) -> DataFrame:
    """Text, table and layout quality of OCR blocks (key, type, text, confidence), an overall score and a grade."""
    text = F.when(F.col("type") == "text", F.col("text")).otherwise("")
    garbled = F.length(text) - F.length(F.regexp_replace(text, r"[^\p{IsHan}\p{L}\p{N}\p{P}\p{Sc}\p{Sm}\s°²³]", ""))
    by = blocks.groupBy(key).agg(
        F.avg(F.when(F.col("type") == "text", F.col("confidence"))).alias("confidence"), F.count_if((F.col("type") == "text") & (F.col("confidence") < low)).alias("low_blocks"), F.sum(garbled).alias("bad"), F.sum(F.length(text)).alias("chars"),
        F.count_if(F.col("type") == "table").alias("tables"), F.count_if((F.col("type") == "table") & F.lower("text").contains("<tr") & F.lower("text").rlike("<t[dh]")).alias("sound_tables"), F.count("*").alias("blocks"), F.count_if(F.length(F.trim("text")) > 0).alias("full"),
    )
    ratio = F.coalesce(F.col("bad") / F.when(F.col("chars") > 0, F.col("chars")), F.lit(0.0))
    t_score = F.coalesce("confidence", F.lit(0.0)) * F.when(ratio > 0.1, 0.8).otherwise(1.0)
    layout = F.col("full") / F.col("blocks")
    total = F.when(F.col("tables") == 0, 0.7 * t_score + 0.3 * layout).otherwise(0.4 * t_score + 0.4 * F.col("sound_tables") / F.col("tables") + 0.2 * layout)
    grade = F.when(total >= 0.95, "excellent").when(total >= 0.85, "good").when(total >= 0.70, "fair").otherwise("poor")
    return by.select(key, F.round("confidence", 4).alias("confidence"), "low_blocks", F.round(ratio, 4).alias("garbled_ratio"), "tables", F.round(total, 4).alias("score"), grade.alias("grade"))


def overlapping_boxes(boxes: DataFrame, keys: Sequence[str], eps: float = 1.0) -> DataFrame:
    """Pairs of boxes (id, x, y, w, h) of one key that overlap, with some slack."""
    a = boxes.select(*keys, *[F.col(c).alias(f"{c}1") for c in ("id", "x", "y", "w", "h")])
    b = boxes.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("id", "x", "y", "w", "h")])
    hit = (F.col("x1") <= F.col("x2") + F.col("w2") + eps) & (F.col("x2") <= F.col("x1") + F.col("w1") + eps) & (F.col("y1") <= F.col("y2") + F.col("h2") + eps) & (F.col("y2") <= F.col("y1") + F.col("h1") + eps)
    return a.join(b, list(keys)).where((F.col("id1") < F.col("id2")) & hit).select(*keys, "id1", "id2")


def encode_missing(rows: DataFrame, text: str, vector: str, encode, batch: int = 64) -> DataFrame:
    """Rows with vectors filled in where there was none; the encoder gets lists of texts."""
    todo = rows.where(F.col(vector).isNull())

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [v for i in range(0, len(pdf), batch) for v in encode(pdf[text].fillna("").tolist()[i : i + batch])]
            yield pdf.assign(**{vector: [list(map(float, v)) for v in out]})

    return rows.where(F.col(vector).isNotNull()).unionByName(todo.mapInPandas(each, rows.schema))


def payload(**fields: Column) -> Column:
    """A JSON object of the fields."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def calculation_steps(query: str) -> dict[str, float]:
    """Amounts named in a question, such as labour 100 and machines 20.5."""
    import re

    names = {"labour": "人工费|labou?r", "material": "材料费|material", "machine": "机械费|machine"}
    return {n: float(m[1]) for n, p in names.items() if (m := re.search(rf"(?i)(?:{p})[^\d]{{0,6}}(\d+(?:\.\d+)?)", query))}


def to_json_rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def price_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price records from cells (keys, row, col, text): names, cleaned units and prices; a cell with unit and price together is
    split; rows without a name or a price, and labels that are no names, are left out."""
    own = cells_to_rows(cells, keys, header_key)
    c = lambda k: F.col("cells")[k]
    both = split_unit_price(F.coalesce(c("unit"), F.lit("")))
    price = F.coalesce(clean_price(F.coalesce(c("price_taxed"), c("price"))), both["price"])
    unit = F.when(both["price"].isNotNull(), both["unit"]).otherwise(c("unit"))
    rows = own.select(*keys, "row", F.trim(c("name")).alias("material"), F.coalesce(c("spec"), F.lit("")).alias("spec"), clean_unit(F.trim(c("name")), unit).alias("unit"), price.alias("price"))
    return rows.where(F.col("price").isNotNull() & (F.col("price") > 0) & (F.length("material") > 0) & ~F.col("material").rlike(r"^[\d.\s]+$|^[^\p{L}]+$"))


def recovered_prices(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Prices of wanted (doc_id, page, material) found on other pages (doc_id, page, text) of the same document: on the nearest one."""
    from .tables import latest_per_key

    found = pages.select("doc_id", F.col("page").alias("other"), F.explode(materials_text(F.col("text"))).alias("m")).select("doc_id", "other", F.col("m.name").alias("material"), "m.unit", "m.price")
    own = wanted.join(found, ["doc_id", "material"]).where("other <> page").withColumn("far", F.abs(F.col("other") - F.col("page")))
    return latest_per_key(own, ["doc_id", "page", "material"], [F.col("far"), F.col("other")]).select("doc_id", "page", "material", "unit", "price", "other")
