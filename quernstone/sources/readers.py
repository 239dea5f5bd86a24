"""Readers of documents and tables, by format."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import csv_blocks, ocr_pages, paragraphs

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_BLOCKS = "doc_id string, page int, seq int, type string, text string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its name; names that aren't known are an error."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _file() -> F.Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def text(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of text or Markdown files as blocks."""
    own = spark.read.text(path, wholetext=True).select(_file().alias("doc_id"), F.col("value").alias("text"))
    return paragraphs(own).select("doc_id", F.lit(1).alias("page"), "seq", F.lit("text").alias("type"), "text")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files as blocks; rows may have more cells than the header."""
    lines = spark.read.text(path, wholetext=True).select(_file().alias("doc_id"), F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("line", "raw")).where("raw <> ''")
    cell = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'
    cells = F.transform(F.regexp_extract_all("raw", F.lit(cell), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    cells = F.when(F.col("raw").endswith(","), cells).otherwise(F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(1))))
    own = csv_blocks(lines.withColumn("cells", cells), "doc_id", "cells", "line")
    return own.select("doc_id", F.lit(1).alias("page"), F.col("n").alias("seq"), "type", "text")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheets(content: bytes) -> Iterator[list[list[str]]]:
    """Rows of cells of each sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            out = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.findall("m:c", _NS)):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else i
                    v = c.find("m:v", _NS)
                    inline = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" and v is not None else (v.text or "") if v is not None else inline
                out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            yield out


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of workbooks as blocks, the sheet's number as page."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                for page, rows in enumerate(sheets(bytes(content)), 1):
                    head = rows[0] if rows else []
                    for seq, row in enumerate(rows):
                        named = [f"{head[i] if i < len(head) else f'col{i}'}: {c.strip()}" for i, c in enumerate(row) if c.strip()]
                        body = " | ".join(head) if seq == 0 else " | ".join(named)
                        if body:
                            out.append((p.rsplit("/", 1)[-1], page, seq, "caption" if seq == 0 else "table_row", body))
            yield pd.DataFrame(out, columns=["doc_id", "page", "seq", "type", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, _BLOCKS)


def pdf_pages(content: bytes) -> list[str]:
    """Text that a PDF's content streams show, in the order of the streams; nothing for scans or encoded fonts."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        raw = m[1]
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" not in raw:
            continue
        lines = []
        for block in re.findall(rb"BT(.*?)ET", raw, re.S):
            shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", block)
            parts = [a or b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", b)) for a, b in shown]
            lines.append(b" ".join(re.sub(rb"\\([()\\])", rb"\1", p) for p in parts).decode("latin-1"))
        out.append("\n".join(x for x in lines if x.strip()))
    return out


def pdf(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Pages of PDFs as blocks; those with hardly any text are blindspots, for OCR."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in parts:
            out = [(p.rsplit("/", 1)[-1], n, 0, "text" if len(t.strip()) >= least else "blindspot", t) for p, c in zip(pdf_["path"], pdf_["content"]) for n, t in enumerate(pdf_pages(bytes(c)), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "page", "seq", "type", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, _BLOCKS)


def ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of OCR results."""
    return ocr_pages(spark.read.text(path, wholetext=True), "value").select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), "page", "seq", "type", "text")


READERS = {".txt": text, ".md": text, ".csv": csv, ".xlsx": xlsx, ".xlsm": xlsx, ".pdf": pdf, ".json": ocr_json}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a file, by its ending."""
    ending = re.search(r"\.[A-Za-z0-9]+$", path)
    reader = READERS.get(ending[0].lower()) if ending else None
    if reader is None:
        raise ValueError(f"no reader for {path}")
    return reader(spark, path)
