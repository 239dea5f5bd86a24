"""Fill-in-the-middle by escaped marker injection, in string functions only.

A text's units are words with the blanks before them, and what blanks are left at its end. Two signs
that a text hardly holds are made free of use by escaping: STOP becomes ESC d, ESC becomes ESC e.
Neither sign is blank, so escaping moves no unit's bounds. regexp_replace then appends STOP to
every unit, counting STOPs counts units, and substring_index cuts out the units from one rank to
another. What is cut out loses its STOPs, is unescaped, and is put together in the order of its form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STOP, ESC = "\x01", "\x02"


def _sound(markers: tuple[str, str, str]) -> None:
    """Markers begin with one sign that none of them holds again, and none begins another: so none can arise where a part and a marker meet."""
    if len({m[:1] for m in markers}) > 1 or any(not m or m[0] in m[1:] for m in markers) or any(a != b and a.startswith(b) for a in markers for b in markers) or len(set(markers)) < 3:
        raise ValueError("three different markers that begin with one sign, and hold it nowhere else, are needed")


def _replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def escape(s: Column) -> Column:
    return _replace(_replace(s, ESC, ESC + "e"), STOP, ESC + "d")


def unescape(s: Column) -> Column:
    """The inverse of escape; STOPs that stand between units are dropped first."""
    return _replace(_replace(_replace(s, STOP, ""), ESC + "d", STOP), ESC + "e", ESC)


def _between(marked: Column, n: Column, first: Column, end: Column) -> Column:
    """Units from rank first to rank end, exclusive, of a text with a STOP after each of its n units."""
    head = F.when(end >= n, marked).otherwise(F.concat(F.call_function("substring_index", marked, F.lit(STOP), end), F.lit(STOP)))
    # what the last STOP ends is an empty part, so ranks from the right begin at two
    return F.when(first <= 0, head).otherwise(F.call_function("substring_index", head, F.lit(STOP), first - end - 1))


def _group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, percent: int = 50, suffix_first: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs with a column fim: a struct of n (units), form, output, prefix_chars and middle_chars.

    percent of the texts are cut at two places that a hash of seed and id draws; of these suffix_first percent
    have the suffix before the prefix ('spm'), the others the prefix first ('psm'). An empty or null text, and one
    that holds a marker, stays as it is ('plain', numbers of signs null). A null id draws as an empty one; repeated rows draw alike. All columns of docs
    are kept, whatever their names; a column fim of theirs is replaced. An empty table gives an empty one.
    """
    _sound(markers)
    p, s, m = (F.lit(x) for x in markers)
    kept = [c for c in docs.columns if c != "fim"]
    df = docs.select(F.struct(*[named(c) for c in kept]).alias("row"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"))
    df = df.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256))
    df = df.withColumn("marked", F.regexp_replace(escape(F.col("text")), f"({UNIT})", "$1" + STOP))
    df = df.withColumn("n", F.length("marked").cast("long") - F.length(_replace(F.col("marked"), STOP, "")))
    h1, h2, h3, h4 = (_group(F.col("digest"), i) for i in range(4))
    units = F.col("n") + 1
    df = df.withColumn("a", F.least(h1 % units, h2 % units).cast("int")).withColumn("b", F.greatest(h1 % units, h2 % units).cast("int"))
    holds = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    plain = (F.col("text") == "") | holds | (h3 % 100 >= percent)
    df = df.withColumn("form", F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm"))
    cut = lambda first, end: unescape(_between(F.col("marked"), F.col("n").cast("int"), first, end))
    whole = F.col("form") == "plain"
    parts = F.when(~whole, F.struct(cut(F.lit(0), F.col("a")).alias("p"), cut(F.col("a"), F.col("b")).alias("m"), cut(F.col("b"), F.col("n").cast("int")).alias("s")))
    df = df.withColumn("parts", parts)
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", F.concat(p, "parts.p", s, "parts.s", m, "parts.m")).otherwise(F.concat(s, "parts.s", p, "parts.p", m, "parts.m"))
    fim = F.struct("n", "form", output.alias("output"), F.length("parts.p").cast("long").alias("prefix_chars"), F.length("parts.m").cast("long").alias("middle_chars"))
    return df.select("row", fim.alias("fim")).select("row.*", "fim")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that output and form were made of, by the first place of each marker."""
    _sound(markers)
    p, s, m = markers
    upto = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substr(x, F.length(upto(x, mark)) + len(mark) + 1)
    psm = F.concat(upto(after(output, p), s), after(output, m), upto(after(output, s), m))
    spm = F.concat(upto(after(output, p), m), after(output, m), upto(after(output, s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of a transformed table."""
    df = made.select(named(id_col).alias("doc_id"), "fim.*")
    df = df.withColumn("restored", restore(F.col("output"), F.col("form")))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
    WITH units AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS d
        FROM documents
    ), drawn AS (
        SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM units
    ), formed AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), cuts AS (
        SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM cuts
"""
