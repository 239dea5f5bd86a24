"""Text expressions: tokens, terms, entities, periods, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits of any script but Han, or single Han characters.
TOKEN = r"[\u4e00-\u9fa5]|[a-zA-Z0-9_\u00c0-\u024f]+"
#: What lies between the words that trigrams are taken of.
NO_WORD = "[^a-z0-9\\u00c0-\\u024f\\u4e00-\\u9fa5]+"
#: Characters between Chinese terms, words that are no terms, and the dictionary of materials.
PARTICLES = "的中和或与是以为及对到从在由把被让所对于关于以及通过根据按照另外另一这一那些这些任何什么怎么哪些哪个如何为何多少"
STOP_TERMS = [
    "我们", "他们", "可以", "进行", "包括", "如下", "以及", "等等", "不过",
    "因此", "所以", "如果", "虽然", "但是", "同时", "或者", "并且", "其中",
    "应当", "需要", "不能", "可能", "不得", "应该", "要求", "通过", "采用",
    "本节", "本章", "本规", "本标", "本条", "说明", "本表", "本款",
    "什么", "怎么", "哪些", "哪个", "如何", "为何", "多少",
]
MATERIALS = [
    "中砂", "粗砂", "细砂", "水泥", "钢筋", "混凝土", "砂浆", "电缆", "电线",
    "脚手架", "模板", "门窗", "管道", "保温", "防水", "瓷砖", "腻子", "涂料",
]


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap_share(a: Column, b: Column) -> Column:
    """Part of a's elements that b has too; 0 for an empty a."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def escape_like(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(col: Column, literal: str) -> Column:
    """Literal substring regardless of case."""
    return F.lower(col).contains(literal.lower())


def terms(text: Column) -> Column:
    """Chinese terms: runs of 2 to 8 characters from a Han one on, between particles and marks, without stop words, each once, in order."""
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?U)[{PARTICLES}\s\W]+")
    runs = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(r"(?U)[\u4e00-\u9fff][\u4e00-\u9fff\w]{1,7}"), F.lit(0))))
    return F.array_distinct(F.filter(runs, lambda r: ~r.isin(STOP_TERMS)))


def ilike_any(col: Column, patterns: list[str]) -> Column:
    """Whether the text is like one of the patterns, regardless of case."""
    out = F.lit(False)
    for p in patterns:
        out = out | col.ilike(p)
    return out


def json_has(col: Column, key: str) -> Column:
    """Whether a JSON object has the key; false for what is no object."""
    return F.coalesce(F.array_contains(F.json_object_keys(col), key), F.lit(False))


def json_without(col: Column, key: str) -> Column:
    """A JSON object without the key, its other values as they were; null for what is no object."""
    return F.to_json(F.map_filter(F.from_json(col, "map<string,variant>"), lambda k, _: k != key))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    return F.array_distinct(ordered_trigrams(text))


def ordered_trigrams(text: Column) -> Column:
    """Trigrams of lower-case words in order, repeats included, each word with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.flatten(grams)


def period(text: Column) -> Column:
    """YYYY-MM, or YYYY, from 2025-12, 2025/12, 202512, 2025年12月, 2025; null otherwise."""
    t = F.trim(text)
    year = F.regexp_extract(t, r"^((?:19|20)\d{2})(?:[-/年]?(\d{1,2})月?)?年?$", 1)
    month = F.regexp_extract(t, r"^((?:19|20)\d{2})(?:[-/年]?(\d{1,2})月?)?年?$", 2)
    good = month.try_cast("int").between(1, 12)
    return F.when(year == "", None).when(month == "", year).when(good, F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def section_ids(text: Column) -> Column:
    """Section numbers such as 1.1 or 3.2.1."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\d.])\d+(?:\.\d+){1,3}(?![\d.])"), F.lit(0))


def entities(text: Column, materials: list[str] = MATERIALS, cap: int = 20) -> Column:
    """Dictionary materials, year-months and sections in a text, as kind:value, at most cap."""
    own = F.filter(F.array(*[F.lit(m) for m in materials]), lambda m: text.contains(m)) if materials else F.array().cast("array<string>")
    month = r"(20\d{2})[-年./]?\s*(\d{1,2})\s*月?"
    padded = lambda x: F.lpad(F.regexp_extract(x, month, 2), 2, "0")
    periods = F.transform(F.regexp_extract_all(text, F.lit(month), F.lit(0)), lambda x: F.concat(F.regexp_extract(x, month, 1), F.lit("-"), padded(x)))
    tag = lambda kind, xs: F.transform(F.array_distinct(xs), lambda x: F.concat(F.lit(kind + ":"), x))
    return F.slice(F.concat(tag("Material", own), tag("Period", periods), tag("Section", section_ids(text))), 1, cap)


def normalised(text: Column) -> Column:
    """Lower case, marks to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def question_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the normalised question."""
    return F.substring(F.sha2(normalised(text), 256), 1, 16)


#: LaTeX commands and what stands for them.
SYMBOLS = {"times": "×", "div": "÷", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "%": "%", ",": " ", " ": " "}


def math_clean(text: Column) -> Column:
    """LaTeX as plain text: symbols, bold, fractions as a/b, block formulas as indented lines, other commands taken out."""
    for command, symbol in SYMBOLS.items():
        text = F.regexp_replace(text, r"\\" + command, symbol)
    for pattern, to in ((r"\\text\{([^}]*)\}", "$1"), (r"\\(?:mathbf|textbf)\{([^}]*)\}", "**$1**"), (r"\\frac\{([^}]*)\}\{([^}]*)\}", "$1/$2")):
        text = F.regexp_replace(text, pattern, to)
    mark = "\ue000"
    parts = F.split(F.regexp_replace(text, r"(?s)\\\[\s*(.*?)\s*\\\]", f"{mark}$1{mark}"), mark)
    lines = lambda x: F.filter(F.transform(F.split(x, r"\\\\"), lambda y: F.trim(y)), lambda y: y != "")
    block = lambda x: F.concat(F.lit("\n"), F.array_join(F.transform(lines(x), lambda y: F.concat(F.lit("  "), y)), "\n"), F.lit("\n"))
    text = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, block(x)).otherwise(x)), "")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\\(\s*(.*?)\s*\\\)", "$1"), r"\\[a-zA-Z]+\b", "")


def html_rows(html: Column) -> Column:
    """Rows of a table's cells, from HTML."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))))


def markdown_rows(text: Column) -> Column:
    """Rows of a Markdown table's cells, without its ruler."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|?$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of a text; the last one ends with it."""
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < F.length(text)))
    return F.transform(starts, lambda s: F.struct((s + 1).alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))
