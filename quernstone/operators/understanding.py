"""What a question asks for: intent, kind, entities, parts, stores."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that point to an intent, the first intent that matches counts; a choice of its own, not a fixed list.
INTENTS = {
    "trend": ["trend", "change", "趋势", "走势", "变化"],
    "compare": ["compare", "versus", "difference", "比较", "对比", "区别"],
    "price": ["price", "cost", "how much", "价格", "单价", "多少钱", "造价"],
    "rule": ["rule", "clause", "standard", "rate", "费率", "规定", "条款", "标准"],
    "definition": ["what is", "define", "meaning", "什么是", "定义", "含义"],
}
STORES = {"trend": "series", "compare": "series", "price": "series", "rule": "text", "definition": "graph", "general": "hybrid"}
_SPLIT = r"\s*(?:[?？;；]|\band\b|以及|并且|另外)\s*"


def intent(query: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(list(INTENTS.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(query).contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def store(query_intent: Column) -> Column:
    return F.coalesce(*[F.when(query_intent == k, F.lit(v)) for k, v in STORES.items()])


def kind(query: Column) -> Column:
    """ENTITY, KEYWORD, SEMANTIC or HYBRID, by length and what is in it."""
    n = F.size(T.tokens(query))
    return F.when(query.rlike(r"(?i)\b(company|institute|ltd|gmbh)\b|公司|研究院"), "ENTITY").when(n <= 3, "KEYWORD").when(n > 12, "SEMANTIC").otherwise("HYBRID")


def parts(query: Column) -> Column:
    """Sub-questions of at least 3 characters, each once."""
    return F.array_distinct(F.filter(F.split(F.trim(query), _SPLIT), lambda p: F.length(p) >= 3))


def fan_out(queries: DataFrame, search: Callable[[DataFrame], DataFrame], most: int = 20) -> DataFrame:
    """Results of a search over every part of each query, each chunk once with its best score, the best ones first."""
    from pyspark.sql import Window

    own = queries.select(F.col("query_id").alias("whole"), F.posexplode(parts(F.col("query"))).alias("n", "query")).withColumn("query_id", F.struct("whole", "n"))
    got = search(own.select("query_id", "query")).groupBy(F.col("query_id.whole").alias("whole"), "chunk").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("whole").orderBy(F.desc("score"), "chunk"))
    return got.withColumn("rank", rank).where(F.col("rank") <= most).withColumnRenamed("whole", "query_id")


def refusal(answer: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(answer, m))


def listed(texts: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches."""
    return F.filter(F.array(*[F.when(texts.rlike(p), n) for n, p in patterns.items()]), lambda x: x.isNotNull())


_SAFE = re.compile(r"[\d\s.+\-*/%()a-z_,]+")
_CALLS = {"abs", "round", "sqrt", "pow", "least", "greatest", "ln", "exp", "floor", "ceil"}


def calculator(expression: str) -> Column:
    """An arithmetic expression over numbers and a few functions, as a column; anything else is an error."""
    text = expression.lower().replace("^", "**")
    if "**" in text or not _SAFE.fullmatch(text) or any(n not in _CALLS for n in re.findall(r"[a-z_]+", text)):
        raise ValueError(f"not an arithmetic expression: {expression}")
    return F.expr(re.sub(r"(?<![\w.])(\d+\.?\d*)(?![\w.])", r"CAST(\1 AS DOUBLE)", text))


class Tools:
    """Named operators with descriptions; invoked by name and arguments."""

    def __init__(self):
        self._tools: dict[str, Callable] = {}

    def add(self, f: Callable) -> Callable:
        self._tools[f.__name__] = f
        return f

    def list(self) -> list[dict]:
        import inspect

        return [{"name": n, "description": (f.__doc__ or "").split("\n")[0], "parameters": list(inspect.signature(f).parameters)} for n, f in sorted(self._tools.items())]

    def invoke(self, name: str, **args):
        if name not in self._tools:
            raise ValueError(f"no such tool: {name}")
        return self._tools[name](**args)
