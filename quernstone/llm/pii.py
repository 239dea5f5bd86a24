"""Personal data: base formats, and more spans that boosted trees pick from generous candidates.

Everything on the main path is column expressions. A pattern's matches are set off by a mark,
the text is split at the marks, and the pieces' lengths give offsets in code points. What the base
formats find always stands. High-recall generators then propose spans, which may overlap, in the
text that is left; boosted trees score their format and context, and each kind's calibrated
threshold picks those that are added. The trees learn from a seeded set of invented examples whose
features come from the same expressions.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Private-use characters: a mark, what stands for a mark in the text, what covers found spans.
_MARK, _OTHER, _COVER = "", "", ""
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base formats as possessive patterns, which match the same spans but never go back over a long run.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}| at |@) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}| dot ) ?[A-Za-z]{{2,24}}(?![A-Za-z])){{1,4}}",
    "ip": r"(?<![0-9A-Za-z:.\[])(?:[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ ./-][0-9]{4}){3}|[0-9]{4}[ ./-][0-9]{6}[ ./-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]?[0-9]{2,4}){2,4}(?![0-9])",
}
_CONTEXT = {
    "phone": "(?i)tel|phone|call|fon|tél|mobil|llam|appel|ruf",
    "card": "(?i)card|visa|karte|tarjeta|carte|pay|zahl|pag",
    "email": "(?i)mail|contact|kontakt|correo|courriel|write|schreib",
    "ip": "(?i)\\bip\\b|host|server|address|login|adresse",
    "other": "(?i)order|invoice|isbn|version|serial|bestell|factur|ref|page|seite|año|année|jahr|id\\b",
}
TREES, DEPTH, RATE, PRECISION, SEED = 40, 3, 0.3, 0.995, 11


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often a lambda in the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _pieces(text: Column, pattern: str) -> Column:
    """Text and matches in turn; matches have odd positions from zero."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def _before(values: Column, op: Callable[[Column, Column], Column], chunk: int = 64) -> Column:
    """For each value op over zero and all values before it, in chunks so that no long array grows by one."""
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def running(values: Column, first: Column) -> Column:
        step = lambda a, x: F.struct(op(a["t"], x).alias("t"), F.array_append(a["s"], a["t"]).alias("s"))
        return F.aggregate(values, F.struct(first.alias("t"), none.alias("s")), step)["s"]

    cuts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))
    parts = lambda v: F.transform(cuts(v), lambda c: F.slice(v, c * chunk + 1, chunk))
    totals = lambda parts: F.transform(parts, lambda p: F.aggregate(p, zero, op))
    return _let(_let(values, parts), lambda parts: F.flatten(F.zip_with(parts, running(totals(parts), zero), running)))


def _starts(pieces: Column) -> Column:
    """Offsets of all pieces."""
    return _before(F.transform(pieces, lambda x: F.length(x).cast("bigint")), lambda a, x: a + x)


Test = Callable[[Column, Column, Column], Column]


def _good(pieces: Column, test: Test) -> Column:
    """Positions of the matches that pass the test of (match, text before, text after)."""
    odd = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.filter(odd, lambda i: test(pieces[i], pieces[i - 1], pieces[i + 1]))


def _spans(pieces: Column, good: Column, kind: int) -> Column:
    def listed(at: Column) -> Column:
        return F.transform(good, lambda i: F.struct(at[i].alias("start"), F.lit(kind).alias("kind"), (at[i] + F.length(pieces[i])).alias("end")))

    return F.when(F.size(good) > 0, _let(_starts(pieces), listed)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def _rebuilt(pieces: Column, good: Column, test: Test, text: Column, put: Callable[[Column], Column]) -> Column:
    """The text with the good matches replaced."""
    one = lambda x, i: F.when((i % 2 == 1) & F.coalesce(test(x, F.get(pieces, i - 1), F.get(pieces, i + 1)), F.lit(False)), put(x)).otherwise(x)
    return F.when(F.size(good) == 0, text).otherwise(F.array_join(F.transform(pieces, one), ""))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _small_parts(s: Column) -> Column:
    """True if all numbers in it are at most 255, leading zeros or not."""
    trim = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(s, r"[^0-9]+"), lambda x: _let(trim(x), lambda t: (F.length(t) < 3) | ((F.length(t) == 3) & (t <= "255"))))


def base_test(kind: str) -> Test:
    if kind == "ip":
        return lambda s, *_: _small_parts(s)
    if kind == "card":
        return lambda s, *_: _let(_digits(s), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return lambda s, *_: F.length(_digits(s)).between(9, 15)
    return lambda s, *_: F.lit(True)


def features(s: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    near, nxt = F.substring(before, -40, 40), F.substring(after, 1, 12)
    yes = lambda c: c.cast("int")
    hits = lambda x, p: F.length(x) - F.length(F.regexp_replace(x, p, ""))
    return [
        F.length(s),
        hits(s, "[0-9]"),
        hits(s, "[A-Za-z]"),
        yes(F.call_function("luhn_check", F.when(F.length(_digits(s)) > 0, _digits(s)).otherwise("1"))),
        hits(s, "[ ./-]"),
        yes(s.contains("(")),
        yes(s.rlike(r"[\[({]at|[\[({]dot|\[\.\]")),
        yes(_small_parts(s)),
        F.size(F.split(s, r"[^0-9]+")),
        hits(s, ":"),
        yes(near.rlike(_CONTEXT["phone"])),
        yes(near.rlike(_CONTEXT["card"])),
        yes(near.rlike(_CONTEXT["email"])),
        yes(near.rlike(_CONTEXT["ip"])),
        yes(near.rlike(_CONTEXT["other"])),
        yes(near.rlike(r"[\p{L}0-9]$")),
        yes(nxt.rlike(r"^[\p{L}0-9]")),
        F.coalesce(F.substring(_digits(s), 1, 1).try_cast("int"), F.lit(-1)),
        hits(near, "[0-9]"),
        F.size(F.array_distinct(F.split(_digits(s), ""))),
        yes(s.rlike(r" at | dot ")),
    ]


def _invented(seed: int = SEED, n: int = 60) -> list[tuple[str, str, int]]:
    """(kind, text, 1 if the marked candidate is personal data); each text has one candidate."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8)))
    tld = lambda: rng.choice(["com", "org", "net", "de", "fr", "es"])
    filler = lambda: " ".join(name() for _ in range(rng.randint(2, 6)))

    def luhn(k: int, right: bool) -> str:
        x = rng.choice("3456") + d(k - 2)
        total = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(x))))
        return x + str((-total + (0 if right else rng.randint(1, 9))) % 10)

    octets = lambda top: [str(rng.randint(1, top)) for _ in range(4)]
    fours = lambda x: rng.choice(" ./").join(x[i : i + 4] for i in range(0, 16, 4))
    cues = {"phone": ["call", "Tel.", "phone:", "téléphone", "mobil"], "card": ["card", "visa", "Karte", "tarjeta"], "email": ["mail", "contact:", "correo"], "ip": ["IP", "host", "server"], "other": ["order", "invoice", "ISBN", "version", "ref", "serial"]}
    out = []
    for _ in range(n):
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), ("(at)", ".")])
        good = {
            "email": [f"{name()}.{name()}{at}{name()}{dot}{tld()}", f"{name()}{d(2)}{at}{name()}{dot}{tld()}"],
            "ip": ["[.]".join(octets(255)), ":".join(f"{rng.randint(256, 65535):x}" for _ in range(8))],
            "card": [luhn(16, True), fours(luhn(16, True)), luhn(15, True)],
            "phone": [f"({d(3)}) {d(3)}-{d(4)}", f"{rng.choice('23456789')}{d(2)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}"],
        }
        bad = {
            "email": [f"{name()} at {name()}. {name()[:3].title()}", f"{name()} at {name()}.{name()}"],
            "ip": ["[.]".join(str(rng.randint(256, 999)) for _ in range(4)), ".".join(octets(999))],
            "card": [luhn(16, False), d(13), fours(luhn(16, False)), d(19)],
            "phone": [f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", d(9), d(11), d(13), luhn(16, True), d(16), fours(d(16)), f"19{d(2)}-20{d(2)} {d(2)}"],
        }
        for kind in KINDS:
            for y, forms in ((1, good[kind]), (0, bad[kind])):
                for form in forms:
                    cue = rng.choice(cues[kind]) if rng.random() < (0.6 if y else 0.1) else rng.choice(cues["other"]) if rng.random() < (0.02 if y else 0.5) else ""
                    out.append((kind, f"{filler()} {cue} {form}{rng.choice([' ', ', ', '. '])}{filler()}", y))
    return out


class Trees:
    """Boosted trees that ask the same question throughout a level, and a threshold for each kind."""

    def __init__(self, x: np.ndarray, kind: np.ndarray, y: np.ndarray):
        x = np.column_stack([x, kind])
        held = np.arange(len(y)) % 3 == 0
        fx, fy = x[~held], y[~held]
        score, all_score = np.zeros(len(fy)), np.zeros(len(y))
        self.trees: list[tuple[list[tuple[int, float]], list[float]]] = []
        splits = [(j, float(c)) for j in range(x.shape[1]) for c in np.unique(np.quantile(fx[:, j], np.linspace(0, 1, 12)[1:-1]) - 0.5)]
        above = np.stack([fx[:, j] > c for j, c in splits])
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = fy - p, p * (1 - p)
            leaf, asked = np.zeros(len(fy), int), []
            for _ in range(DEPTH):
                gains = []
                for a in above:
                    at = leaf * 2 + a
                    gains.append((np.bincount(at, g) ** 2 / (np.bincount(at, h) + 1.0)).sum())
                best = int(np.argmax(gains))
                asked.append(splits[best])
                leaf = leaf * 2 + above[best]
            size = 1 << DEPTH
            values = (RATE * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1.0)).tolist()
            self.trees.append((asked, values))
            score += np.array(values)[leaf]
            at = np.zeros(len(y), int)
            for j, c in asked:
                at = at * 2 + (x[:, j] > c)
            all_score += np.array(values)[at]
        self.limits = []
        for k in range(len(KINDS)):
            s, t = all_score[held & (kind == k)], y[held & (kind == k)]
            fine = [c for c in np.unique(s) if t[s >= c].mean() >= PRECISION]
            self.limits.append(float(min(fine)) if fine else float("inf"))

    def test(self, kind: str) -> Test:
        k = KINDS.index(kind)
        rows = ", ".join(f"struct(array({', '.join(str(j) for j, _ in asked)}) AS j, array({', '.join(f'{c!r}D' for _, c in asked)}) AS c, array({', '.join(f'{v!r}D' for v in values)}) AS v)" for asked, values in self.trees)
        trees = F.expr(f"array({rows})")

        def score(f: Column) -> Column:
            leaf = lambda t: reduce(lambda a, i: a * 2 + (f[t["j"][i]] > t["c"][i]).cast("int"), range(DEPTH), F.lit(0))
            return F.aggregate(trees, F.lit(0.0), lambda a, t: a + t["v"][leaf(t)])

        def picked(s: Column, before: Column, after: Column) -> Column:
            own = [*features(s, before, after), F.lit(k)]
            return _let(F.array(*[x.cast("double") for x in own]), lambda f: score(f) >= self.limits[k])

        return picked


def train(spark: SparkSession) -> Trees:
    """Trees over the invented examples; the numbers come from the expressions that score documents."""
    rows = spark.createDataFrame(_invented(), "kind string, text string, y int")
    x = None
    for kind, pattern in GENERATORS.items():
        own = rows.where(F.col("kind") == kind).select("kind", "text", "y", _pieces(F.col("text"), pattern).alias("p")).where(F.size("p") > 1)
        got = own.select("kind", "text", "y", F.array(*[f.cast("double") for f in features(F.col("p")[1], F.col("p")[0], F.col("p")[2])]).alias("f"))
        x = got if x is None else x.unionByName(got)
    got = sorted((r.text, r.kind, r.y, tuple(r.f)) for r in x.collect())
    return Trees(np.array([r[3] for r in got]), np.array([KINDS.index(r[1]) for r in got]), np.array([float(r[2]) for r in got]))


def _own_names(docs: DataFrame) -> Callable[[str], str]:
    """Names for columns in between that no column of docs has."""
    start = "__"
    while any(c.lower().startswith(start) for c in docs.columns):
        start += "_"
    return lambda name: start + name


def _found(docs: DataFrame, trees: Trees, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: base spans and all spans.

    Base formats are looked for in the original text; the generators read what the base formats left.
    """
    own = _own_names(docs)
    o, t, p = own("o"), own("t"), own("p")
    cover = lambda x: F.repeat(F.lit(_COVER), F.length(x))
    df = docs.withColumn(o, F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, _OTHER))
    df = df.withColumn(t, F.col(o))
    for kind in KINDS:
        df = df.withColumn(p, _pieces(F.col(t), BASE[kind]))
        df = df.withColumn(t, _let(F.col(p), lambda x, k=kind: _let(_good(x, base_test(k)), lambda g: _rebuilt(x, g, base_test(k), F.array_join(x, ""), cover))))
    for kind in KINDS:
        df = df.withColumn(p, _pieces(F.col(t), GENERATORS[kind]))
        df = df.withColumn(own(f"add_{kind}"), _let(F.col(p), lambda x, k=kind: _let(_good(x, trees.test(k)), lambda g: _spans(x, g, KINDS.index(k)))))
    for n, kind in enumerate(KINDS):
        df = df.withColumn(own(f"base_{kind}"), _let(_pieces(F.col(o), BASE[kind]), lambda x, k=kind, n=n: _let(_good(x, base_test(k)), lambda g: _spans(x, g, n))))
    base, added = [F.col(own(f"base_{k}")) for k in KINDS], [F.col(own(f"add_{k}")) for k in KINDS]
    df = df.withColumn(own("base"), F.array_sort(F.concat(*base))).withColumn(own("spans"), F.array_sort(F.array_distinct(F.concat(*base, *added))))
    return df.drop(o, t, p, *[own(f"{a}_{k}") for a in ("base", "add") for k in KINDS]), own("base"), own("spans")


def find(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with columns base and spans: arrays of (start, kind number, end), in order, in code points, end exclusive.

    A null or empty text has none. Rows are neither dropped nor joined, whatever they hold; columns of docs
    named base or spans are replaced, all others stay, whatever their names.
    """
    df, base, spans = _found(docs, trees, text_col)
    return df.withColumn("base", F.col(base)).withColumn("spans", F.col(spans)).drop(base, spans)


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones united, which have the kind of the longest of them."""

    def united(before: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: spans[i]["start"] >= before[i])

        def one(at: Column, g: Column) -> Column:
            own = F.slice(spans, at[g] + 1, F.coalesce(F.get(at, g + 1), F.size(spans)) - at[g])
            longest = F.array_max(F.transform(own, lambda s: F.struct((s["end"] - s["start"]).alias("n"), (-s["kind"]).alias("k"))))
            return F.struct(spans[at[g]]["start"].alias("start"), (-longest["k"]).alias("kind"), F.array_max(own["end"]).alias("end"))

        return _let(new, lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda g: one(at, g)))

    return _let(_before(spans["end"], lambda a, x: F.greatest(a, x)), united)


def _masked(text: Column, spans: Column, chunk: int = 64) -> Column:
    """The text with disjoint spans replaced by their kinds; cut in chunks first, so that few cuts count from the text's begin."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    part = lambda t, start, end: F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))
    end_of = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0).cast("bigint"))

    def joined(c: Column) -> Column:
        first = end_of(c * chunk - 1)
        own = F.slice(spans, c * chunk + 1, chunk)
        put = lambda t, s, i: F.concat(part(t, end_of(c * chunk + i - 1) - first, s["start"] - first), names[s["kind"]])
        last = F.least((c + 1) * chunk, F.size(spans)) - 1
        return _let(part(text, first, end_of(last)), lambda t: F.array_join(F.transform(own, lambda s, i: put(t, s, i)), ""))

    cuts = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / chunk).cast("int"))
    return F.concat(F.array_join(F.transform(cuts, joined), ""), part(text, end_of(F.size(spans) - 1), F.length(text)))


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with each span that find() gives, overlapping ones united, replaced by its kind in brackets; a null text stays null."""
    df, base, spans = _found(docs, trees, text_col)
    text = F.col(text_col)
    masked = _let(F.col(spans), lambda spans: _let(_merged(spans), lambda merged: _masked(text, merged)))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).drop(base, spans)
