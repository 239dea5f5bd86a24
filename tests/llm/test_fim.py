import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quernstone.llm import fim


def brute(doc_id, text):
    text = text or ""
    units = re.findall(fim.UNIT, text)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def rows():
    odd = ["", " ", " \t\n ", "one", " one", "one ", "a b  c\r\n d \x0b", "<P>", "a <S> b", "x<M>", "<", "a <", "P> <P", "\x01", "\x02", "\x02d\x01 \x02e \x01\x01 a", "\x02d", "ü 字字 \U0001f600 é  x", "$1 \\ $0 a", "<S <P <M > b", "d e d e"]
    texts = [None, *odd, "w " * 50_000, " " * 100_000, "x" * 100_000, "\n".join(["\x01\x02d"] * 3000)]
    # each text under many ids, so that it is drawn in all forms
    return [(None if i % 97 == 96 else i, t, i % 5) for i, t in enumerate(texts * 40)]


def test_like_brute_force(spark):
    have = [*rows(), *rows()[:30]]
    df = spark.createDataFrame(have, "doc_id long, text string, nr int").repartition(4)
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "nr", "fim"]
    got = [(r.doc_id, r.text, r.nr, tuple(r.fim)) for r in made.collect()]
    want = [(i, t, nr, *[(n, form, out, p, m) for n, form, out, p, m in [brute(i, t)]]) for i, t, nr in have]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[3][1] for g in got} == {"plain", "spm", "psm"}
    back = made.select("text", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_digest_and_odd_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows()[:200]], "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, n, form, p, m, sha(out), sha(t or "")) for i, t, _ in rows()[:200] for n, form, out, p, m in [brute(i, t)]}
    assert {tuple(r) for r in fim.digest(fim.transform(df)).collect()} == want
    assert fim.digest(fim.transform(df.limit(0))).count() == 0
    clash = df.limit(60).select("doc_id", "text", F.lit(1).alias("fim"), F.lit(2).alias("row"), F.lit(3).alias("n"), F.lit(4).alias("a.b"))
    made = fim.transform(clash)
    assert made.columns == ["doc_id", "text", "row", "n", "a.b", "fim"] and all(r["row"] == 2 and r["n"] == 3 and r["a.b"] == 4 for r in made.collect())


def test_settings(spark):
    df = spark.createDataFrame([(i, "a b c d e f g") for i in range(300)], "doc_id long, text string")
    forms = lambda **x: {r.f for r in fim.transform(df, **x).select(F.col("fim.form").alias("f")).collect()}
    assert forms(percent=0) == {"plain"} and forms(percent=100, suffix_first=100) == {"spm"} and forms(percent=100, suffix_first=0) == {"psm"}
    assert fim.transform(df, seed=1).collect() != fim.transform(df, seed=2).collect()


def test_no_python_in_the_plan(spark):
    plan = fim.digest(fim.transform(spark.createDataFrame([(1, "a b")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_markers_that_could_arise_are_refused(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<<", "<S>", "<M>"), ("<P", "<PS", "<M"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(df, markers=markers)
