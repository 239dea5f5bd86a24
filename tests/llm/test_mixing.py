from collections import Counter

from pyspark.sql import functions as F

from quernstone.llm import mixing


def test_shortage_goes_to_siblings_first(spark):
    sizes = spark.createDataFrame([("a", "x", 10), ("a", "y", 500), ("b", "x", 30), ("b", "y", 20), ("c", "z", 1000), ("d", "n", 0)], "p string, q string, size long")
    got = {(r.p, r.q): r.budget for r in mixing.budgets(sizes, ["p", "q"], [F.lit(1), F.lit(1)], 400, 1560, 1).collect()}
    # b has only 50 for its 100, d nothing; a and c share what is missing; inside a, y takes what x lacks
    assert got == {("a", "x"): 10, ("a", "y"): 165, ("b", "x"): 30, ("b", "y"): 20, ("c", "z"): 175, ("d", "n"): 0}


def test_prefix_epochs_and_odd_rows(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, "s", i, 1) for i in range(200)] + [(None, "a b", "en", "s", 1, 1), (7, "a b c", "en", "s", 1, 1), (7, "a b c", "en", "s", 1, 1), (900, None, "zz", "s", 1, 1), (901, "x " * 50_000, "de", "s", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, whole long, last long")
    path = {"lang": F.col("lang"), "source": F.col("source")}
    df2 = df
    for epochs in (1, 3):
        got = mixing.mix(df2, path, [F.lit(1), F.lit(1)], 1, 2, epochs=epochs, seed=3)
        assert got.columns[:6] == df2.columns
        used = Counter()
        for r in got.collect():
            used[r["__path"].lang] += r["__tokens"]
            assert 1 <= r["__epoch"] <= epochs
        sizes = Counter()
        for _, t, lang, *_ in rows:
            sizes[lang or ""] += len((t or "").split())
        total = sum(sizes.values()) // 2
        assert all(used[k] <= epochs * sizes[k] for k in used) and sum(used.values()) <= total
        assert used["zz"] == 0 and used[""] == epochs * sizes[""] and used["en"] == epochs * sizes["en"] or epochs == 3
    assert mixing.mix(df2.limit(0), path, [F.lit(1), F.lit(1)], 1, 2).count() == 0


def test_a_prefix_that_ends_among_equal_rows(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b", "s")] * 4
    got = mixing.mix(spark.createDataFrame(rows, schema), {"source": F.col("source")}, [F.lit(1)], 1, 2, epochs=1, seed=3).collect()
    assert [(r.doc_id, r["__epoch"]) for r in got] == [(1, 1), (1, 1)]
    got = mixing.mix(spark.createDataFrame(rows, schema), {"source": F.col("source")}, [F.lit(1)], 3, 2, epochs=2, seed=3).collect()
    assert Counter(r["__epoch"] for r in got) == {1: 4, 2: 2}
    rows = [(i % 5 if i % 7 else None, "a b" if i % 2 else "c d", f"s{i % 3}") for i in range(90)]
    for numerator in range(1, 12):
        got = mixing.mix(spark.createDataFrame(rows, schema), {"source": F.col("source")}, [F.lit(1)], numerator, 12, epochs=1, seed=5).collect()
        used = Counter(r["__path"].source for r in got)
        assert all(abs(2 * n - 180 * numerator / 36) < 3 and 2 * n <= 180 * numerator / 36 for n in used.values()) and sum(used.values()) >= 90 * numerator // 12 - 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 1, 2, 3, 4, {"k": i}) for i in range(20)], "doc_id long, text string, __path string, __tokens int, __plan int, __id int, __all int, __row map<string,int>")
    got = mixing.mix(df, {"source": F.col("__path")}, [F.lit(1)], 1, 2).collect()
    assert len(got) == 10 and all(r["__tokens"] == 3 and r["__path"].source == "s" and r["__row"] == {"k": r.doc_id} and r["__id"] == 2 + 1 for r in got)


def test_nulls_in_other_columns_tell_rows_apart(spark):
    rows = [(7, "a b", "X", None), (7, "a b", None, "X")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c1 string, c2 string")
    got = mixing.mix(df, {"all": F.lit("")}, [F.lit(1)], 3, 2, epochs=2).collect()
    assert sorted(Counter((r.c1, r.c2) for r in got).values()) == [1, 2]


def test_rows_that_share_an_id_are_dealt_out_by_their_hashes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 3)
    rows = [(None, f"t{i % 90} {'w ' * (i % 4)}", i % 90) for i in range(180)] + [(5, f"u{i}", i) for i in range(60)] + [(i, "", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nr int").repartition(5)
    total = sum(len(t.split()) for _, t, _ in rows)
    for twelfths in (1, 7, 11, 17):
        budget = min(total * twelfths // 12, 2 * total)
        got = mixing.mix(df, {"all": F.lit("")}, [F.lit(1)], twelfths, 12, epochs=2, seed=twelfths).collect()
        used = sum(r["__tokens"] for r in got)
        assert budget - 4 < used <= budget
        times = Counter((r.doc_id, r.text, r.nr) for r in got)
        have = Counter(rows)
        whole = budget // total
        # each row has the whole epochs, and one of them at most is torn
        assert all(whole * have[k] <= times[k] <= (whole + 1) * have[k] for k in have)
        assert sum(times[k] not in (whole * have[k], (whole + 1) * have[k]) for k in have) <= 1
