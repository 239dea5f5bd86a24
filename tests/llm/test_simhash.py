import random
from itertools import combinations

from quernstone.llm import simhash
from quernstone.llm.components import components


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_chain_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(3, 3), (100, 101), (101, 100), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_links_connect_like_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for base in fps[:25]:
        x = base
        for _ in range(6):
            for bit in rng.sample(range(64) if rng.random() < 0.5 else range(16, 32), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: i for i, x in enumerate(signed)}
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    found = [(at[r.src], at[r.dst]) for r in links]
    assert {tuple(sorted(p)) for p in found} <= set(near)
    assert closure(len(fps), found) == closure(len(fps), near)


def test_documents(spark):
    rows = [(5, "A b  c\td e", 1), (2, "a B c d\ne", 2), (9, None, 3), (7, "", 4), (8, " \t", 5), (None, "a b c d e", 6), (3, "uno dos", 7), (3, "uno dos", 7), (4, "x" * 200_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    by = {d: (f, c) for d, f, c in got}
    assert len(got) == len(rows)
    assert by[5] == by[2] == by[None] and by[5][1] == 2
    assert by[9] == by[7] == by[8] == ("0" * 16, 7)
    assert by[3][1] == 3 and by[4][1] == 4
    h = spark.sql("select lower(hex(xxhash64('uno dos'))) h").first().h
    assert by[3][0] == h.zfill(16)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = [(1, "t t t"), (1, "t t t"), (2, "t t t"), (2, "u v w x"), (None, "t t t"), (None, "only here once"), (None, "only here once"), (7, None), (8, ""), (3, "T t  t")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "t t t"), ("2", "u v w x"), ("7", None), ("None", "only here once")]
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_nulls_in_other_columns_tell_rows_apart(spark):
    rows = [(7, None, "u v", "a"), (7, "u v", None, "a"), (1, "z", None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, c string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [1, 7]
