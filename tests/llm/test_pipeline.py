import duckdb
import pytest

import corpus_pipeline
from quernstone.llm import packing, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"file://{top}/{name}")
        docs = spark.read.parquet(f"file://{top}/{name}")
    return [*out, docs]


def test_columns_stay_until_the_last(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_toxic_documents_go_and_clean_ones_stay(stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    truth = duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall()
    toxic, clean = [i for i, y in truth if y], [i for i, y in truth if not y]
    assert sum(i not in kept for i in toxic) > 0.7 * len(toxic)
    assert sum(i in kept for i in clean) > 0.97 * len(clean)


def test_one_of_each_component_stays(stages):
    rows = stages[1].select("doc_id", "text").collect()
    fps = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in stages[2].select("doc_id").collect()) == [i for i in ids if find(i) == i]


def test_base_formats_are_masked_and_the_rest_stays(stages):
    from .test_pii import brute

    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert after[i].n_chars == len(after[i].text)
        if brute(t):
            assert after[i].text != t and not brute(after[i].text)
        elif after[i].text == t:
            continue
    assert sum(after[i].text != t for i, t in before.items()) < 1.2 * sum(bool(brute(t)) for t in before.values())


def test_mix_is_within_its_budget(spark, stages):
    size = lambda d: sum(len((r.text or "").encode().split()) for r in d.collect())
    have, took = size(stages[3]), size(stages[4])
    assert 0.6 * have < took <= 0.75 * have
    ids = [r.doc_id for r in stages[4].collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in stages[3].collect()}


def test_all_ids_are_packed(stages):
    docs = {r.doc_id: r.text for r in stages[4].collect()}
    enc = packing.Encoder()
    want = {i: len(enc.encode([t and t.encode()])[0]) + 1 for i, t in docs.items()}
    got: dict = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_run_is_the_stages(spark, stages):
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(r.length for r in stages[5].collect())


def test_empty_and_odd_documents(spark, stages):
    schema = stages[0].schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, "x " * 90_000, "en", "src1", 1), (2, "x " * 90_000, "en", "src1", 1), (3, "mail a@b.co", "de", None, 5)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            docs = spark.createDataFrame(made.collect(), made.schema)
        assert rows or docs.count() == 0
