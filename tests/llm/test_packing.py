import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quernstone.llm import packing

TEXTS = ["", None, "  \t ", "it's don'T ΣΑΣ Σ é", "<|endoftext|>x  y<|startoftext|>", "a\x01b \x01 c\x85d", "日本語 テスト ＡＢ", "z" * 5000, "one two three " * 4000, *(f"topic{i % 3} word{i} shared text {'pad ' * (i * 37 % 900)}" for i in range(120))]


def test_encoder_is_the_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.Encoder().encode([x and x.encode() for x in TEXTS])
    for text, ids in zip(TEXTS, got):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_encoder_over_odd_words_and_whole_tables():
    import duckdb

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["".join(map(chr, range(a, a + 40))) for a in range(32, 700, 13)] + [f"a{chr(c)}b {chr(c)}1" for c in range(32, 1200)]
    e = packing.Encoder()
    for _ in range(2):
        assert [x.tolist() for x in e.encode([x.encode() for x in texts])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    whole = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole._by_word and whole.encode([b" two  words", None])[0].tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" two  words").ids


def test_each_distinct_run_is_encoded_once_a_task():
    e, asked = packing.Encoder(), []
    model = e._model

    class Counted:
        def tokenize(self, run):
            asked.append(run)
            return model.tokenize(run)

    e._model = Counted()
    runs = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(80_000)]
    texts = [" ".join(runs[i : i + 100]).encode() for i in range(0, len(runs), 100)]
    first = [x.tolist() for i in range(0, len(texts), 256) for x in e.encode(texts[i : i + 256])]
    again = [x.tolist() for i in range(0, len(texts), 256) for x in e.encode(texts[i : i + 256])]
    assert first == again
    assert len(asked) == len(set(asked)) == len(runs)


def test_encoder_over_cuts_and_what_it_forgets(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    signs = [*"strevldma  \n\t12!?-.SRÉéßÿžıªº²¼×÷§~", "'ll", "'re", "'ve", "!'s", "''t", "'S", "\x0b", "\x1f"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 400))) for _ in range(300)] + ["", " ", "'", "x'", " 'd", "'re" * 900, "a" * 3000 + " b"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    raw = [x.encode() for x in texts]
    assert [x.tolist() for x in packing.Encoder().encode(raw)] == want
    assert [len(x) for x in packing.Encoder().encode([b" ", None, b"\n \t", b""])] == [0, 0, 0, 0]
    for name, value in (("MEMO", 50), ("CHARS", 64), ("LOOKUP", 200)):
        monkeypatch.setattr(packing, name, value)
        e = packing.Encoder()
        for _ in range(2):
            assert [x.tolist() for x in e.encode(raw)] == want
        assert len(e._runs._keys) <= 50


def test_batches_are_cut_by_bytes():
    b = pa.record_batch([pa.array(["a" * 5, None, "", "é" * 3, "b" * 40, "c"])], ["text"])
    assert [p.column(0).to_pylist() for p in packing._parts(b, 0, 11)] == [["a" * 5, None, "", "é" * 3], ["b" * 40], ["c"]]
    assert [p.num_rows for p in packing._parts(b.slice(3), 0, 1)] == [1, 1, 1]
    assert list(packing._parts(b.slice(0, 0), 0, 1)) == []


def test_round_trip_and_padding(spark):
    rows = [(i if i != 4 else None, t, "s", i) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start long")
    got = packing.pack(df).collect()
    enc = packing.Encoder()
    want = sorted((str(i), (*enc.encode([t and t.encode()])[0].tolist(), 2)) for i, t, *_ in rows)
    docs: dict = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, ids.tolist()))
    one = {k: v for k, v in docs.items() if k[0] != "7"}
    assert sorted((k[0], tuple(sum((p for _, p in sorted(v)), []))) for k, v in one.items()) == [w for w in want if w[0] != "7"]
    assert sum(len(p) for k, v in docs.items() if k[0] == "7" for _, p in v) == 2 * len(next(w for w in want if w[0] == "7")[1])
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    crc = packing.digest(packing.pack(df)).where("doc_id = 3").collect()
    assert [r.ids_crc32 for r in crc] == [zlib.crc32(np.array([*enc.encode([TEXTS[3].encode()])[0], 2], "<u4").tobytes())]
    assert packing.pack(df.limit(0)).count() == 0


def test_neighbours_are_bm25():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 7], [5, 5, 9], [8, 9], [6, 7, 9, 9, 9], [7])]
    got = packing.Index(docs).neighbours(0, np.array([False, True, True, True, True]))
    n, mean = 5, sum(map(len, docs)) / 5

    def score(q, d):
        out = 0.0
        for t in set(docs[q].tolist()):
            df = sum(t in x for x in docs)
            tf = docs[d].tolist().count(t)
            out += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return out

    assert got.tolist() == sorted((d for d in range(1, 5) if score(0, d) > 0), key=lambda d: -score(0, d))


def greedy(docs, window):
    """Windows by the docstring, one document at a time and scores by hand."""
    used = [0] * len(docs)
    n, mean = len(docs), max(sum(map(len, docs)) / len(docs), 1)
    df = Counter(t for d in docs for t in set(d))

    def score(q, d):
        out = 0.0
        for t in sorted(set(docs[q])):
            tf = docs[d].count(t)
            if tf:
                out += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return out

    out = []
    for d, ids in enumerate(docs):
        while len(ids) - used[d] >= window:
            out.append([(d, used[d], window)])
            used[d] += window
    left = lambda d: len(docs[d]) - used[d]
    rest, now = None, []
    while any(left(d) for d in range(n)):
        seed = rest if rest is not None else next(d for d in range(n) if left(d))
        now, room, nxt = [], window, seed
        while nxt is not None and room:
            take = min(left(nxt), room)
            now.append((nxt, used[nxt], take))
            used[nxt] += take
            room -= take
            open_ = [d for d in range(n) if left(d)]
            ranked = sorted((d for d in open_ if score(seed, d) > 1e-12), key=lambda d: (-round(score(seed, d), 9), d))
            nxt = ranked[0] if ranked else open_[0] if open_ else None
        rest = now[-1][0] if left(now[-1][0]) else None
        if not room:
            out.append(now)
            now = []
    return out, now


def test_windows_fill_like_brute_force():
    rng = np.random.default_rng(11)
    for size in (1, 7, 60, 130):
        docs = [np.append(rng.choice(40, rng.integers(0, 30), p=np.arange(1, 41) / 820), 2).astype(np.uint16) for _ in range(size)] + [np.full(70, 3, np.uint16)]
        want, last = greedy([d.tolist() for d in docs], 32)
        got = list(packing.pack_shard(docs, 32))
        assert got[: len(want)] == want
        tail = [(d, s + i) for seq in got[len(want) :] for d, s, n in seq for i in range(n)]
        assert tail == [(d, s + i) for d, s, n in last for i in range(n)]


def test_documents_are_weighed_once_and_dealt_out_evenly_by_their_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "SAMPLED", 20, raising=False)
    df = spark.createDataFrame([(i, f"topic{i % 40} word{i} " * (1 + i % 5)) for i in range(2000)], "doc_id long, text string").repartition(5)
    weighed = spark.sparkContext.accumulator(0)
    heaviest = packing.heaviest

    def counted(flat, at, idf):
        weighed.add(len(at) - 1)
        return heaviest(flat, at, idf)

    monkeypatch.setattr(packing, "heaviest", counted)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = packing.pack(df, window=64).select("doc_id", "sequence_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {r.doc_id for r in got} == set(range(2000))
    assert 2000 <= weighed.value <= 2000 + 2 * 20 * 8
    sizes = [len({r.doc_id for r in got if r.sequence_id >> 40 == p}) for p in range(8)]
    assert sum(sizes) == 2000 and min(sizes) > 100 and max(sizes) < 500


def test_related_documents_come_to_lie_in_one_shard(spark):
    old, packing.SHARD_DOCS = packing.SHARD_DOCS, 10
    topics = [f"topic{t} {' '.join(f'alpha{t}x{j}' for j in range(12))}" for t in range(8)]
    df = spark.createDataFrame([(i, f"{topics[i % 8]} common words of all number {i}") for i in range(160)], "doc_id long, text string").repartition(7)
    try:
        got = packing.pack(df, window=2048).collect()
    finally:
        packing.SHARD_DOCS = old
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    assert sum(len(s) for s in seqs.values()) / len(seqs) < 3
