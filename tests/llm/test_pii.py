import hashlib
import re

import pytest
import regex

from quernstone.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(spark)


TEXTS = [
    None, "", "  ", "nothing here 12 34", "a@b.c_d@e.f x@y z@q.r.", "a.b+c%d@e-f.g.h. .@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.1.1 1.2.3", "00000000000000000001.1.1.1",
    "4465758382889437 4465758382889437 4465758382889437", "4465-7583 8288-9437, 4465  758382889437", "+1 (743) 555-3824 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +491711234567.", "a@b.coé 日本 x@y.zz 𝒳 +49 171 1234567", "+", "@", "é@b.co ü1.2.3.4ü",
    "call (743) 555-3824 today", "mail ann.lee [at] example [dot] com", "a" * 60_000, "1" * 60_000, "+1" * 5000, "(" * 30_000, "a.b@" * 3000, "x@y.zz " * 4000, "1.1.1.1 " * 3000 + "9" * 30, "4 " * 9000, "1.2.3.4 999.1.1.1 " * 3000,
]


def test_base_spans_like_brute_force(spark, trees):
    import duckdb

    texts = TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    df = spark.createDataFrame([(i, t, "b", "s") for i, t in enumerate(texts)], "doc_id long, text string, base string, spans string")
    got = {r.doc_id: r for r in pii.digest(pii.find(df, trees)).collect()}
    for i, t in enumerate(texts):
        want, r = brute(t), got[i]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t and t[:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, str(s), str(e)) for k, s, e in [(pii.KINDS[k], s, e) for s, k, e in want]} <= set(spans)
    added = lambda i: set(got[i].spans.split(",")) - set(listed(brute(texts[i])).split(","))
    assert added(TEXTS.index("call (743) 555-3824 today")) == {"phone:5:19"}
    assert added(TEXTS.index("mail ann.lee [at] example [dot] com")) == {"email:5:35"}
    assert added(8) == {"card:0:16", "card:17:33", "card:34:50"}
    assert pii.digest(pii.find(df.limit(0), trees)).count() == 0


def candidate_features(s, before, after):
    near, nxt, digits = before[-40:], after[:12], re.sub("[^0-9]", "", s)
    small = all(int(x or 0) <= 255 for x in re.split("[^0-9]+", s))
    has = lambda pattern, x: int(bool(regex.search(pattern, x)))
    return [
        len(s), len(digits), len(re.findall("[A-Za-z]", s)), int(bool(digits) and luhn(digits)), len(re.findall("[ ./-]", s)), int("(" in s), has(r"[\[({]at|[\[({]dot|\[\.\]", s), int(small),
        len(re.split("[^0-9]+", s)), s.count(":"), *(has(pii._CONTEXT[k], near) for k in ("phone", "card", "email", "ip", "other")), has(r"[\p{L}0-9]$", near), has(r"^[\p{L}0-9]", nxt),
        int(digits[0]) if digits else -1, len(re.findall("[0-9]", near)), len(set(digits)), has(" at | dot ", s),
    ]


def brute_spans(text, trees):
    """Base spans, and candidates of what those leave that the trees pick, one tree after the other."""
    t = text or ""
    tests = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s)), "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15}
    for kind, pattern in zip(pii.KINDS, (EMAIL, IP, CARD, PHONE)):
        t = pattern.sub(lambda m, k=kind: pii._COVER * len(m[0]) if tests[k](m[0]) else m[0], t)
    out = set(brute(text))
    for k, kind in enumerate(pii.KINDS):
        found = list(regex.finditer(pii.GENERATORS[kind], t))
        for i, m in enumerate(found):
            before = t[found[i - 1].end() if i else 0 : m.start()]
            after = t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)]
            f = [*candidate_features(m[0], before, after), k]
            score = 0.0
            for asked, values in trees.trees:
                leaf = 0
                for j, c in asked:
                    leaf = 2 * leaf + (f[j] > c)
                score += values[leaf]
            if score >= trees.limits[k]:
                out.add((m.start(), k, m.end()))
    return sorted(out)


def test_all_spans_like_brute_force(spark, trees):
    import duckdb

    texts = [t for t in TEXTS if not t or len(t) < 10_000] + [t for _, t, _ in pii._invented(seed=5, n=8)]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df, trees)).collect()}
    want = [listed(brute_spans(t, trees)) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w != listed(brute(t)) for w, t in zip(want, texts)) > 20


def test_columns_of_any_name_stay(spark, trees):
    df = spark.createDataFrame([(1, "mail x@y.zz", "o", "t", 3, "s")], "doc_id long, text string, __o string, __T string, __base int, ___spans string")
    assert pii.redact(df, trees).collect() == [(1, "mail [EMAIL]", "o", "t", 3, "s")]
    assert pii.find(df, trees).columns == [*df.columns, "base", "spans"]


def test_redaction(spark, trees):
    df = spark.createDataFrame([(1, "mail x@y.zz or 1.2.3.4, +1 (743) 555-3824 end", "a"), (2, None, "b"), (3, "clean 12 text ", "c"), (None, "4465758382889437", None)], "doc_id long, text string, lang string")
    got = pii.redact(df, trees)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [EMAIL] or [IP], [PHONE] end", 2: None, 3: "clean 12 text ", None: "[CARD]"}


def test_redaction_masks_all_that_is_found(spark, trees):
    texts = TEXTS + ["tel +33.6.12.34.56.78 end", "+1.2.3.4.5.6.7.8.9 x 10.0.0.1", "é𝒳+33.6.12.34.56.78,+33.6.12.34.56.79", "a@1.2.3.4 +49 4465758382889437"]
    df = spark.createDataFrame([(i, t, "b", "s") for i, t in enumerate(texts)], "doc_id long, text string, base string, spans string")
    found = {r.doc_id: r.spans for r in pii.find(df, trees).collect()}
    rows = pii.redact(df, trees).collect()
    assert len(rows) == len(texts) and {(r.base, r.spans) for r in rows} == {("b", "s")}
    for r in rows:
        merged = []
        for s in found[r.doc_id]:
            if merged and s.start < merged[-1][0][1]:
                merged[-1][0][1] = max(merged[-1][0][1], s.end)
                merged[-1][1].append(s)
            else:
                merged.append(([s.start, s.end], [s]))
        want, at = "", 0
        for (start, end), own in merged:
            kind = min(own, key=lambda s: (s.start - s.end, s.kind)).kind
            want, at = f"{want}{texts[r.doc_id][at:start]}[{pii.KINDS[kind].upper()}]", end
        assert r.text == (None if texts[r.doc_id] is None else want + texts[r.doc_id][at:]), texts[r.doc_id][:60]
    assert rows[len(TEXTS)].text == "tel [PHONE] end"


def test_no_python_in_the_plan(spark, trees):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.digest(pii.find(df, trees))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trees_on_unseen_examples(spark, trees):
    rows = pii._invented(seed=99, n=20)
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df, trees)).collect()}
    hit = [(y, kind in got[i]) for i, (kind, _, y) in enumerate(rows)]
    assert sum(h for y, h in hit if y) / sum(y for y, _ in hit) > 0.9
    assert sum(h for y, h in hit if not y) / sum(1 - y for y, _ in hit) < 0.12
