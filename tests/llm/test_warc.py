import base64
import glob
import gzip
import hashlib
import random

from quernstone.llm import warc


def test_loser_tree():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(n)]
        assert list(warc.LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def test_many_runs_merge_in_passes(tmp_path, monkeypatch):
    import os

    from pyarrow import fs

    rng = random.Random(5)
    runs = [sorted((b"key%d" % rng.randint(0, 9), b"2024", rng.randint(0, 99), r, 0, i, 1) for i in range(rng.randint(0, 40))) for r in range(23)]
    for fan in (2, 3, 5, 64):
        monkeypatch.setattr(warc, "FAN_IN", fan)
        made: list[str] = []
        got = list(warc._in_passes(fs.LocalFileSystem(), str(tmp_path), [iter(r) for r in runs], made))
        assert got == sorted(e for r in runs for e in r)
        assert bool(made) == (fan < 23) and all(map(os.path.exists, made))


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://www.h{rng.randint(0, 5)}.example.com:80/a{rng.randint(0, 30)}?q#f", rng.choice(["<p>one</p>", f"<p>{i}é</p>", "", None, "x" * 300_000 if i == 7 else "y"]), 1) for i in range(900)]
    rows += [(None, None, "null id", 1), (5000, "no scheme\n here", "<p>one</p>", 1), (3, rows[3][1], rows[3][2], 1)] + [(6000 + i, "http://hot.example.com/", f"hot {i}", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first int").repartition(5)
    got = warc.archive(df, folder=f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        new = i is None or first[h or ""] == i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if new else "revisit", None if new else first[h or ""]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key.encode(), r.stamp, r.page_id if r.page_id is not None else -1) for r in sorted(got, key=lambda r: (r.part, r.seq))]
    assert order == sorted(order) and len({r.part for r in got}) > 1
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    assert warc.archive(df.limit(0)).count() == 0


def test_url_key(spark):
    df = spark.createDataFrame([("HTTP://www.B.Example.com:8080/p/Q?x=1#top",), ("x y",), (None,)], "u string")
    assert [r[0] for r in df.select(warc.url_key(df.u)).collect()] == ["com,example,b)/p/Q?x=1", ")x%20y", ")"]
