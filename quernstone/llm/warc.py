"""Web archives: writing, an external merge of their capture indexes, reading back.

Pages are sorted inside each partition by URL key, timestamp and id, and written as gzipped WARC
records with a run of index lines beside them, in the same order. Splitters from a thinned sample of
the runs' keys cut the key space into ranges, so that a key with very many captures is cut too. One
task merges one range: a loser tree over the runs, each opened at the place that its sparse index
gives. More than FAN_IN runs are merged in several passes through files in the shared folder. What the
last tree puts out is the global capture history; records are read from the archives as they come up,
which is in the order in which they lie there, through a pool of HANDLES open archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path

TIMESTAMP = "20240101000000"
#: Index lines between two entries of a run's sparse index; keys sampled for splitters; bytes of an archive.
SPARSE, SAMPLED, ARCHIVE_BYTES = 128, 4096, 1 << 30
#: Runs that a tree merges at once, archives that a task holds open, repeated digests that a broadcast may hold.
FAN_IN, HANDLES, BROADCAST_DIGESTS = 64, 64, 1_000_000
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host names reversed, then path and query, without scheme, port and fragment; control characters and blanks as %20."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, scheme + "(?:www[.])?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, scheme + "[^/?#]*", ""), "(?s)#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest)
    return F.coalesce(F.regexp_replace(key, "[\\x00-\\x20\\x7f]", "%20"), F.lit(")"))


def record(kind: str, page: int | None, url: str, stamp: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    when = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {when}", f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {name(refers)}"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record's fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its Content-Length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """Merges sorted iterators; each step replays one path, a comparison a level."""

    def __init__(self, runs: Iterable[Iterator]):
        self._runs = list(runs)
        self._heads = [next(r, None) for r in self._runs]
        n = len(self._runs)
        self._losers = [-1] * n
        for i in range(n):
            self._replay(i)

    def _first(self, a: int, b: int) -> bool:
        """True if run a's head comes before run b's; -1 stands for a run not yet entered, an ended run comes last."""
        if a == -1 or b == -1:
            return a == -1
        x, y = self._heads[a], self._heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        n = len(self._runs)
        at = (i + n) // 2
        while at > 0:
            if self._first(self._losers[at], i):
                self._losers[at], i = i, self._losers[at]
                if i == -1:
                    return
            at //= 2
        self._losers[0] = i

    def __iter__(self):
        while self._runs and (head := self._heads[i := self._losers[0]]) is not None:
            yield head
            self._heads[i] = next(self._runs[i], None)
            self._replay(i)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives and index runs of pages (id, url, key, stamp, payload, sha, first); a row for each run.

    A task that runs again writes other files, and only those of the task that counts are in the result.
    """

    def each(batches):
        fs, top = pafs.FileSystem.from_uri(folder)
        name = f"{top}/run-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        files: list[str] = []
        out = index = None
        sparse: list[tuple] = []
        n = place = 0
        fs.create_dir(top, recursive=True)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for page, url, key, stamp, payload, sha, first in zip(*cols):
                if out is None or out.tell() > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{name}-{len(files)}.warc.gz")
                    out = fs.open_output_stream(files[-1], compression=None)
                    index = index or fs.open_output_stream(f"{name}.cdx")
                kind = "response" if page is None or first is None or first == page else "revisit"
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                raw = gzip.compress(record(kind, page, url or "", stamp, (payload or "").encode(), digest, first if kind == "revisit" else None), 1, mtime=0)
                if n % SPARSE == 0:
                    sparse.append((key, stamp, page if page is not None else -(1 << 62), place))
                line = f"{key}\t{stamp}\t{'' if page is None else page}\t{len(files) - 1}\t{out.tell()}\t{len(raw)}\n".encode()
                out.write(raw)
                index.write(line)
                place += len(line)
                n += 1
        if out is not None:
            out.close()
            index.close()
            cols = [list(x) for x in zip(*sparse)]
            yield pa.record_batch([pa.array([f"{name}.cdx"]), pa.array([files]), *[pa.array([c]) for c in cols]], ["run", "files", "keys", "stamps", "pages", "places"])

    kinds = "run string, files array<string>, keys array<string>, stamps array<string>, pages array<long>, places array<long>"
    own = pages.select("id", "url", "key", "stamp", "payload", "sha", "first")
    return own.sortWithinPartitions("key", "stamp", F.col("id").asc_nulls_first()).mapInArrow(each, kinds)


def _lines(fs, run: str, at: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Index entries of a run from low on and below high, as tuples that sort."""
    with fs.open_input_file(run) as f:
        f.seek(at)
        rest = b""
        while block := f.read(1 << 16):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                key, stamp, page, *where = line.split(b"\t")
                entry = (key, stamp, int(page) if page else -(1 << 62), *map(int, where))
                if high is not None and entry[:3] >= high:
                    return
                if low is None or entry[:3] >= low:
                    yield entry


def _in_passes(fs, top: str, runs: list[Iterator[tuple]], made: list[str]) -> Iterator[tuple]:
    """The runs' entries in order, FAN_IN of them at a time; intermediate files are added to made."""

    def again(path: str) -> Iterator[tuple]:
        with fs.open_input_stream(path, compression=None) as f:
            rest = b""
            while block := f.read(1 << 16):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    key, stamp, *numbers = line.split(b"\t")
                    yield (key, stamp, *map(int, numbers))

    while len(runs) > FAN_IN:
        merged = []
        for i in range(0, len(runs), FAN_IN):
            path = f"{top}/merge-{uuid.uuid4().hex}"
            made.append(path)
            with fs.open_output_stream(path, compression=None) as out:
                for key, stamp, *numbers in LoserTree(runs[i : i + FAN_IN]):
                    out.write(b"\t".join([key, stamp, *(b"%d" % n for n in numbers)]) + b"\n")
            merged.append(again(path))
        runs = merged
    yield from LoserTree(runs)


def merge(runs: DataFrame, folder: str, ranges: int) -> DataFrame:
    """All captures of the runs in global order (part, seq), with what their records say."""
    entries = runs.select(F.explode(F.arrays_zip("keys", "stamps", "pages")).alias("e"))
    thin = max(1, entries.count() // SAMPLED)
    sample = entries.where(F.pmod(F.xxhash64("e.keys", "e.stamps", "e.pages"), F.lit(thin)) == 0)
    keys = sorted((r.e["keys"].encode(), r.e.stamps.encode(), r.e.pages) for r in sample.collect())
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def parts(batches):
        for b in batches:
            for row in b.to_pylist():
                own = [(k.encode(), s.encode(), p) for k, s, p in zip(row["keys"], row["stamps"], row["pages"])]
                first, last = bisect_right(cuts, own[0]), len(cuts)
                use = list(range(first, last + 1))
                places = [row["places"][max(bisect_left(own, cuts[p - 1]) - 1, 0)] if p else 0 for p in use]
                yield pa.record_batch([pa.array(use, pa.int32()), pa.array([row["run"]] * len(use)), pa.array([row["files"]] * len(use)), pa.array(places, pa.int64())], ["part", "run", "files", "at"])

    names = ["part", "seq", "url_key", "stamp", "page_id", "archive", "offset", "length", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    schema = "part int, seq long, url_key string, stamp string, page_id long, archive string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"

    def one(fs, top: str, part: int, opened: list[tuple[str, list[str], int]]):
        low, high = cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None
        handles: OrderedDict[str, object] = OrderedDict()
        made: list[str] = []

        def tagged(i, run, at):
            for e in _lines(fs, run, at, low, high):
                yield (*e[:3], i, *e[3:])

        def handle(path):
            if path not in handles:
                if len(handles) >= HANDLES:
                    handles.popitem(last=False)[1].close()
                handles[path] = fs.open_input_file(path)
            handles.move_to_end(path)
            return handles[path]

        try:
            entries = _in_passes(fs, top, [tagged(i, run, at) for i, (run, _, at) in enumerate(opened)], made)
            for seq, (key, stamp, page, i, file, offset, length) in enumerate(entries):
                path = opened[i][1][file]
                fields, http, payload = parse(gzip.decompress(handle(path).read_at(length, offset)))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http["Content-Length"])
                if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{path} at {offset}: the payload isn't the one that was written")
                refers = fields.get("WARC-Refers-To", "")[10:-1]
                named = fields["WARC-Record-ID"][10:-1]
                yield (part, seq, key.decode(), stamp.decode(), int(named) if named else None, path, offset, length, fields["WARC-Type"], digest, size, int(refers) if refers else None)
        finally:
            for h in handles.values():
                h.close()
            for path in made:
                fs.delete_file(path)

    def merged(batches):
        fs, top = pafs.FileSystem.from_uri(folder)
        held: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["part"], []).append((r["run"], r["files"], r["at"]))
        rows = []
        for part in sorted(held):
            for row in one(fs, top, part, sorted(held[part])):
                rows.append(row)
                if len(rows) == 4096:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    opened = runs.mapInArrow(parts, "part int, run string, files array<string>, at long")
    return opened.repartitionByRange(max(len(cuts) + 1, 1), "part").mapInArrow(merged, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", stamp: Column | None = None, folder: str | None = None) -> DataFrame:
    """Writes pages into archives below folder and returns their merged capture index, read back.

    A null payload is empty. Of equal payloads the smallest id is a response, the others revisit it; a null id
    is always a response, rows that repeat the smallest id are responses too. A null URL is an empty one. An
    empty table gives no archive and no rows; other columns are not read. stamp is a 14-digit time.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), (stamp if stamp is not None else F.lit(TIMESTAMP)).alias("stamp"))
    own = own.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    # only digests that repeat need a look-up; while they are few, payloads aren't shuffled for them
    firsts = own.where("id is not null").groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("same"), "first")
    firsts = cut(firsts, "digests")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(write(own.join(firsts, F.col("sha") == F.col("same"), "left").withColumn("key", url_key(F.col("url"))), folder), "runs")
    return merge(runs, folder, ranges)


ORACLE = """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha, url FROM pages
    ), b AS (
        SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * instr('0123456789abcdef', c) - 3 AS BIGINT), 4)), '') AS bits,
               min(page_id) OVER (PARTITION BY sha) AS first
        FROM p
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
               + 16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT)
               + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * i + 5, 1) AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM b
"""
