"""Lexical retrieval packing of documents into training windows.

Documents are encoded once. Document frequencies of all tokens, over all documents, tell each
document's heaviest terms, and documents are sorted by these across all partitions, so that those
about the same things come to lie together, ties dealt out by a hash. The sorted rows are cut into
shards of bounded size. A shard has a BM25 inverted index over its documents' token ids. A seed
document opens a window, the index ranks the documents not yet used by all of the seed's terms, and
these fill the window greedily; the one that no longer fits is cut, and its rest opens the next window.

Full windows need no padding. A shard's last window is dealt out into sequences whose lengths are
powers of two, which need none either.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, tidy

WINDOW = 4096
END = 2
#: A shard closes at so many documents or tokens, whichever comes first.
SHARD_DOCS, SHARD_TOKENS = 4096, 2_000_000
#: Heaviest terms that make a document's place in the order, and BM25's constants.
KEY_TERMS, K1, B = 4, 1.2, 0.75
#: Runs that a worker remembers the ids of, before it forgets those that it hasn't met for longest; words, before it starts anew with those in use.
MEMO, WORD_MEMO = 1 << 17, 1 << 15
#: Characters that are taken apart at once, and whose runs are looked up at once.
CHARS, LOOKUP = 1 << 18, 1 << 21
#: Documents for each partition whose places tell where partitions end; all documents are placed.
SAMPLED = 40
#: What a tokenizer's file must say for words to be encoded one by one, and for runs of letters to go straight to its model.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Texts of Latin letters and common marks, where lower case changes single characters only, and the runs that the split gives there.
_LATIN = re.compile("[\x09-\x0d -~\xa1-\xac\xae-\u012f\u0131-\u0148\u014a-\u017e]*")
_LETTERS, _NUMERALS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017e", "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANKS = " \x09-\x0d"
_CUT = re.compile(f"[{_BLANKS}]")
#: What a lower-case character of such texts is.
_BLANK, _LETTER, _NUMERAL, _MARK = range(4)
_KIND = np.array([next((k for k, own in enumerate((_BLANKS, _LETTERS, _NUMERALS)) if re.match(f"[{own}]", chr(c))), _MARK) for c in range(0x180)], np.uint8)


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write characters: each byte as one, of which printable Latin-1 stands for itself and the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(len(_KIND))}


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Remembers what a function of one argument gave, in two generations: what the last one held and this one uses moves on."""

    def __init__(self, make: Callable):
        self._make = make
        self._old: dict = {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > WORD_MEMO:
            self._old = dict(self)
            self.clear()


class _Runs:
    """Ids of runs, as arrays: a table of a few bytes a run, where a dictionary takes some hundred."""

    def __init__(self, make: Callable[[str], list[int]], kind: type):
        self._make, self._kind = make, kind
        self._keys, self._ids, self._met, self._turn = pa.array([], pa.binary()), pa.array([], pa.binary()), np.empty(0, np.int32), 0

    def ids(self, runs: list[pa.BinaryArray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs (UTF-16) in a row, and where each run's begin."""
        if not any(map(len, runs)):
            return np.empty(0, self._kind), np.zeros(1, np.int32)
        known = len(self._keys)
        coded = pa.chunked_array([self._keys, *runs], pa.binary()).dictionary_encode()
        self._keys = coded.chunk(coded.num_chunks - 1).dictionary
        self._ids = pa.concat_arrays([self._ids, self._made(self._keys.slice(known))])
        which = np.concatenate([c.indices.to_numpy() for c in coded.chunks])[known:]
        self._turn += 1
        self._met = np.append(self._met, np.zeros(len(self._keys) - known, np.int32))
        self._met[which] = self._turn
        found = self._ids.take(pa.array(which))
        if len(self._keys) > MEMO:
            stay = pa.array(np.sort(np.argsort(-self._met, kind="stable")[: MEMO // 2]))
            self._keys, self._ids, self._met = self._keys.take(stay), self._ids.take(stay), self._met[stay.to_numpy()]
        begin = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) // np.dtype(self._kind).itemsize
        return np.frombuffer(found.buffers()[2], self._kind, begin[-1]), begin

    def _made(self, new: pa.BinaryArray) -> pa.BinaryArray:
        ids, ends = array("I"), array("i", [0])
        for i in range(0, len(new), 4096):
            part = new.slice(i, 4096)
            at = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, 4 * part.offset)
            text = str(memoryview(part.buffers()[2])[at[0] : at[-1]], "utf-16-le")
            cuts = ((at - at[0]) // 2).tolist()
            for s, e in zip(cuts, cuts[1:]):
                ids.extend(self._make(text[s:e]))
                ends.append(len(ids))
        flat = np.frombuffer(ids, np.uint32).astype(self._kind)
        return pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(np.frombuffer(ends, np.int32) * np.int32(flat.itemsize)), pa.py_buffer(flat)])


def _runs_of(texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The runs that the split gives in these lower-case texts, as UTF-16, and how many each text has."""
    own = np.frombuffer("\n".join([*texts, "", ""]).encode("utf-16-le"), np.uint16)
    kind = _KIND[own]
    first = np.ones(len(own) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMERAL)
    mark = np.flatnonzero(own == ord("'"))
    mark = mark[first[mark] & (kind[mark + 1] == _LETTER)]
    one, two = own[mark + 1], own[mark + 2]
    short = mark[np.isin(one, [ord(c) for c in "stmd"])]
    long = mark[((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))]
    for at, size in ((short, 2), (long, 3)):
        first[at + 1] = False
        first[at + size] = True
    held = kind != _BLANK
    first = first[:-1]
    starts = np.append(np.flatnonzero(first[held]), np.count_nonzero(held))
    offsets = pa.py_buffer((2 * starts).astype(np.int32))
    runs = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(own[held])])
    return runs, np.diff(np.searchsorted(np.flatnonzero(first & held), np.cumsum([0, *(len(t) + 1 for t in texts)])))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about CHARS characters, cut at blanks."""
    at = 0
    while at < len(text):
        blank = _CUT.search(text, at + CHARS)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


class Encoder:
    """Ids of whole texts. With the steps known, no token crosses white space; each distinct run of letters, or else word, is encoded once."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(tokenizer_path(path))
        self._by_word = all((step := getattr(self._t, k)) is not None and json.loads(step.__getstate__()) == v for k, v in KNOWN_STEPS.items())
        self._kind = np.uint16 if self._t.get_vocab_size() <= 1 << 16 else np.uint32
        self._pack = (array("H") if self._kind == np.uint16 else array("I")).typecode
        self._model, self._bytes = self._t.model, _byte_chars()
        self._words = _Memo(lambda word: self._ids(word.decode()))
        self._runs = _Runs(self._run, self._kind)

    def _ids(self, text: str) -> bytes:
        return array(self._pack, self._t.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> list[int]:
        return [t.id for t in self._model.tokenize(run if run.isascii() else run.translate(self._bytes))]

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        runs, sizes, at = [], [], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and size < CHARS:
                size += len(texts[upto])
                upto += 1
            own, n = _runs_of(texts[at:upto])
            runs.append(own)
            sizes.append(n)
            at = upto
        ids, begin = self._runs.ids(runs)
        ends = begin[np.append(0, np.cumsum(np.concatenate(sizes)))].tolist()
        return [ids[s:e] for s, e in zip(ends, ends[1:])]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        self._words.turn()
        made: list[list[np.ndarray]] = [[] for _ in texts]
        owner: list[int] = []
        pieces: list[str] = []
        size = 0

        def close():
            nonlocal size
            if pieces:
                for i, ids in zip(owner, self._latin(pieces)):
                    made[i].append(ids)
            owner.clear()
            pieces.clear()
            size = 0

        for i, raw in enumerate(texts):
            if not raw:
                continue
            text = raw.decode()
            if not self._by_word:
                made[i].append(np.frombuffer(self._ids(text), self._kind))
            elif not _LATIN.fullmatch(text) or "<|" in text:
                made[i].append(np.frombuffer(b"".join(map(self._words.__getitem__, raw.split())), self._kind))
            else:
                for piece in _pieces(text.lower()):
                    owner.append(i)
                    pieces.append(piece)
                    size += len(piece)
                    if size >= LOOKUP:
                        close()
        close()
        return [m[0] if len(m) == 1 else np.concatenate(m) if m else np.empty(0, self._kind) for m in made]


class Index:
    """BM25 over the token ids of a shard's documents, as postings by term; those of terms that many documents have are rows of a matrix.

    It shrinks to the unused documents when half of those that it holds are used; weights stay those of the whole shard.
    """

    def __init__(self, docs: list[np.ndarray]):
        self.n = n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        terms = np.concatenate(docs) if n else np.empty(0, np.uint16)
        top = int(terms.max()) + 1 if len(terms) else 0
        bits = max(top.bit_length(), 1)
        kind = np.uint32 if n << bits < 1 << 32 else np.uint64
        keys = np.repeat((np.arange(n) << bits).astype(kind), lengths)
        keys |= terms
        keys, tf = np.unique(keys, return_counts=True)
        owner, terms = (keys >> kind(bits)).astype(np.int32), (keys & kind((1 << bits) - 1)).astype(np.int32)
        df = np.bincount(terms, minlength=top)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self._df, mean = df, max(lengths.mean(), 1.0) if n else 1.0
        norm = K1 * (1 - B + B * lengths / mean)
        weight = idf[terms] * tf * (K1 + 1) / (tf + norm[owner])
        self._terms = terms
        self._own = np.searchsorted(owner, np.arange(n + 1))
        self._held = np.arange(n)
        common = np.flatnonzero(df > max(n // 8, 64))
        self._row = np.full(top, -1, np.int32)
        self._row[common] = np.arange(len(common))
        row = self._row[terms]
        self._dense = np.zeros((len(common), n), np.float32)
        self._dense[row[row >= 0], owner[row >= 0]] = weight[row >= 0]
        terms, owner, weight = terms[row < 0], owner[row < 0], weight[row < 0]
        order = np.argsort(terms, kind="stable")
        self._docs, self._post = owner[order], weight[order]
        self._at = np.searchsorted(terms[order], np.arange(top + 1))

    def _shrink(self, unused: np.ndarray) -> None:
        keep = unused[self._held]
        if len(keep) <= 64 or 2 * keep.sum() > len(keep):
            return
        stay = keep[self._docs]
        self._docs, self._post = (np.cumsum(keep) - 1)[self._docs[stay]].astype(np.int32), self._post[stay]
        self._at = np.append(0, np.cumsum(stay))[self._at]
        self._dense, self._held = np.ascontiguousarray(self._dense[:, keep]), self._held[keep]

    def ranking(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term, best first, ties to the earlier one; those that come far behind are only sorted when they are asked for."""
        self._shrink(unused)
        terms = self._terms[self._own[doc] : self._own[doc + 1]]
        terms = terms[self._df[terms] > 1]
        row = self._row[terms]
        rare = terms[row < 0]
        spans = [slice(s, e) for s, e in zip(self._at[rare].tolist(), self._at[rare + 1].tolist())]
        score = np.zeros(len(self._held))
        if spans:
            score += np.bincount(np.concatenate([self._docs[x] for x in spans]), np.concatenate([self._post[x] for x in spans]), len(score))
        if len(rare) < len(terms):
            has = np.zeros(len(self._dense), np.float32)
            has[row[row >= 0]] = 1
            score += has @ self._dense
        score[~unused[self._held]] = 0
        found = np.flatnonzero(score)
        first = score[found] >= np.partition(score[found], -64)[-64] if len(found) > 64 else np.ones(len(found), bool)
        for part in (found[first], found[~first]):
            yield from self._held[part[np.argsort(-score[part], kind="stable")]].tolist()

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        return np.fromiter(self.ranking(doc, unused), np.int64)


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every id of every document is in one of them."""
    start = [0] * len(docs)
    for d, ids in enumerate(docs):
        while len(ids) - start[d] >= window:
            yield [(d, start[d], window)]
            start[d] += window
    left = np.array([len(ids) - s for ids, s in zip(docs, start)], np.int64)
    unused = left > 0
    index = Index(docs)
    open_, room, seed, upto = [], window, None, 0
    ranked: Iterator[int] = iter(())

    def take(d: int) -> None:
        nonlocal room
        n = min(int(left[d]), room)
        open_.append((d, start[d], n))
        start[d] += n
        left[d] -= n
        room -= n
        unused[d] = left[d] > 0

    while True:
        nxt = next((d for d in ranked if unused[d]), None)
        if nxt is None:
            if seed is not None and unused[seed]:
                nxt = seed
            else:
                while upto < len(docs) and not unused[upto]:
                    upto += 1
                if upto == len(docs):
                    break
                nxt = upto
        if not open_:
            seed = nxt
            take(nxt)
            ranked = index.ranking(seed, unused) if room else iter(())
        else:
            take(nxt)
        if not room:
            yield open_
            seed = open_[-1][0] if unused[open_[-1][0]] else None
            open_, room, ranked = [], window, iter(())
    rest = window - room
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        part = []
        while size:
            d, s, n = open_.pop(0)
            part.append((d, s, min(n, size)))
            if n > size:
                open_.insert(0, (d, s + size, n - size))
            size -= part[-1][2]
        yield part


def _parts(b: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes in that column, or of one row."""
    ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy().astype(np.int64))
    at, before = 0, 0
    while at < b.num_rows:
        upto = max(int(np.searchsorted(ends, before + size, "right")), at + 1)
        yield b.slice(at, upto - at)
        at, before = upto, int(ends[upto - 1])


def _flat(ids: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column in a row, and where each document's begin."""
    size = sizes[0].as_py()
    at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
    return np.frombuffer(ids.buffers()[2], f"<u{size}")[at[0] // size : at[-1] // size], (at - at[0]) // size


def _terms(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, how often) of all ids of each document."""
    keys = np.repeat(np.arange(len(at) - 1, dtype=np.uint64) << np.uint64(32), np.diff(at)) if flat.itemsize > 2 else np.repeat(np.arange(len(at) - 1, dtype=np.uint32) << np.uint32(16), np.diff(at))
    bits = keys.dtype.type(4 * keys.itemsize)
    keys |= flat
    keys, tf = np.unique(keys, return_counts=True)
    return (keys >> bits).astype(np.int64), (keys & keys.dtype.type((1 << int(bits)) - 1)).astype(np.int64), tf


def _frequencies(encoded: DataFrame) -> dict[int, int]:
    """In how many documents each id is, over all of them, and under -1 how many there are; no more rows than the vocabulary has."""

    def each(batches):
        held, docs = np.zeros(0, np.int64), 0
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                own = np.bincount(_terms(*_flat(part.column(0), part.column(1)))[1], minlength=len(held))
                own[: len(held)] += held
                held, docs = own, docs + part.num_rows
        terms = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.append(terms, -1)), pa.array(np.append(held[terms], docs))], ["term", "n"])

    rows = encoded.select("ids", "size").mapInArrow(tidy(each), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r.term: r.n for r in rows}


def heaviest(flat: np.ndarray, at: np.ndarray, idf: np.ndarray) -> pa.ListArray:
    """Each document's KEY_TERMS heaviest terms, in falling order; terms of one document only have no weight and aren't among them."""
    doc, term, tf = _terms(flat, at)
    weight = (idf[term] * tf / (tf + K1)).astype(np.float32)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(32)) | (np.uint32(0xFFFFFFFF) - weight.view(np.uint32)), kind="stable")
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    use = (place < KEY_TERMS) & (weight[order] > 0)
    ends = np.append(0, np.cumsum(np.bincount(doc[use], minlength=len(at) - 1)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term[order][use], pa.int32()))


def _placed(encoded: DataFrame, parts: int) -> DataFrame:
    """Encoded documents with their places in the order (heaviest terms, then a hash) and the one of so many stretches of it that they lie in.

    The ends of stretches come from the places of a sample; every document has its place, but only once: `repartitionByRange` would weigh all terms a second time for its own sample.
    """
    df = _frequencies(encoded)
    n = df.pop(-1, 0)
    idf = np.zeros(max(df, default=0) + 1, np.float32)
    for term, own in df.items():
        idf[term] = np.log(1 + (n - own + 0.5) / (own + 0.5)) if own > 1 else 0
    sent = encoded.sparkSession.sparkContext.broadcast(idf)
    rows = encoded.select("id", "ids", "size", F.xxhash64("id", "ids").alias("hash"))

    def weighed(part: pa.RecordBatch) -> tuple[pa.ListArray, list[tuple]]:
        terms = heaviest(*_flat(part.column(1), part.column(2)), sent.value)
        return terms, list(zip(map(tuple, terms.to_pylist()), part.column(3).to_pylist()))

    def places(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                yield pa.record_batch([weighed(part)[0], part.column(3)], ["terms", "hash"])

    some = rows.sample(min(1.0, SAMPLED * parts / max(n, 1)), seed=7).mapInArrow(tidy(places), "terms array<int>, hash long").collect()
    keys = sorted((tuple(r.terms), r.hash) for r in some)
    ends = encoded.sparkSession.sparkContext.broadcast([keys[len(keys) * k // parts] for k in range(1, parts)] if keys else [])

    def each(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                terms, own = weighed(part)
                stretch = pa.array([bisect_right(ends.value, k) for k in own], pa.int32())
                yield pa.record_batch([*part.columns, terms, stretch], ["id", "ids", "size", "hash", "terms", "stretch"])

    return rows.mapInArrow(tidy(each), "id long, ids binary, size int, hash long, terms array<int>, stretch int")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end: int = END, encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset), one a piece.

    ids holds the piece's ids as little-endian unsigned 32-bit numbers. A null or empty text is its
    end id alone; a null id stays null; repeated rows are packed each for itself; an empty table
    gives an empty one; other columns are not read. Equal scores go to the row that comes first by heaviest terms
    and hash. sequence_id has the partition's number above its lowest 40 bits, so a task that is run
    again on the same rows gives the same ids.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def encoded(batches):
        encode = (encoder() if encoder else Encoder(tokenizer)).encode
        for b in batches:
            for part in _parts(b, 1, LOOKUP):
                made = encode(as_bytes(part.column(1)))
                last = made[0].dtype.type(end).tobytes()
                raw = [x.tobytes() + last for x in made]
                yield pa.record_batch([part.column(0), pa.array(raw, pa.binary()), pa.array([len(last)] * len(made), pa.int32())], ["id", "ids", "size"])

    def packed(batches):
        number = TaskContext.get().partitionId() << 40
        own: list = []
        shard: list[np.ndarray] = []
        tokens = 0

        def flush():
            nonlocal number, own, shard, tokens
            rows: list[tuple] = []
            size = 0
            for seq in pack_shard(shard, window):
                at = 0
                for d, s, n in seq:
                    rows.append((own[d], s, n, shard[d][s : s + n].astype("<u4").tobytes(), len(shard[d]), number, at))
                    at += n
                    size += n
                number += 1
                if size > 1 << 18:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
            own, shard, tokens = [], [], 0

        def batch(rows):
            cols = list(zip(*rows))
            return pa.record_batch([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols)], names)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                flat, at = _flat(part.column(1), part.column(2))
                flat = flat.copy()
                for key, s, e in zip(part.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    own.append(key)
                    shard.append(flat[s:e])
                    tokens += e - s
                    if len(shard) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                        yield from flush()
        if shard:
            yield from flush()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _placed(cut(texts.mapInArrow(tidy(encoded), "id long, ids binary, size int"), "ids"), parts)
    return rows.repartitionById(parts, F.col("stretch")).sortWithinPartitions("terms", "hash", "id").select("id", "ids", "size").mapInArrow(tidy(packed), schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
