"""Repeated byte windows by depth-limited radix passes over sparse suffixes (operator 5).

A byte goes if a window of ``WINDOW`` bytes covers it that also starts in a document
with a smaller id.  Suffixes are ordered most significant digit first and never
deeper than the window; a group of equal suffixes at that depth is one repeated
window.  Two things keep the passes small:

* *Sparse suffixes.*  Of the grams in a window, the one with the smallest hash is its
  anchor; it depends on the window's bytes alone, so equal windows have equal anchors.
  Consecutive windows of one anchor form a zone.  Only anchors (8 % of all positions)
  enter the first pass.
* *Digits.*  The first digit of a suffix is its anchor gram, the second the rest of its
  zone.  A group of one digit is finished: its windows are repeated nowhere.  Equal
  zones in several documents are finished too: all their windows are repeats, except in
  the smallest document.  Only zones that share a gram but differ (the ends of repeated
  passages) go on to the last digit: the full windows, one by one.

Digits are compared as hashes (44 bits of the first, 32 independent bits of the rest;
the same 76 bits for full windows).  Each pass is one shuffle of packed entries, dealt
to buckets by the first digit's value.  A map task sends every digit pair once, for its
smallest document, and settles its own repeats itself, so a passage that a third of
all documents share costs one entry for each task.  The ends of such a passage differ in
every document: a first digit with more than ``CROWD`` second digits in one task is known
to be shared there and then, so its zones go on to the last digit at once and only its
smallest and largest document are sent, to tell the other tasks.  Answers travel back to pages of
documents (``page``: a hash of the id), where the texts, compressed, meet them.

Memory is bounded by ``CHUNK`` bytes of text at a time; longer texts are cut into
pieces that overlap by a window less one byte, which changes zones, not windows.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches, stored
from basketlens.llm.words import slices

WINDOW = 50
#: Bytes of an anchor gram: more make fewer chance repeats, less make fewer anchors.
GRAM = 26
#: Bytes of text handled at once, and for each bucket and page; entries sent at once.
CHUNK, BUCKET_BYTES, SEND = 1 << 19, 8 << 20, 250_000
KEY_BITS, POSITION_BITS = 44, 26
#: Second digits of one first digit that a task sends.
CROWD = 16

_RNG = np.random.default_rng(987654321)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(_RNG.integers(1, 1 << 62)) * 2 + 1 for _ in range(2))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Polynomial hash modulo 2^64 of any stretch of a byte sequence in constant time."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, base: int):
        n = len(raw)
        if base not in self.powers or len(self.powers[base][0]) <= n:
            size = max(n, 1 << 16) + 1
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        up, self.down = self.powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return scramble((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


class Chunk:
    """Pieces of texts laid end to end, with their hashes."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.doc = np.array([p[0] for p in pieces], np.int64)
        self.offset = np.array([p[1] for p in pieces], np.int64)
        size = np.array([len(p[2]) for p in pieces], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.n = len(raw)
        self.h = [Hashes(raw, b) for b in _BASES]

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")

    def zones(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, last window and anchor of every zone."""
        n, width = self.n, WINDOW - GRAM + 1
        if n < WINDOW:
            none = np.zeros(0, np.int64)
            return none, none, none
        mask = np.uint64((1 << POSITION_BITS) - 1)
        gram = self.h[0].all(GRAM)
        low = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
        size = 1                                      # sliding minimum, by doubling
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[:size - width], low[width - size:])
        anchor = (low & mask).astype(np.int64)
        inside = np.zeros(len(anchor) + 1, np.int32)  # windows that don't leave their piece
        room = np.maximum(self.end - WINDOW + 1, self.begin)
        np.add.at(inside, self.begin[room > self.begin], 1)
        np.add.at(inside, room[room > self.begin], -1)
        ok = np.cumsum(inside[:-1]) > 0
        cut = np.ones(len(anchor), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        cut[self.begin[self.begin < len(cut)]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:] - 1, len(anchor) - 1)
        keep = ok[first]
        return first[keep], last[keep], anchor[first[keep]]

    def zone_digits(self, first, last, anchor) -> tuple[np.ndarray, np.ndarray]:
        key = self.h[0].of(anchor, anchor + GRAM) >> np.uint64(64 - KEY_BITS)
        rest = self.h[1].of(first, last + WINDOW) * _M1 + (anchor - first).astype(np.uint64) * _M2
        return key, (scramble(rest) >> np.uint64(32)).astype(np.uint32)

    def window_digits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.h[0].of(at, at + WINDOW) >> np.uint64(64 - KEY_BITS)
        return key, (self.h[1].of(at, at + WINDOW) >> np.uint64(32)).astype(np.uint32)


def chunks(texts: list[bytes]) -> Iterator[Chunk]:
    """Texts in parts of about ``CHUNK`` bytes; a longer text in overlapping pieces."""
    now, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), CHUNK):
            piece = t[at:at + CHUNK + WINDOW - 1]
            if size and size + len(piece) > CHUNK:
                yield Chunk(now)
                now, size = [], 0
            now.append((k, at, piece))
            size += len(piece)
    if now:
        yield Chunk(now)


def fold(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Both digits in 48 bits; enough to find them again in one document."""
    return scramble(key * _M2 + check.astype(np.uint64)) >> np.uint64(16)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes first, compressed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(planes) // sum(sizes), 0, []
    for t, s in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(planes[at:at + n * s].reshape(s, n).T).view(t).reshape(n))
        at += n * s
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


_ROW = "place long, entries binary, removed binary, edge binary, doc_id long, text binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]


def _rows(**cols: list) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols.get(c, [None] * n), t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _answers(docs: np.ndarray, folds: np.ndarray, pages: int, column: str) -> pa.RecordBatch:
    """Folds for documents as packed rows, a row for each page."""
    page = page_of(docs, pages)
    order = np.lexsort((folds, docs, page))
    page, docs, folds = page[order], docs[order], folds[order]
    cuts = np.flatnonzero(np.diff(page, prepend=-1))
    ends = np.append(cuts[1:], len(page))
    return _rows(place=page[cuts].tolist(), **{column: [
        packed(_steps(docs[a:b]), folds[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]})


def page_of(docs: np.ndarray, pages: int) -> np.ndarray:
    return (scramble(docs.astype(np.uint64)) % np.uint64(pages)).astype(np.int64)


def _sent_on(docs: np.ndarray, folds: np.ndarray, pages: int, column: str) -> pa.RecordBatch:
    """Answers found before the shuffle: their ``place`` is negative, ``-1 - page``."""
    rows = _answers(docs, folds, pages, column)
    return rows.set_column(0, "place", pa.array(-1 - rows.column(0).to_numpy()))


def _crowded(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: entries of keys with more than ``CROWD`` entries in several documents,
    and which entries stand for such a key (one of its smallest and of its largest document)."""
    at = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0)
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    crowd = (np.bincount(group) > CROWD) & (least != most)
    on = crowd[group]
    stands = np.zeros(len(key), bool)
    for end in (least, most):
        found = np.flatnonzero(on & (doc == end[group]))
        stands[found[np.unique(group[found], return_index=True)[1]]] = True
    return on, stands


def _announce(key, check, doc, buckets: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """Entries of one task's digits, and answers to the repeats among them."""
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    least = doc[new][np.cumsum(new) - 1] if len(key) else doc
    gone = doc > least
    if gone.any():
        yield _sent_on(doc[gone], fold(key[gone], check[gone]), buckets, "removed")
    key, check, doc = key[new], check[new], doc[new]
    if edges and len(key):
        on, stands = _crowded(key, doc)
        if on.any():
            yield _sent_on(doc[on], fold(key[on], check[on]), buckets, "edge")
            rest = ~on | stands
            key, check, doc = key[rest], check[rest], doc[rest]
    known, owner = np.unique(doc, return_inverse=True)
    owner = owner.astype(np.uint32)
    # anchors have the smallest hashes of their windows: dealt by size they would fill the first bucket
    bucket = scramble(key) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, key, check, owner = bucket[order], key[order], check[order], owner[order]
    cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    places, blobs = [], []
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        used, local = np.unique(owner[a:b], return_inverse=True)
        docs = packed(_steps(known[used]))
        entries = packed(_steps(key[a:b]), check[a:b], local.astype(np.uint32))
        places.append(int(bucket[a]))
        blobs.append(struct.pack("<I", len(docs)) + docs + entries)
        if len(places) == 1000:
            yield _rows(place=places, entries=blobs)
            places, blobs = [], []
    yield _rows(place=places, entries=blobs)


def _announce_all(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, edges: bool
                  ) -> Iterator[pa.RecordBatch]:
    """The digits of many chunks, announced in large parts."""
    parts, size = [], 0
    for entry in found:
        parts.append(entry)
        size += len(entry[0])
        if size >= SEND:
            yield from _announce(*map(np.concatenate, zip(*parts, strict=True)), buckets, edges)
            parts, size = [], 0
    if size:
        yield from _announce(*map(np.concatenate, zip(*parts, strict=True)), buckets, edges)


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", blob)[0]
    docs = np.cumsum(unpacked(blob[4:4 + n], "<i8")[0])
    key, check, local = unpacked(blob[4 + n:], "<u8", "<u4", "<u4")
    return np.cumsum(key, dtype=np.uint64), check, docs[local]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one place at a time, from rows in order of ``place``."""
    parts: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:]):
            if parts and parts[-1].column(0)[0].as_py() != place[a]:
                yield pa.concat_tables(parts)
                parts = []
            parts.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if parts:
        yield pa.concat_tables(parts)


def _resolve(buckets: int, edges: bool):
    """Compare a bucket's entries; answers go to the documents' pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            place = group.column(0)[0].as_py()
            if place < 0:                             # already an answer
                for column in ("removed", "edge"):
                    for x in group.column(column).drop_null().to_pylist():
                        yield _rows(place=[-1 - place], **{column: [x]})
                continue
            found = [_entries(b) for b in group.column("entries").to_pylist()]
            key, check, doc = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((doc, check, key))
            key, check, doc = key[order], check[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            gone = doc > doc[new][np.cumsum(new) - 1]
            if gone.any():
                yield _answers(doc[gone], fold(key[gone], check[gone]), buckets, "removed")
            if edges:
                key, check, doc = key[new], check[new], doc[new]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(new)
                several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                on = several[np.cumsum(new) - 1]
                if on.any():
                    yield _answers(doc[on], fold(key[on], check[on]), buckets, "edge")
    return run


def _first_digits(buckets: int):
    def digits(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0).to_numpy()
            for chunk in chunks([t or b"" for t in batch.column(1).to_pylist()]):
                zones = chunk.zones()
                yield *chunk.zone_digits(*zones), ids[chunk.doc[chunk.piece(zones[0])]]

    return lambda batches: _announce_all(digits(batches), buckets, True)


class Page:
    """The documents of a page with the answers that reached it."""

    def __init__(self, group: pa.Table):
        own = group.filter(group.column("text").is_valid())
        self.ids = own.column("doc_id").to_pylist()
        opened = zstandard.ZstdDecompressor()
        self.texts = [opened.decompress(z) for z in own.column("text").to_pylist()]
        self.answers = {c: self._read(group.column(c)) for c in ("removed", "edge")}

    def _read(self, column) -> np.ndarray:
        parts = []
        for blob in column.drop_null().to_pylist():
            docs, folds = unpacked(blob, "<i8", "<u8")
            parts.append(_mark(np.cumsum(docs), folds))
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def hit(self, column: str, doc: np.ndarray, folds: np.ndarray) -> np.ndarray:
        """Which of the folds were answered for their documents; NULL ids never are."""
        number = np.array([0 if i is None else i for i in self.ids], np.int64)
        known = np.array([i is not None for i in self.ids], bool)
        answers, marks = self.answers[column], _mark(number[doc], folds)
        if not len(answers):
            return np.zeros(len(doc), bool)
        at = np.minimum(np.searchsorted(answers, marks), len(answers) - 1)
        return known[doc] & (answers[at] == marks)

    def edge_windows(self, chunk: Chunk, first, last, doc, folds) -> tuple[np.ndarray, np.ndarray]:
        """All windows of the zones that share their gram with other zones, and their documents."""
        on = self.hit("edge", doc, folds)
        size = (last - first + 1)[on]
        at = np.repeat(first[on] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return at, np.repeat(doc[on], size)


def _mark(docs: np.ndarray, folds: np.ndarray) -> np.ndarray:
    return scramble(scramble(docs.astype(np.uint64)) + folds)


def _last_digits(buckets: int):
    """All windows of the zones that share their gram with other zones."""
    def digits(batches: Iterator[pa.RecordBatch]):
        for group in _groups(batches):
            page = Page(group)
            if not len(page.answers["edge"]):
                continue
            ids = np.array([0 if i is None else i for i in page.ids], np.int64)
            for chunk in chunks(page.texts):
                zones = chunk.zones()
                doc = chunk.doc[chunk.piece(zones[0])]
                at, doc = page.edge_windows(chunk, *zones[:2], doc, fold(*chunk.zone_digits(*zones)))
                yield *chunk.window_digits(at), ids[doc]

    return lambda batches: _announce_all(digits(batches), buckets, False)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the repeated windows' bytes: the answers to zones and to windows decide."""
    for group in _groups(batches):
        page = Page(group)
        change = [np.zeros(len(t) + 1, np.int32) for t in page.texts]
        if len(page.answers["removed"]):
            for chunk in chunks(page.texts):
                first, last, anchor = chunk.zones()
                doc = chunk.doc[chunk.piece(first)]
                folds = fold(*chunk.zone_digits(first, last, anchor))
                at, owner = page.edge_windows(chunk, first, last, doc, folds)
                at = at[page.hit("removed", owner, fold(*chunk.window_digits(at)))]
                on = page.hit("removed", doc, folds)
                first, last = np.concatenate([first[on], at]), np.concatenate([last[on], at])
                piece = chunk.piece(first)
                shift = chunk.offset[piece] - chunk.begin[piece]
                for d, a, b in zip(chunk.doc[piece].tolist(), (first + shift).tolist(),
                                   (last + shift + WINDOW).tolist(), strict=True):
                    change[d][a] += 1
                    change[d][b] -= 1
        kept, spans = [], []
        for text, c in zip(page.texts, change, strict=True):
            gone = np.cumsum(c[:-1]) > 0
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if spans[-1] else text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(page.ids, pa.int64()), pa.array([len(t) for t in page.texts], pa.int64()),
             pa.array([len(t) - len(k) for t, k in zip(page.texts, kept, strict=True)], pa.int64()),
             pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _shrink(pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            write = zstandard.ZstdCompressor(level=3)
            ids = batch.column(0)
            place = page_of(ids.fill_null(0).to_numpy(), pages)
            yield _rows(place=place.tolist(), doc_id=ids.to_pylist(),
                        text=[write.compress(t or b"") for t in batch.column(1).to_pylist()])
    return run


def _dealt(rows: DataFrame, run: Callable, parts: int, schema: str) -> DataFrame:
    return map_batches(rows.repartition(parts, "place").sortWithinPartitions("place"), run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: every row without its repeated windows.

    A byte of a text's UTF-8 form is removed when it lies in a string of ``WINDOW`` bytes
    that also starts in a row with a smaller ``doc_id``; matches never cross texts and
    are judged on the input.  ``kept`` holds the other bytes, ``n_spans`` counts maximal
    removed runs.  Ids are whole numbers.  NULL texts are empty; texts shorter than the
    window lose nothing; rows of equal ids don't remove each other's bytes; rows with a
    NULL id neither lose bytes nor make others lose any.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    first = map_batches(texts.where("doc_id IS NOT NULL"), _first_digits(buckets), _ROW)
    zones = stored(_dealt(first, _resolve(buckets, True), parts, _ROW), "repeat_zones")

    paged = map_batches(texts, _shrink(buckets), _ROW)
    last = _dealt(paged.unionByName(zones.where("edge IS NOT NULL")), _last_digits(buckets), parts, _ROW)
    windows = _dealt(last, _resolve(buckets, False), parts, _ROW)
    return _dealt(paged.unionByName(zones).unionByName(windows), _cut_out, parts,
                  "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """Counts and the digest of what is kept, one row per document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))
