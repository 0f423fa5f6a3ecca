"""Substring dedup by seed and extend (operator 11).

A word goes if a window of ``WINDOW`` words covers it that also starts in a document with
a smaller id.

* *Seeds.*  Of the grams of ``GRAM`` words in a window, the one with the smallest hash is
  the window's anchor (winnowing).  It depends on the window alone, so documents that
  share a window share its anchor.  About one word in five starts an anchor.
* *Join.*  Documents meet on their anchors: those that only one document has are left
  behind first, by their smallest and largest document.
* *Extend.*  Left and right of a shared anchor lie the windows that it anchors, its zone.
  Zones that are equal as a whole extend each other to both ends at once: every document
  but the smallest is matched.  Where an anchor has several zones (the ends of shared
  passages, chance repeats of the gram) one document of each extends its anchor word by
  word: ``o`` words to the left and the rest of the window to the right, for every ``o`` of
  the zone; extensions that reach the window's length are compared by hash with those of
  all other zones.  No pair of documents is ever formed.
* *Keep.*  Matched windows that touch or overlap are one maximal repeat.

A common passage costs one partially aggregated row for each task where documents are
counted, and joins whose large side Spark may split where answers return.  Anchors and
zones are compared by hashes of 64 and 32 bits together, single windows by 64 and 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches, stored
from basketlens.llm.words import slices

WINDOW, GRAM = 13, 5
#: Bytes of text whose characters are hashed at once.
PIECE = 1 << 20

_RNG = np.random.default_rng(20250211)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(x) * 2 + 1 for x in _RNG.integers(1, 1 << 62, 3))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Stretches:
    """Hashes of any stretch of a sequence of numbers: polynomials modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = self._powers.get(base, (values[:0], values[:0]))
        if len(up) <= n:
            steps = np.full((2, max(n + 1, PIECE)), base, np.uint64)
            steps[1] = pow(base, -1, 1 << 64)
            steps[:, 0] = 1
            up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
            if len(up) == PIECE:                      # longer tables go with their text
                self._powers[base] = up, self.down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, one after the other, and the texts' word offsets."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    gap = _SEPARATOR[raw]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE - 1)))
        a, b = start[at], end[to - 1]
        out[at:to] = Stretches(_BYTE[raw[a:b]], _BASES[0]).of(start[at:to] - a, end[at:to] - a)
        at = to
    length = np.array([len(t) + 1 for t in texts], np.int64)
    return out, np.searchsorted(start, np.concatenate([[0], np.cumsum(length)]) + 1)


class Seeds:
    """Zones of texts: a zone is a stretch of windows ``first`` to ``last`` with one anchor."""

    def __init__(self, texts: list[bytes]):
        words, self.offsets = word_hashes(texts)
        n, width = len(words), WINDOW - GRAM + 1
        self.hashes = [Stretches(words, b) for b in _BASES[1:]]
        text = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        if n < WINDOW:
            self.first = self.last = self.text = np.zeros(0, np.int64)
            self.gram, self.zone = np.zeros(0, np.int64), np.zeros(0, np.int32)
            return
        at = np.arange(n - GRAM + 1)
        gram = self.hashes[0].of(at, at + GRAM)
        least, anchor, size = gram, at, 1             # sliding minimum by doubling, leftmost of equals
        while size < width:
            step = min(size, width - size)
            right = least[step:] < least[:-step]
            anchor = np.where(right, anchor[step:], anchor[:-step])
            least = np.where(right, least[step:], least[:-step])
            size += step
        inside = text[:len(anchor)] == text[WINDOW - 1:]
        cut = np.ones(len(anchor), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (text[1:len(anchor)] != text[:len(anchor) - 1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(anchor)) - 1
        keep = inside[first]
        self.first, self.last = first[keep], last[keep]
        self.text = text[self.first]
        self.gram = gram[anchor[self.first]].view(np.int64)
        whole = self.hashes[1].of(self.first, self.last + WINDOW)
        shift = (anchor[self.first] - self.first).astype(np.uint64)
        self.zone = (_mix(whole + shift) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def marks(self) -> np.ndarray:
        """What names a zone inside its document, as :func:`_mark` does."""
        return self.gram ^ (self.zone.astype(np.int64) << 32)

    def windows(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of some zones: position, text, hash and check."""
        size = (self.last - self.first + 1)[on]
        at = np.repeat(self.first[on] - np.cumsum(size) + size, size) + np.arange(size.sum())
        check = self.hashes[1].of(at, at + WINDOW) >> np.uint64(32)
        return (at, np.repeat(self.text[on], size), self.hashes[0].of(at, at + WINDOW).view(np.int64),
                check.astype(np.uint32).view(np.int32))


def _mark():
    return F.col("gram").bitwiseXOR(F.shiftleft(F.col("zone").cast("long"), 32))


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(gram, zone, doc_id)`` of every zone."""
    for batch in (part for whole in batches for part in slices(whole)):
        s = Seeds(_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.gram), pa.array(s.zone), batch.column(0).take(pa.array(s.text))], ["gram", "zone", "doc_id"])


def _marked(s: Seeds, marks: pa.Array) -> np.ndarray:
    """Which zones (or windows) are named by their document's list of marks."""
    own = np.repeat(np.arange(len(marks)), np.diff(np.asarray(marks.offsets)))
    known = np.asarray(marks.flatten())
    order = np.lexsort((known, own))
    return own[order], known[order]


def _found(text: np.ndarray, value: np.ndarray, own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether ``(text, value)`` is among the pairs ``(own, known)``."""
    if not len(known):
        return np.zeros(len(text), bool)
    every, number = np.unique(np.concatenate([known, value]), return_inverse=True)
    pair = own * len(every) + number[:len(known)]
    return np.isin(text * len(every) + number[len(known):], pair)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(hash, check, doc_id)`` of the windows in the zones that a document is asked for."""
    for batch in (part for whole in batches for part in slices(whole)):
        s = Seeds(_bytes(batch.column(1)))
        on = _found(s.text, s.marks(), *_marked(s, batch.column(2)))
        _, text, value, check = s.windows(on)
        yield pa.RecordBatch.from_arrays(
            [pa.array(value), pa.array(check), batch.column(0).take(pa.array(text))], ["hash", "check", "doc_id"])


_KEPT = "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of matched zones and windows."""
    for batch in (part for whole in batches for part in slices(whole)):
        texts = _bytes(batch.column(1))
        touched = [k for k, (z, w) in enumerate(zip(batch.column(2), batch.column(3), strict=True))
                   if z.is_valid and (len(z) or len(w))]
        gone: dict[int, np.ndarray] = {}
        if touched:
            s = Seeds([texts[k] for k in touched])
            some = pa.array(touched)
            zones = _found(s.text, s.marks(), *_marked(s, batch.column(2).take(some)))
            at, text, value, _ = s.windows(~zones)
            at = at[_found(text, value, *_marked(s, batch.column(3).take(some)))]
            change = np.zeros(s.offsets[-1] + 1, np.int64)
            np.add.at(change, np.concatenate([s.first[zones], at]), 1)
            np.add.at(change, np.concatenate([s.last[zones], at]) + WINDOW, -1)
            covered = np.cumsum(change) > 0
            gone = {k: covered[a:b] for k, a, b in zip(touched, s.offsets, s.offsets[1:])}
        n_words, n_removed, runs, kept = [], [], [], []
        for k, text in enumerate(texts):
            words, out = text.split(), gone.get(k)
            n_words.append(len(words))
            if out is None or not out.any():
                n_removed.append(0)
                runs.append([])
            else:
                n_removed.append(int(out.sum()))
                edge = np.flatnonzero(np.diff(out, prepend=False, append=False)).reshape(-1, 2).tolist()
                runs.append([{"start": a, "end": b} for a, b in edge])
                words = [words[i] for i in np.flatnonzero(~out).tolist()]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(runs, _RUNS), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "repeats", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, repeats, kept)``: every row without its repeated windows.

    Words are runs of anything but ASCII white space, as they stand.  A word is removed
    when a window of ``WINDOW`` words of its text covers it that also starts in a row with
    a smaller ``doc_id``; windows are judged on the input.  ``repeats`` lists the maximal
    removed runs (word numbers, end exclusive), ``kept`` the other words with one space
    between.  Ids are whole numbers.  NULL, empty and blank texts have no words; shorter
    texts than a window lose none; rows of equal ids don't remove each other's words; rows
    with a NULL id neither lose words nor make others lose any.  Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = texts.where("doc_id IS NOT NULL")
    seeds = map_batches(named, _seeds, "gram long, zone int, doc_id long")
    several = F.col("least") < F.col("most")

    def spread(rows: DataFrame, by: list[str], doc: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min(doc).alias("least"), F.max(doc).alias("most"))

    shared = stored(spread(seeds, ["gram"], "doc_id").where(several).select("gram"), "seed_shared")
    met = stored(seeds.join(shared, "gram"), "seed_met")
    zones = stored(spread(met, ["gram", "zone"], "doc_id").select("gram", "zone", "least"), "seed_zones")
    matched = met.join(zones, ["gram", "zone"]).where(F.col("doc_id") > F.col("least")) \
        .select("doc_id", _mark().alias("zone_mark"))
    # anchors whose zones start in different documents: one document of each zone goes on
    open_grams = spread(zones, ["gram"], "least").where(several).select("gram")
    asked = zones.join(open_grams, "gram").groupBy(F.col("least").alias("doc_id")) \
        .agg(F.collect_set(_mark()).alias("asked"))
    windows = stored(map_batches(named.join(asked, "doc_id").select("doc_id", "text", "asked"), _windows,
                                 "hash long, check int, doc_id long"), "seed_windows")
    # written, so that both sides of the join are shuffled for it and a hot window can be split
    first = stored(spread(windows, ["hash", "check"], "doc_id").where(several).select("hash", "check", "least"), "seed_first")
    extended = windows.join(first, ["hash", "check"]).where(F.col("doc_id") > F.col("least")) \
        .select("doc_id", F.col("hash").alias("window_mark"))
    marks = matched.unionByName(extended, allowMissingColumns=True).groupBy("doc_id") \
        .agg(F.collect_set("zone_mark").alias("zone_marks"), F.collect_set("window_mark").alias("window_marks"))
    found = named.join(marks, "doc_id", "left").select("doc_id", "text", "zone_marks", "window_marks")
    none = F.lit(None).cast("array<bigint>")
    nameless = texts.where("doc_id IS NULL").select("doc_id", "text", none.alias("zone_marks"), none.alias("window_marks"))
    return map_batches(found.unionByName(nameless), _cut, _KEPT)


def report(docs: DataFrame) -> DataFrame:
    """Counts and the digest of what is kept, one row per document."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
w AS (SELECT rid, doc_id, unnest(generate_series(1, len(ws))) AS pos, ws FROM d),
x AS (
  SELECT rid, doc_id, pos, ws[pos] AS word,
         CASE WHEN pos + {WINDOW - 1} <= len(ws) THEN array_to_string(ws[pos:pos + {WINDOW - 1}], ' ') END AS win
  FROM w),
f AS (SELECT win, min(doc_id) AS least FROM x WHERE win IS NOT NULL GROUP BY win),
g AS (
  SELECT rid, pos, word, max(CASE WHEN f.least < x.doc_id THEN 1 ELSE 0 END)
         OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM x LEFT JOIN f USING (win)),
k AS (
  SELECT rid, CAST(sum(gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS kept
  FROM g GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
