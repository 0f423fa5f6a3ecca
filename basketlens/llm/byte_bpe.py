"""Byte-level BPE encoding and decoding (operator 4).

Exact BPE in linear time without a merge queue.  A text is cut by the
tokenizer's pattern; every match is encoded on its own:

* bytes are mapped to Latin-1 code points, so that one Aho-Corasick automaton
  over the whole vocabulary (pyahocorasick works on strings) finds the longest
  token that starts at each byte in a single pass;
* encoding goes left to right and takes the longest token that is *compatible*
  with the one before.  Two adjacent tokens are compatible when byte-pair merging
  of their joined bytes gives exactly these two tokens; a sequence whose adjacent
  tokens are all compatible is the merge result.  The test walks the tokens' own
  last merges and is memoised per pair;
* when no token fits, the last one is taken back and the byte position marked as
  a dead end, so each position is left at most once: linear time, also for a
  match of 100,000 letters.

Texts are independent rows: no shuffle, bounded memory (one Arrow batch plus
memo tables of a fixed number of bytes).
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import Memo, map_batches
from basketlens.llm.words import slices


#: Bytes of the two memo tables of a Python worker.
MEMO_PIECES, MEMO_PAIRS = 64 << 20, 32 << 20


class Vocabulary:
    """Ranks of a byte-level BPE, with the tables that encoding needs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.length = [len(b) for b in self.bytes_of]
        self.longest = max(self.length, default=0)
        self.automaton = ahocorasick.Automaton()
        for raw, rank in ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [self._prefix_token(b) for b in self.bytes_of]
        self.compatible: Memo = Memo(MEMO_PAIRS)     # pair of tokens -> bool
        self.pieces: Memo = Memo(MEMO_PIECES)        # match of the pattern -> packed ids
        self._learn_merges()
        self.compatible.clear()
        self.split_any = regex.compile(pattern).findall
        self.split_latin = latin_pattern(pattern).findall

    def _prefix_token(self, raw: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        for n in range(len(raw) - 1, 0, -1):
            if (r := self.ranks.get(raw[:n])) is not None:
                return r
        return -1

    def _learn_merges(self) -> None:
        """For each token the pair of its last merge; single bytes are their own pair."""
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        for rank, raw in enumerate(self.bytes_of):
            a = self.shorter[rank] if raw else -1
            while a >= 0:
                b = self.ranks.get(raw[self.length[a]:])
                if a < rank and b is not None and b < rank and self._stays_apart(a, b):
                    self.merged[a, b] = rank
                    self.left[rank], self.right[rank] = a, b
                    break
                a = self.shorter[a]

    def _stays_apart(self, a: int, b: int) -> bool:
        """True if merging the bytes of ``a`` and ``b`` together ends with exactly ``[a, b]``.

        Undo the later of the two tokens' last merges step by step.  A merge across
        the seam would have come first if its rank is below the merge undone last
        (at equal rank the leftmost merge wins, hence the bound of ``b + 1``).
        """
        bound = self.size + 1
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    bound, inner = a, self.right[a]
                    if inner != a:
                        a = inner
                        break
                else:
                    bound, inner = b + 1, self.left[b]
                    if inner != b:
                        b = inner
                        break
                undo_left = not undo_left
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge result may hold ``a`` directly before ``b``; memoised."""
        return self.compatible.put(a * self.size + b, self._stays_apart(a, b))

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, size, length, shorter = len(raw), self.size, self.length, self.shorter
        known, fits = self.compatible.get, self.fits
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - length[token]] = token       # ends ascend: the longest stays
        dead: set[int] = set()
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = known(last * size + token)
                    if fit or fit is None and fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, longest[end]
            elif last < 0:
                raise ValueError(f"the vocabulary has no token for byte {raw[at]}")
            else:
                dead.add(at)
                out.pop()
                at, token = at - length[last], shorter[last]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        try:
            text.encode("latin-1")
            found = self.split_latin(text)
        except UnicodeEncodeError:
            found = self.split_any(text)
        pieces, parts = self.pieces, []
        for p in found:
            ids = pieces.get(p)
            if ids is None:
                ids = pack(self.merge(p.encode()))
                if len(p) <= 64:
                    pieces.put(p, ids)
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids written as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def latin_pattern(pattern: str) -> re.Pattern:
    r"""The pattern for texts of Latin-1 characters only, with explicit classes.

    ``\p{L}``, ``\p{N}``, ``\s`` are replaced by the characters below 256 that
    they match, which lets the standard library's faster matcher run it.
    """
    import regex

    def members(cls: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if regex.match(cls, chr(c)))

    classes = {c: members(c) for c in set(regex.findall(r"\\p\{\w+\}|\\s", pattern))}
    space = members(r"\s")
    out, in_set = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part in classes:
            out.append(classes[part] if in_set else f"[{classes[part]}]")
        elif part == r"\S":
            out.append(f"[^{space}]")
        else:
            in_set = part == "[" or (in_set and part != "]")
            out.append(part)
    return re.compile("".join(out))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The tables of one tokenizer; built once in each Python worker."""
    return Vocabulary(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
           text_col: str = "text", with_decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode whole texts: ``(id_col, ids)``, with ``decoded`` if asked for.

    ``ids`` is binary, the token ids as little-endian unsigned 32-bit integers (the
    usual form of token files); ``decoded`` holds the bytes that those ids decode
    to; ``keep`` names columns to carry along.  ``path`` is the rank file, readable on every executor; special tokens are
    ordinary text.  A NULL text counts as empty and gives zero ids; ids may be NULL
    or repeat (a row out for each row in); other columns of ``docs`` are not read;
    an empty table gives an empty table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in (part for whole in batches for part in slices(whole)):
            ids = [vocab.encode(t or "") for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), *batch.columns[2:], pa.array(ids, pa.binary())]
            if with_decoded:
                cols.append(pa.array([vocab.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names[:len(cols)])

    names = [id_col, *keep, "ids", "decoded"]
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"`{id_col}` {id_type}{kept}, ids binary" + ", decoded binary" * with_decoded
    # a kept text goes in a second time, under its own place
    return map_batches(docs.select(id_col, F.col(text_col).alias("_text"), *keep), run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """Decode ``ids`` as written by :func:`encode`: ``(id_col, decoded)``.  NULL ids give NULL."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            raw = [None if i is None else vocab.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())],
                                             [id_col, "decoded"])

    return map_batches(encoded.select(id_col, "ids"), run, f"`{id_col}` {id_type}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of ids and round trip, one row per document."""
    both = encode(docs, path, pattern, with_decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
