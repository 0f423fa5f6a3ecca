"""Words of whole Arrow batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that, with the space, separates words: fixed values.
SEPARATORS = ("\n", "\t", "\r", "\x0b", "\x0c")
#: Bytes of text handled at once.
CHUNK_BYTES = 3 << 20


@dataclass
class Tokens:
    """Tokens of many texts in one row: text number, offsets in code points, word form number."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    words: list[str]
    first: np.ndarray = field(init=False)        # True where a text begins

    def __post_init__(self):
        self.first = np.ones(len(self.text), bool)
        self.first[1:] = self.text[1:] != self.text[:-1]


def tokenize(texts: pa.Array) -> Tokens:
    """Split at single white-space characters, so that offsets follow from token lengths."""
    flat = pc.fill_null(texts, "")
    for c in SEPARATORS:
        flat = pc.replace_substring(flat, c, " ")
    parts = pc.split_pattern(flat, " ")
    counts = np.diff(np.asarray(parts.offsets))
    tokens = parts.flatten()
    length = np.asarray(pc.utf8_length(tokens)).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    end = np.cumsum(length + 1) - 1
    text_start = np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    text_start[1:] = np.concatenate([[0], end + 1])[ends[:-1]]
    end = end - text_start[owner]
    enc = tokens.dictionary_encode()
    keep = length > 0
    return Tokens(owner[keep], (end - length)[keep], end[keep], np.asarray(enc.indices)[keep],
                  enc.dictionary.to_pylist())


def slices(batch: pa.RecordBatch, column: int = 1, chunk: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``chunk`` bytes of text (``column``) each."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(size) // chunk
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        yield batch.slice(rows[0], len(rows))
