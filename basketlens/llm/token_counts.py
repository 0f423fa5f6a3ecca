"""Token counts by a count-only Viterbi (operator 1).

How many pieces a unigram tokenizer would cut a text into, without building them.
An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming
keeps, for every position, the best score so far and the number of pieces of that
best segmentation.  Nothing else is stored: no lattice, no back pointers.

The rules of the ``tokenizers`` library's Unigram model hold exactly: spaces are written as U+2581 with one put in
front; a character that no one-character piece covers costs the lowest score less
ten and counts one piece for each of its UTF-8 bytes (byte fallback); of equal
scores the segmentation whose last piece starts earlier wins, as the library visits
starts in ascending order and replaces only on a strictly better score.  (The
sentencepiece library sums in 32-bit floats, which rounds long sums; doubles don't.)

If no piece has U+2581 behind another character, no piece crosses from a word to the
space after it; then the best segmentation of a text is that of its words (with the
spaces before them), and words' counts are memoised.  The vocabulary is tested for
this; otherwise whole texts are segmented.  Scores are summed as doubles, which is
exact for whole-number scores, so the split changes no tie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from basketlens.llm.common import Memo, map_batches
from basketlens.llm.words import slices

SPACE = "▁"
#: What an uncovered character costs below the lowest score: fixed value.
UNKNOWN_PENALTY = 10.0
PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


class Unigram:
    """Pieces and scores, ready to count."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), float(score)))
        if scores:
            self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self.memo: Memo = Memo()                     # word -> pieces

    def best(self, text: str) -> int:
        """Pieces of the best segmentation of a text with its spaces already written."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done, single, unknown = 0, self.single, self.unknown

        def uncovered(upto: int) -> None:
            # positions where no match ends can only be reached over an unknown character
            for e in range(done + 1, upto):
                c = text[e - 1]
                score[e] = score[e - 1] + unknown
                count[e] = count[e - 1] + len(c.encode())

        open_end, top, k = 0, 0.0, 0
        for last, (length, s) in self.automaton.iter(text) if len(self.automaton) else ():
            end = last + 1
            if end != open_end:
                if open_end:
                    score[open_end], count[open_end] = self._close(text, open_end, top, k, score, count)
                    done = open_end
                uncovered(end)
                open_end = end
                top, k = score[end - length] + s, count[end - length] + 1
            else:                                # longer matches, earlier starts, come first
                v = score[end - length] + s
                if v > top:
                    top, k = v, count[end - length] + 1
        if open_end:
            score[open_end], count[open_end] = self._close(text, open_end, top, k, score, count)
            done = open_end
        uncovered(n + 1)
        return count[n]

    def _close(self, text, end, top, k, score, count):
        """The end's best, once the unknown character is compared: its start is the latest."""
        c = text[end - 1]
        if c not in self.single and score[end - 1] + self.unknown > top:
            return score[end - 1] + self.unknown, count[end - 1] + len(c.encode())
        return top, k

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.best(text)
        memo, total = self.memo, 0
        for part in PARTS(text):
            n = memo.get(part)
            if n is None:
                n = self.best(part)
                if len(part) <= 64:
                    memo.put(part, n)
            total += n
        return total


def read_pieces(path: str) -> dict[str, float]:
    """Scored pieces of a sentencepiece model; control, byte, unknown and unused ones don't match text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """Built once in each Python worker."""
    return Unigram(read_pieces(path))


def count(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens)``: pieces of every whole text.

    ``path`` is a sentencepiece model file, readable on every executor; its scored
    pieces are taken as a unigram vocabulary.  NULL and empty texts have 0 tokens.  A
    row out for each row in, with repeated and NULL ids; other columns are not read.
    No shuffle; a worker holds the vocabulary, one batch and the bounded memo.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in (part for whole in batches for part in slices(whole)):
            n = [model.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_tokens long")
