"""Personal data with offset-preserving deobfuscation (operator 6).

Four kinds (email, ip, card, phone) are found twice: in the text as it stands (the
*base* spans), and in a normalised copy, whose hits are mapped back to the source
characters.  The copy is made by two transducers, each of which keeps a map from
its output to its input:

* characters: look-alike letters, wide and circled forms, other scripts' digits,
  special hyphens, dots and spaces become ASCII; invisible characters go;
* words: ``[at]`` / ``(dot)`` / ``name at host dot com`` / entities become ``@``
  and ``.``; spelled digits (``five``, ``double two``, ``plus``) become digits.

Only changed stretches get map entries, so an undisguised text costs a few
searches.  All matching is linear in the text's length.  Every text is a row of
its own: no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches
from basketlens.llm.words import slices

KINDS = ("email", "ip", "card", "phone")

# --- the base rules: fixed values ------------------------------------------------
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# --- look-alikes: fixed values ---------------------------------------------------
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν" + "ıɡℓ",
    "ABESIJKMHOPCTXYaesijopcxydqwh" + "ABEZHIKMNOPTYXoaiv" + "igl", strict=True))
HYPHENS = "‐‑‒–—―−﹣"
DOTS = "․。｡·•∙⋅"
SPACES = "               　"
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮" \
            "⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
               "six": "6", "seven": "7", "eight": "8", "nine": "9"}
REPEATS = {"double": 2, "triple": 3}

_W = r"(?:(?:double|triple)[ -])?(?:" + "|".join(DIGIT_WORDS) + r")"
_OPEN, _SHUT = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
#: Alternatives of the word transducer; the group's name says what comes out.
WORDS = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}(?:at|@){_SHUT}\s{{0,3}}|&#0*64;|&#x0*40;|&commat;)"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}(?:dot|\.){_SHUT}\s{{0,3}}|&#0*46;|&#x0*2e;|&period;)"
    rf"|(?P<worded>(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9._%+-]{{1,64}}\s{{1,3}}dot\s{{1,3}}){{0,3}}[A-Za-z0-9._%+-]{{1,64}}(?:\s{{1,3}}at\s{{1,3}}|\s{{0,3}}@\s{{0,3}})"
    rf"[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})*(?:(?:\s{{1,3}}dot\s{{1,3}}|\s{{1,3}}\.\s{{1,3}})[A-Za-z0-9-]{{1,63}})+)"
    rf"|(?P<handle>(?<![A-Za-z0-9._%+-])(?=[A-Za-z-]*[0-9._%+])[A-Za-z0-9._%+-]{{2,64}}\s{{1,3}}at\s{{1,3}}"
    rf"[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})+)"
    rf"|(?P<spelled>(?<![A-Za-z0-9])(?:plus[ -])?(?:{_W}|[0-9]+)(?:(?:[ ,.()-]{{1,3}}|[ ]dot[ ])(?:{_W}|[0-9]+)(?![A-Za-z0-9]))+)",
    re.IGNORECASE | re.ASCII)
BRACKETED = re.compile(rf"{_OPEN}(?:at|dot|@|\.)\s{{0,3}}[\])}}>]", re.IGNORECASE | re.ASCII)
JOINED_DOT = re.compile(r"\.[A-Za-z0-9-]")
HANDLE_AT = re.compile(r"\sat\s{1,3}[a-z0-9-]{1,63}\.[a-z0-9-]", re.IGNORECASE | re.ASCII)
LONE_DOT = re.compile(r"\.(?<=\s\.)\s", re.ASCII)
LONE_DOT_WORD = re.compile(r"\sdot\s", re.ASCII)
_GAP = r"(?:[ ,.()-]{1,3}|[ ]dot[ ])"
PAIR = re.compile(rf"{_W}{_GAP}(?:{_W}|[0-9])|[0-9]{_GAP}{_W}", re.IGNORECASE | re.ASCII)
#: Characters to either side of a digit word that hold all of a pair it is part of.
PAIR_REACH = 24
ASCII_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
AT = re.compile(r"\s+at\s+|\s*@\s*", re.IGNORECASE | re.ASCII)
DOT = re.compile(r"\s+dot\s+|\s+\.\s+", re.IGNORECASE | re.ASCII)
WORD_COMMA = re.compile(r"(?<=[a-z]),[ ]?(?=[a-z])", re.IGNORECASE | re.ASCII)
SPELLED = re.compile(rf"(?P<plus>plus[ -])|(?P<dot> dot )|(?P<word>{_W})|(?P<gap>[ -])|(?P<rest>[0-9]+|.)",
                     re.IGNORECASE | re.ASCII)


@lru_cache(maxsize=4096)
def plain_char(c: str) -> str | None:
    """What the character transducer writes for ``c``; None if it stays."""
    if c < "\x80":
        return None
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    for group, out in ((INVISIBLE, ""), (HYPHENS, "-"), (DOTS, "."), (SPACES, " ")):
        if c in group:
            return out
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    flat = unicodedata.normalize("NFKC", c)
    return flat if flat != c and flat.isascii() and flat.isprintable() and len(flat) == 1 else None


class Traced:
    """A rewritten string with the stretches that changed, to map spans back."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []      # out start, out end, in start, in end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """A new string with input stretches replaced; edits ascend and don't overlap."""
        parts, out, at = [], 0, 0
        new = Traced("")
        for start, end, to in edits:
            parts += [self.text[at:start], to]
            out += start - at
            new.edits.append((out, out + len(to), start, end))
            out, at = out + len(to), end
        new.text = "".join([*parts, self.text[at:]])
        new.starts = [e[0] for e in new.edits]
        return new

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The input span behind an output span, and whether any of it was changed."""
        touched = False
        k = bisect_right(self.starts, start) - 1
        lo = start
        while k >= 0 and self.edits[k][1] <= start:
            # an edit that ends at or before the span: shift by what it grew or shrank
            lo = start - self.edits[k][1] + self.edits[k][3]
            break
        else:
            if k >= 0:
                lo, touched = self.edits[k][2], True
        j = bisect_right(self.starts, end - 1) - 1
        hi = end
        if j >= 0:
            if self.edits[j][1] <= end - 1 or self.edits[j][0] == self.edits[j][1]:
                hi = end - self.edits[j][1] + self.edits[j][3]
            else:
                hi = self.edits[j][3]
        return lo, hi, touched or j > k or (j == k >= 0 and self.edits[j][1] > start)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the base rules, by kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _plain_number(run: str) -> str | None:
    """A run of spelled and written digits as digits; None if nothing is spelled in it, be it
    a digit or a dot."""
    out, spelled, last = [], False, ""
    tokens = list(SPELLED.finditer(WORD_COMMA.sub(" ", run)))
    for k, m in enumerate(tokens):
        kind, s = m.lastgroup, m.group().lower()
        if kind == "plus":
            out.append("+")
        elif kind == "dot":
            spelled = True
            out.append(".")
        elif kind == "word":
            spelled = True
            *times, word = re.split("[ -]", s)
            out.append(DIGIT_WORDS[word] * (REPEATS[times[0]] if times else 1))
        elif kind == "gap" and last == "word" and k + 1 < len(tokens) and tokens[k + 1].lastgroup == "word":
            pass                                # "one nine two" is one number
        else:
            out.append(s)
        last = kind
    return "".join(out) if spelled else None


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in WORDS.finditer(text):
        start, end = m.span()
        if m.lastgroup in ("at", "dot"):
            edits.append((start, end, "@" if m.lastgroup == "at" else "."))
        elif m.lastgroup == "spelled":
            if (to := _plain_number(m.group())) is not None:
                edits.append((start, end, to))
        else:                                   # only the disguised joints change
            at = AT.search(text, start, end)
            joints = [(at.start(), at.end(), "@")] if at.group() != "@" else []
            if m.lastgroup == "worded":
                joints += [(j.start(), j.end(), ".") for j in DOT.finditer(text, start, end) if not at.start() < j.end() <= at.end()]
            edits += sorted(joints)
    return edits


def all_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind number, start, end, base)`` of a text, by kind, start, end."""
    base = base_spans(text)
    steps, now = [], Traced(text)
    if not text.isascii():
        edits = [(i, i + 1, p) for i, c in enumerate(text) if c > "\x7f" and (p := plain_char(c)) is not None] \
            if _has_foreign(text) else []
        if edits:
            now = now.rewrite(edits)
            steps.append(now)
    if may_be_disguised(now.text):
        edits = _word_edits(now.text)
        if edits:
            now = now.rewrite(edits)
            steps.append(now)
    found = [(*s, True) for s in base]
    if steps:
        taken = set(base)
        starts, ends = [], []                   # base spans of a kind ascend and don't overlap
        for k in range(len(KINDS)):
            starts.append([s for kind, s, _ in base if kind == k])
            ends.append([e for kind, _, e in base if kind == k])
        for kind, start, end in base_spans(now.text):
            changed = False
            for step in reversed(steps):
                start, end, touched = step.back(start, end)
                changed |= touched
            if not changed or (kind, start, end) in taken:
                continue
            before = bisect_right(starts[kind], start) - 1
            if before < 0 or end > ends[kind][before]:
                taken.add((kind, start, end))
                found.append((kind, start, end, False))
    return sorted(found)


def may_be_disguised(text: str) -> bool:
    """False only if the word transducer cannot change the text; by plain substring searches
    where these do, so that an ordinary text is never scanned by the large pattern.

    Every alternative of ``WORDS`` needs one of: an entity; a bracketed joint; a dot or
    ``dot`` between white space; `` at `` before a dotted host; a digit word beside a digit
    or another digit word.
    """
    low = text.lower()
    if len(low) != len(text):                   # places in it are not those of the text
        return True
    if "&" in low and ("&#" in low or "&commat;" in low or "&period;" in low):
        return True
    if any(b in text for b in "[({<") and BRACKETED.search(text):
        return True
    if LONE_DOT.search(text) or "dot" in low and LONE_DOT_WORD.search(low):
        return True
    if JOINED_DOT.search(text) and HANDLE_AT.search(text):
        return True
    for word in DIGIT_WORDS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if (at == 0 or text[at - 1] not in ASCII_ALNUM) and text[end:end + 1] not in ASCII_ALNUM \
                    and PAIR.search(text, max(0, at - PAIR_REACH), end + PAIR_REACH):
                return True
            at = low.find(word, end)
    return False


def _has_foreign(text: str) -> bool:
    """Any character that the character transducer changes?"""
    return any(plain_char(c) is not None for c in set(text) if c > "\x7f")


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("base", pa.bool_())]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)``: the personal data of every whole text.

    A span is ``(kind, start, end, base)`` in code points of the source text, end
    exclusive, ordered by kind (email, ip, card, phone), start, end; ``base`` marks
    those that the plain rules find.  A span of the normalised copy is added when a
    rewritten stretch is part of it and no base span of its kind covers it.  A NULL
    or empty text has no spans; repeated and NULL ids are rows of their own; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in all_spans(t or "")]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], [id_col, "spans"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, spans {SPANS}")


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if not text:
        return text
    out, at, last = [], 0, None
    for kind, start, end, _ in sorted(all_spans(text), key=lambda s: (s[1], -s[2])):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` masked; all columns stay as they are."""
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place)):
            cols = list(batch.columns)
            cols[place] = pa.array([mask(t) for t in cols[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs, run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, one row per document."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
