"""Toxic spans by a linear-chain conditional random field (operator 2).

Two tags (plain, toxic).  Training takes a bounded sample of labelled documents:

1. *Token labels.*  A word form (the word, its first or last characters) marks
   toxicity when it is found in toxic documents far more often than in clean ones;
   a token of a toxic document with such a form is tagged toxic, all others plain.
2. *CRF.*  Emission weights on hashed word features, a 2 x 2 transition table and
   start weights, fitted by gradient ascent on the conditional likelihood; the
   gradient comes from forward-backward expectations.
3. *Document score.*  Token marginals are aggregated per document (expected number
   of toxic tokens, largest marginal, share) and mapped to a probability by a
   logistic curve, fitted on the half of the sample that the CRF has not seen.

Scoring is a map over the documents: no shuffle.  Forward-backward runs on all
tokens of an Arrow batch at once: the chain is cut into blocks whose 2 x 2 transfer
matrices are multiplied in step, which gives the exact marginals of any length of
text in vector operations and bounded memory.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import Memo, map_batches
from basketlens.llm.words import Tokens, slices, tokenize

#: Bounds of the training sample: documents of each label, and characters of each (longer
#: ones aren't drawn).
TRAIN_TOXIC, TRAIN_PLAIN = 1_500, 3_500
TRAIN_CHARS = 10_000
#: Hashed feature weights; forms a word has.
BUCKETS = 1 << 18
#: A form marks toxicity from this many toxic documents and this share of them on, at this
#: ratio of rates (equal texts count once; the share keeps near copies from marking words).
MIN_DOCS, MIN_SHARE, MIN_RATIO = 5, 0.02, 25.0
STEPS = 16
EDGE = "\"'`.,;:!?()[]{}<>|*_-–—…«»„“”‘’/\\"


def forms(word: str) -> list[int]:
    """The features of a raw token as 32-bit hashes: the word, its first 3 to 6 and last
    3 and 5 bytes in lower case without punctuation around; the seed tells them apart."""
    w = word.lower().strip(EDGE).encode()
    n = len(w)
    out = [crc32(w)]
    if n > 3:
        out += (crc32(w[:3], 3), crc32(w[-3:], 13))
        if n > 4:
            out.append(crc32(w[:4], 4))
            if n > 5:
                out += (crc32(w[:5], 5), crc32(w[-5:], 15))
                if n > 6:
                    out.append(crc32(w[:6], 6))
    return out


def marginals(logit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray,
              pairs: bool = False):
    """P(toxic) of every token of all chains, given emission log-odds.

    ``first`` marks chain starts.  ``trans[i, j]`` and ``start[j]`` are potentials (not
    logs).  With ``pairs`` the expected transition counts come too.
    """
    n = len(logit)
    if not n:
        empty = np.zeros(0)
        return (empty, np.zeros((2, 2)), np.zeros(2)) if pairs else empty
    steps = max(1, min(n, int(np.sqrt(n) / 2)))
    cols = -(-n // steps)
    pad = steps * cols - n
    e = np.exp(np.clip(np.concatenate([logit, np.zeros(pad)]), -30, 30)).reshape(cols, steps).T.copy()
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(cols, steps).T
    p00, p10 = np.where(f, start[0], trans[0, 0]), np.where(f, start[0], trans[1, 0])
    p01, p11 = np.where(f, start[1], trans[0, 1]) * e, np.where(f, start[1], trans[1, 1]) * e

    # transfer matrix of every block
    a, b, c, d = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for t in range(steps):
        a, b = a * p00[t] + b * p10[t], a * p01[t] + b * p11[t]
        c, d = c * p00[t] + d * p10[t], c * p01[t] + d * p11[t]
        if t % 8 == 7 or t == steps - 1:
            s = a + b + c + d
            a, b, c, d = a / s, b / s, c / s, d / s
    # state before each block, and future behind it, from block to block
    before, behind = np.empty((cols, 2)), np.empty((cols, 2))
    x0, x1 = 1.0, 1.0
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        before[k] = x0, x1
        x0, x1 = x0 * ka + x1 * kc, x0 * kb + x1 * kd
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
    y0, y1 = 0.5, 0.5
    for k in range(cols - 1, -1, -1):
        behind[k] = y0, y1
        y0, y1 = a[k] * y0 + b[k] * y1, c[k] * y0 + d[k] * y1
        s = y0 + y1
        y0, y1 = y0 / s, y1 / s
    alpha = np.empty((steps, cols))                       # P(toxic | tokens so far)
    x0, x1 = before[:, 0].copy(), before[:, 1].copy()
    for t in range(steps):
        x0, x1 = x0 * p00[t] + x1 * p10[t], x0 * p01[t] + x1 * p11[t]
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        alpha[t] = x1
    beta = np.empty((steps, cols))                        # share of the toxic tag in the future's weight
    y0, y1 = behind[:, 0].copy(), behind[:, 1].copy()
    for t in range(steps - 1, -1, -1):
        beta[t] = y1
        y0, y1 = p00[t] * y0 + p01[t] * y1, p10[t] * y0 + p11[t] * y1
        s = y0 + y1
        y0, y1 = y0 / s, y1 / s
    al, be = alpha.T.reshape(-1)[:n], beta.T.reshape(-1)[:n]
    one, zero = al * be, (1 - al) * (1 - be)
    m = one / (one + zero)
    if not pairs:
        return m
    inner = np.flatnonzero(~first)
    w = e.T.reshape(-1)[:n][inner]
    pa1, pb1 = al[inner - 1], be[inner]
    x = np.stack([(1 - pa1) * trans[0, 0] * (1 - pb1), (1 - pa1) * trans[0, 1] * w * pb1,
                  pa1 * trans[1, 0] * (1 - pb1), pa1 * trans[1, 1] * w * pb1])
    x /= x.sum(0)
    begun = m[first].sum()
    return m, x.sum(1).reshape(2, 2), np.array([first.sum() - begun, begun])


@dataclass
class Model:
    """Weights: emission by feature bucket, transitions, starts, document curve."""

    emission: list[float]
    trans: np.ndarray
    start: np.ndarray
    curve: np.ndarray
    memo: Memo = field(default_factory=Memo, repr=False)

    def logits(self, words: list[str]) -> np.ndarray:
        memo, weight, mask = self.memo, self.emission, BUCKETS - 1
        out = []
        for w in words:
            v = memo.get(w)
            if v is None:
                v = memo.put(w, sum([weight[f & mask] for f in forms(w)]))
            out.append(v)
        return np.array(out)

    def tag(self, t: Tokens) -> np.ndarray:
        return marginals(self.logits(t.words)[t.code] if len(t.code) else np.zeros(0), t.first,
                         np.exp(self.trans), np.exp(self.start))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.curve, -30, 30)))


def summary(t: Tokens, m: np.ndarray, texts: int) -> np.ndarray:
    """Per text: log of the expected toxic tokens, the largest marginal, the toxic share."""
    total = np.bincount(t.text, m, texts)
    count = np.bincount(t.text, minlength=texts)
    top = np.zeros(texts)
    np.maximum.at(top, t.text, m)
    return np.c_[np.log(total + 1e-2), top, total / np.maximum(count, 1) * 10]


def word_forms(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Forms of all words one after another, and where each word's begin."""
    each = [forms(w) for w in words]
    begin = np.cumsum([0, *map(len, each)])
    return np.fromiter((f for e in each for f in e), np.int64, begin[-1]), begin


def marking_forms(t: Tokens, toxic: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For every entry of ``flat``: is the form found far more often in toxic texts than in
    clean ones (texts counted, not tokens)?"""
    _, number = np.unique(flat, return_inverse=True)
    counts = np.zeros((2, number.max(initial=-1) + 1))
    ends = np.searchsorted(t.text, np.arange(len(toxic) + 1))
    for text, label in enumerate(toxic.tolist()):
        codes = np.unique(t.code[ends[text]:ends[text + 1]])
        size = begin[codes + 1] - begin[codes]
        at = np.repeat(begin[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        counts[label, np.unique(number[at])] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    marks = (counts[1] >= max(MIN_DOCS, MIN_SHARE * n1)) & (counts[1] / n1 >= MIN_RATIO * (counts[0] + 0.5) / n0)
    return marks[number]


def fit(texts: list[str], toxic: list[int], steps: int = STEPS, share: float | None = None) -> Model | None:
    """Fit on labelled texts; None if a label has fewer than two texts.

    ``share`` is the share of toxic documents that scores are to reckon with (that of the
    texts if None): the sample may hold another one, as it is drawn by label.
    """
    by_label = [[k for k in range(len(texts)) if toxic[k] == label] for label in (0, 1)]
    if min(map(len, by_label)) < 2:
        return None
    halves = [sorted(k for own in by_label for k in own[h::2]) for h in (0, 1)]
    y_text = np.array([toxic[k] for k in halves[0]])
    t = tokenize(pa.array([texts[k] for k in halves[0]], pa.string()))
    flat, begin = word_forms(t.words)
    marks = marking_forms(t, y_text, flat, begin)
    marked = np.logical_or.reduceat(marks, begin[:-1]) if len(marks) else marks
    y = (marked[t.code] & (y_text[t.text] == 1)).astype(float)
    word_of, bucket_of = np.repeat(np.arange(len(t.words)), np.diff(begin)), flat % BUCKETS

    inner = np.flatnonzero(~t.first)
    seen_pairs = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4).reshape(2, 2)
    begun = y[t.first].sum()
    seen_start = np.array([t.first.sum() - begun, begun])

    theta = [np.zeros(BUCKETS), np.zeros((2, 2)), np.array([0.0, -2.0])]
    theta[0][np.unique(bucket_of)] = -0.5
    theta[0][bucket_of[marks]] = 2.0          # a start near the end: few steps
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, steps + 1):
        logit = np.bincount(word_of, theta[0][bucket_of], len(t.words))[t.code]
        m, pairs, starts = marginals(logit, t.first, np.exp(theta[1]), np.exp(theta[2]), pairs=True)
        by_word = np.bincount(t.code, y - m, len(t.words))
        grad = [np.bincount(bucket_of, by_word[word_of], BUCKETS) - 0.05 * theta[0],
                seen_pairs - pairs - 0.05 * theta[1], seen_start - starts - 0.05 * theta[2]]
        for k, g in enumerate(grad):                       # Adam
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            theta[k] = theta[k] + 0.25 * (first[k] / (1 - 0.9 ** step)) \
                / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)

    model = Model(theta[0].tolist(), theta[1], theta[2], np.zeros(4))
    held = tokenize(pa.array([texts[k] for k in halves[1]], pa.string()))
    model.curve = _curve(summary(held, model.tag(held), len(halves[1])),
                         np.array([toxic[k] for k in halves[1]], float))
    if share is not None:
        drawn = len(by_label[1][1::2]) / len(halves[1])
        model.curve[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    model.memo.clear()
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, max_toxic: int = TRAIN_TOXIC,
          max_plain: int = TRAIN_PLAIN, max_chars: int = TRAIN_CHARS) -> Model | None:
    """Fit a model on at most ``max_toxic`` and ``max_plain`` documents of either label, of at
    most ``max_chars`` characters.

    ``labels`` is ``(doc_id, toxic)``; a label that is neither 0 nor 1, or contradicts
    another of its document, is not used, nor are equal texts with different labels.
    ``learn`` limits the rows that may teach (a condition on ``doc_id``).  Each label's
    documents are drawn by a hash of the id, the same in every run; however rare the toxic
    ones are, they are in the sample, and the scores reckon with their true share.  Warns
    and returns None if there are labels but a label has fewer than two texts.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")) \
        .where("toxic = other").drop("other")
    texts = docs.select("doc_id", "text").where(
        F.col("text").isNotNull() & (F.length("text") <= max_chars))
    if learn is not None:
        texts = texts.where(learn)
    # the ids are drawn first: only the sample's texts travel
    usable = known.join(texts.select("doc_id").distinct(), "doc_id")
    counts = {int(r.toxic): r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = reduce(DataFrame.unionByName, [
        usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in ((1, max_toxic), (0, max_plain))])
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id") \
        .agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: crc32(str(r["doc_id"]).encode()))
    told: dict[str, set[int]] = {}
    for r in rows:
        told.setdefault(r["text"], set()).add(int(r["toxic"]))
    sample = [(text, min(own)) for text, own in told.items() if len(own) == 1]
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit([t for t, _ in sample], [y for _, y in sample], share=share) if 0 < share < 1 else None
    if model is None and counts:
        warnings.warn(f"no toxicity model: labelled documents by label {counts}", stacklevel=2)
    return model


SPANS = "array<struct<start:int,end:int,p:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text",
          tag_at: float = 0.5) -> DataFrame:
    """``(id_col, score, spans)`` for every whole text.

    ``score`` is the document's probability of label 1; ``spans`` are the tokens with a
    marginal of ``tag_at`` or more as ``(start, end, p)`` in code points.  NULL and empty
    texts get the curve's value for no tokens and no spans; without a model (no usable
    labels) every score is 0.  A row out for each row in; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, score double, spans {SPANS}"
    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole):
                t = tokenize(batch.column(1))
                p = m.tag(t)
                hit = np.flatnonzero(p >= tag_at)
                offsets = np.searchsorted(t.text[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(t.start[hit].astype(np.int32)), pa.array(t.end[hit].astype(np.int32)),
                     pa.array(p[hit])], fields=list(_SPANS.value_type)))
                scores = m.score(summary(t, p, batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), spans],
                                                 [id_col, "score", "spans"])

    return map_batches(docs.select(id_col, text_col), run, schema)


def clean(docs: DataFrame, model: Model | None, at: float = 0.5, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``at``, with all their columns.

    NULL and empty texts score low and stay; without a model every row stays.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, place):
                t = tokenize(batch.column(place))
                scores = m.score(summary(t, m.tag(t), batch.num_rows))
                yield batch.filter(pa.array(scores < at))

    return map_batches(docs, run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores of all documents by a model of the rows that are not held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_toxic_tokens"))
