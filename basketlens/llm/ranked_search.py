"""Ranked lexical search with a document FP-tree (operator 13).

Every ``benchmark`` item is a query; every document is ranked for it by a BM25-like sum
in whole numbers.  Three passes, none of which moves a text:

* *Statistics.*  Tasks count documents and terms, and the documents that hold each of the
  items' terms; one row per task and term is shuffled.
* *Trees.*  A task reads its documents in blocks.  A document becomes a term vector that is
  restricted to the terms of a block of items and ordered by frequency in the corpus.
  Sorted, the vectors form an FP-tree: documents that share a path of frequent terms lie
  side by side, a node is a range of them.  Every node keeps, for each term, the largest
  frequency (tf) in its subtree, and the subtree's smallest length factor (m).  A score
  grows with tf and falls with m, so both together bound every score in the subtree.
* *Search.*  Per item, depth first, the child with the highest bound first; a subtree whose
  bound is below the item's k-th best score in this task is left out.  Leaves are scored
  exactly.  The k best of each task and item meet in a ranking of two levels.

Work in a task is bounded by its block of documents and of items (``DOC_BLOCK`` by
``TERM_BLOCK`` counts).  Items are the stated query set: their texts are sent to the tasks
``ITEM_BYTES`` at a time, a larger set in several searches.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches

#: Documents of a tree, documents of a leaf, distinct terms of a block of items.
DOC_BLOCK, LEAF, TERM_BLOCK = 2048, 16, 2048
#: Bytes of item texts that one search sends to its tasks.
ITEM_BYTES = 16 << 20
#: Groups of the first level of the ranking.
RANK_GROUPS = 64

#: Terms are runs of bytes that are no ASCII separator, A-Z lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in their order, repeats included."""
    return (text or "").encode().translate(_FOLD).split()


def length_factor(n: int, docs: int, total: int) -> int:
    return 25 + 75 * n * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Corpus:
    """What the scores need to know of all documents: sizes, and weights of the items' terms."""

    docs: int
    total: int
    number: dict[bytes, int]                     # a term's rank by document frequency
    weights: np.ndarray


@dataclass
class Items:
    """A block of items over its own terms: columns and weights of each item's terms."""

    column: np.ndarray                           # of a term number in this block, or -1
    width: int
    items: list[tuple[int, np.ndarray, np.ndarray]]


def item_blocks(queries: list[list[bytes]], corpus: Corpus) -> list[Items]:
    """Items in blocks of at most ``TERM_BLOCK`` distinct terms (or one item)."""
    known = [Counter(corpus.number[t] for t in q if t in corpus.number) for q in queries]
    blocks, now, used = [], [], set()

    def close():
        column = np.full(len(corpus.weights), -1, np.int64)
        column[sorted(used)] = np.arange(len(used))
        rows = []
        for k in now:
            numbers = np.array(sorted(known[k]), np.int64)
            times = np.array([known[k][t] for t in numbers.tolist()], np.int64)
            rows.append((k, column[numbers], times * corpus.weights[numbers]))
        blocks.append(Items(column, len(used), rows))

    for k, own in enumerate(known):
        if not own:
            continue
        if now and len(used | own.keys()) > TERM_BLOCK:
            close()
            now, used = [], set()
        now.append(k)
        used |= own.keys()
    if now:
        close()
    return blocks


def score(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (or bounds) of rows of term frequencies with their length factors."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None])) @ weights


class Tree:
    """FP-tree of a block's restricted vectors: nodes are ranges of the sorted documents."""

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        paths = [np.flatnonzero(row).astype(">u2") for row in tf]
        order = sorted((k for k, p in enumerate(paths) if len(p)), key=lambda k: (paths[k].tobytes(), m[k]))
        self.rows = np.array(order, np.int64)
        self.tf, self.m = tf[self.rows], m[self.rows]
        self.paths = [paths[k] for k in order]
        self.lo, self.hi, self.children = [], [], []
        self.tops, self.least = [], []
        if order:
            self._node(0, len(order))
            self.tops, self.least = np.array(self.tops), np.array(self.least)
        del self.paths

    def _node(self, lo: int, hi: int) -> int:
        me = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append([])
        self.tops.append(None)
        self.least.append(0)
        if hi - lo <= LEAF:
            self.tops[me], self.least[me] = self.tf[lo:hi].max(0), self.m[lo:hi].min()
            return me
        own = [self._node(a, b) for a, b in self._parts(lo, hi)]
        self.children[me] = own
        self.tops[me] = np.max([self.tops[c] for c in own], 0)
        self.least[me] = min(self.least[c] for c in own)
        return me

    def _parts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Children of a node: by the first term after the shared path; small ones side by
        side share a leaf, equal vectors are cut."""
        a, b = self.paths[lo], self.paths[hi - 1]
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        depth = int(other[0]) if len(other) else n
        step = [int(p[depth]) if len(p) > depth else -1 for p in self.paths[lo:hi]]
        if step[0] == step[-1]:
            return [(k, min(k + LEAF, hi)) for k in range(lo, hi, LEAF)]
        cuts = [lo, *(lo + np.flatnonzero(np.diff(step)) + 1).tolist(), hi]
        parts: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:]):
            if parts and y - parts[-1][0] <= LEAF:
                parts[-1] = parts[-1][0], y
            else:
                parts.append((x, y))
        return parts


@dataclass
class Best:
    """The k best ``(score, document)`` of an item so far; ties go to the smaller id, no id last."""

    k: int
    heap: list = field(default_factory=list)

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, value: int, doc: int | None) -> None:
        entry = (value, doc is not None, -doc if doc is not None else 0)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def branch_and_bound(tree: Tree, ids: list, columns: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the tree's best documents for one item; returns the number scored exactly."""
    if not len(tree.rows):
        return 0
    bound = score(tree.tops[:, columns], tree.least, weights)
    todo, scored = [0], 0
    while todo:
        node = todo.pop()
        if bound[node] < best.least():
            continue
        if tree.children[node]:
            todo += sorted(tree.children[node], key=bound.__getitem__)
            continue
        lo, hi = tree.lo[node], tree.hi[node]
        values = score(tree.tf[lo:hi, columns], tree.m[lo:hi], weights)
        scored += hi - lo
        for k in np.flatnonzero(values >= best.least()).tolist():
            best.add(int(values[k]), ids[tree.rows[lo + k]])
    return scored


class Block:
    """Documents read so far: ids, length factors and the counts of the items' terms."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus
        self.ids, self.m, self.row, self.term, self.count = [], [], [], [], []

    def add(self, doc: int | None, text: str | None) -> None:
        found = terms(text)
        if not found:
            return
        counts = Counter(found)
        own = [(self.corpus.number[t], counts[t]) for t in counts.keys() & self.corpus.number.keys()]
        if own:
            self.row += [len(self.ids)] * len(own)
            self.term += [t for t, _ in own]
            self.count += [c for _, c in own]
            self.ids.append(doc)
            self.m.append(length_factor(len(found), self.corpus.docs, self.corpus.total))

    def search(self, blocks: list[Items], best: list[Best]) -> int:
        """Search this block for all items; returns the number of exact scores."""
        row, term, count = (np.array(x, np.int64) for x in (self.row, self.term, self.count))
        m, scored = np.array(self.m, np.int64), 0
        for block in blocks:
            column = block.column[term]
            has = column >= 0
            tf = np.zeros((len(self.ids), block.width), np.int32)
            tf[row[has], column[has]] = count[has]
            tree = Tree(tf, m)
            for k, columns, weights in block.items:
                scored += branch_and_bound(tree, self.ids, columns, weights, best[k])
        return scored


def _frequencies(vocabulary: frozenset[bytes]):
    """``(term, docs, total)``: per task, documents with an item term; term NULL: all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py())
                docs += bool(found)
                total += len(found)
                df.update(vocabulary.intersection(found))
        names = [None, *df]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([docs, *df.values()], pa.int64()),
             pa.array([total, *[0] * len(df)], pa.int64())], ["term", "docs", "total"])
    return run


def _search(queries: list[list[bytes]], corpus: Corpus, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best = item_blocks(queries, corpus), [Best(k) for _ in queries]
        now = Block(corpus)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now.add(doc, text.as_py())
                if len(now.ids) == DOC_BLOCK:
                    now.search(blocks, best)
                    now = Block(corpus)
        now.search(blocks, best)
        found = [(q, -i if known else None, s) for q, b in enumerate(best) for s, known, i in b.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], pa.int64())], ["item", "doc_id", "score"])
    return run


def corpus_of(texts: DataFrame, vocabulary: frozenset[bytes]) -> Corpus:
    """Sizes of the corpus and weights of the vocabulary (terms of one set of items)."""
    rows = map_batches(texts, _frequencies(vocabulary), "term binary, docs long, total long") \
        .groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).collect()
    docs, total = next(((r.docs, r.total) for r in rows if r.term is None), (0, 0))
    known = sorted(((r.docs, bytes(r.term)) for r in rows if r.term is not None), key=lambda r: (-r[0], r[1]))
    return Corpus(docs, total, {t: i for i, (_, t) in enumerate(known)},
                  np.array([weight(docs, df) for df, _ in known], np.int64))


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents of score above 0.

    Every row of ``items`` (``item_id``, ``text``) is one item, repeated rows included;
    every row of ``docs`` (``doc_id``, ``text``) is one document.  Terms are runs of
    letters and digits of ASCII and of all other characters, A-Z lower-cased.  NULL,
    empty and term-less texts are no documents and find none.  Equal scores rank by
    ``doc_id``, NULL ids last.  Ids of documents are whole numbers.  Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = items.select("item_id", "text")
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = math.ceil(size / ITEM_BYTES)
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, sets)))
    found = []
    for number in range(max(1, sets)):
        own = queries.where(dealt == number).collect() if sets else []
        split = [terms(r.text) for r in own]
        corpus = corpus_of(texts.select("text"), frozenset(t for q in split for t in q)) if own else Corpus(0, 0, {}, np.zeros(0))
        name = docs.sparkSession.createDataFrame(
            [(q, r.item_id) for q, r in enumerate(own)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = map_batches(texts, _search(split, corpus, k), "item int, doc_id long, score long")
        group = F.pmod(F.xxhash64("item", "doc_id", "score"), F.lit(RANK_GROUPS)).alias("rank_group")
        best = _ranked(best.select("*", group), ["item", "rank_group"], k).drop("rank", "rank_group")
        found.append(_ranked(best, ["item"], k).join(F.broadcast(name), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
q AS (
  SELECT row_number() OVER () AS qid, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark),
qt AS (SELECT qid, item_id, t, count(*) AS times FROM (SELECT qid, item_id, unnest(ts) AS t FROM q) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
dt AS (
  SELECT rid, doc_id, n, t, count(*) AS tf
  FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, s GROUP BY t, s.n),
r AS (
  SELECT qid, item_id, rid, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * dt.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM dt JOIN qt USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""
