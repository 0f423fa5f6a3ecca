"""MinHash near-dedup: chosen-path similarity join (operator 10).

Documents are sets of word shingles; two are linked when their Jaccard similarity is
``threshold`` or more, and a document's component is all that links reach.

* Equal sets are one *class* from the start: thousands of copies are one row.
* Several independent trees branch the classes by chosen minwise tokens: the children
  of a node hold the classes whose smallest token under the node's own hash function
  is the same.  Two sets stay together at a step with a probability equal to their
  similarity, unrelated ones part at once.  A node is only branched while it is too
  large to compare, so links are lost only along the few steps that were needed;
  independent trees make up for that.  Their number follows from ``LOSS`` and the depth:
  those that depth 1 needs have all classes, the others, which the full depth needs,
  those classes that were in a node too large at depth 1.
* Small nodes are compared exhaustively by sketch, which names the classes that have a
  likely partner; only their sets are written, all others never leave their scan task.
  A sketch holds the first token of the first trees and one byte of every minwise hash;
  deeper tokens are made only for classes of nodes that are too large.
  Then each node confirms its likely pairs on the full sets, the likeliest first, and
  skips pairs that its links have joined already: a node gives at most one link less
  than it has members.  A pair that meets in several trees is confirmed in one of them,
  chosen by a hash of the pair, so the work on a large group is spread over its nodes.
* A node that is too large at the last level is a family of near copies: its members meet
  a few pivots and each other in parts of bounded size.  Only members that this has not
  joined to the node's first pivot meet all the others, part by part.

Rows are named by a key of id and text, never by the id alone: NULL and repeated ids
are rows like all others.

Nothing is collected on the driver but row counts; steps are cut by written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches, row_key, stored, unused
from basketlens.llm.words import slices, tokenize

#: Chance that all trees part a pair at the threshold, at most.
LOSS = 1e-6
TREES, LEVELS = 10, 4                            # trees at least, levels at most
#: Minwise hashes of a sketch: one for each tree and level, and more for estimates only.
HASHES = 256
#: Pairs whose sketches agree in fewer places aren't confirmed.  At similarity 0.8 the mean
#: is 204.8 with a deviation of 6.4, so this loses one borderline pair in a million.
AGREE_SIGMAS = 4.75
#: Row keys are broadcast below this many bytes (their number is counted first), else joined by shuffle.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 64
#: Classes compared exhaustively in one node, pivots of a node too large at the last level.
NODE_ROWS, PIVOTS = 2000, 8

_RNG = np.random.default_rng(20240613)
_MULT = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted inside it, and the texts' offsets."""
    t = tokenize(pc.ascii_lower(texts))
    word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in t.words], np.uint64)
    n_texts = len(texts)
    count = np.bincount(t.text, minlength=n_texts)
    h = word_hash[t.code] if len(t.code) else np.zeros(0, np.uint64)
    # a shingle starts at every word that has words - 1 after it; short texts have one
    begin = np.concatenate([[0], np.cumsum(count)])
    left = begin[1:][t.text] - np.arange(len(h))              # words from here to the text's end
    starts = np.flatnonzero((left >= words) | (t.first & (count[t.text] < words)))
    span = np.minimum(left[starts], words)
    out = np.zeros(len(starts), np.uint64)
    for k in range(words):
        inside = k < span
        out[inside] = _scramble(out[inside] * _MIX + h[starts[inside] + k] + np.uint64(k + 1))
    owner = t.text[starts]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    owner, out = owner[new], out[new]
    return out, np.searchsorted(owner, np.arange(n_texts + 1))


def trees_for(threshold: float, depth: int) -> int:
    """Trees that keep a pair at the threshold but for ``LOSS``, if all reach ``depth``."""
    if threshold >= 1:
        return TREES
    return max(TREES, int(np.ceil(np.log(LOSS) / np.log1p(-threshold ** depth))))


def levels_for(threshold: float) -> int:
    """Levels for whose trees a sketch has enough hashes; larger nodes are cut into parts."""
    fit = [d for d in range(1, LEVELS + 1) if trees_for(threshold, d) * d <= HASHES]
    if not fit:
        raise ValueError(f"threshold {threshold} is too low for sketches of {HASHES} hashes")
    return max(fit)


def _least_hash(sets: np.ndarray, offsets: np.ndarray, function: int) -> np.ndarray:
    """The smallest hash of every set under a function; 0 for empty sets."""
    out, full = np.zeros(len(offsets) - 1, np.uint32), np.flatnonzero(np.diff(offsets))
    if len(full):
        v = ((sets * _MULT[function] + _ADD[function]) >> np.uint64(32)).astype(np.uint32)
        out[full] = np.minimum.reduceat(v, offsets[full])
    return out


def _packed_tokens(columns: list[np.ndarray]) -> list[bytes]:
    return [r.tobytes() for r in np.stack(columns, 1).astype(">u4")]


def sketches(sets: np.ndarray, offsets: np.ndarray, first_trees: int, levels: int) -> tuple[list[bytes], list[bytes]]:
    """Each set's first token in the first trees (4 bytes each), and the low byte of the
    smallest hash under every function, for estimates."""
    tokens, low = [], np.zeros((len(offsets) - 1, HASHES), np.uint8)
    for k in range(HASHES):
        least = _least_hash(sets, offsets, k)
        low[:, k] = least.astype(np.uint8)
        if k % levels == 0 and k // levels < first_trees:
            tokens.append(least)
    return _packed_tokens(tokens), [r.tobytes() for r in low]


def least_agreement(threshold: float) -> int:
    """Places in which the sketches of a linked pair agree, but for a negligible chance."""
    return int(HASHES * threshold - AGREE_SIGMAS * np.sqrt(HASHES * threshold * (1 - threshold)))


def _sketch(words: int, first_trees: int, levels: int):
    names = ["row_key", "doc_id", "n_shingles", "cls", "tokens", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                sets, offsets = shingle_sets(batch.column(2), words)
                keys = [blake2b(sets[a:b].tobytes(), digest_size=16).digest()
                        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                tokens, low = sketches(sets, offsets, first_trees, levels)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(keys, pa.binary()),
                     pa.array(tokens, pa.binary()), pa.array(low, pa.binary())], names)
    return run


def _deep_tokens(words: int, n_tokens: int):
    """``(cls, tokens)``: a class's tokens for all trees and levels, 4 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets, offsets = shingle_sets(batch.column(1), words)
                tokens = _packed_tokens([_least_hash(sets, offsets, k) for k in range(n_tokens)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["cls", "tokens"])
    return run


def _sets(words: int):
    """``(cls, items)``: a class's sorted shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets, offsets = shingle_sets(batch.column(1), words)
                items = [sets[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["cls", "items"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive in order of ``key``; a group's size is bounded."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        keys = now.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        done = int(cuts[-1]) if len(cuts) else 0
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            yield now.slice(a, b - a)
        rest = now.slice(done)
    if rest is not None and rest.num_rows:
        yield rest


_PAIR = "a binary, b binary"


def _likely(group: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a node's rows that may be linked and are this node's to confirm, with their
    agreement.  ``leaves`` holds each class's small node in every tree."""
    low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(group.num_rows, HASHES)
    leaves = np.frombuffer(b"".join(group.column("leaves").to_pylist()), ">i8").reshape(len(low), -1)
    mark = np.frombuffer(b"".join(c[:8] for c in group.column("cls").to_pylist()), np.uint64)
    tree = group.column("tree")[0].as_py()
    left, right, agree = [], [], []
    for i in range(len(low) - 1):
        same = (low[i + 1:] == low[i]).sum(1)
        hit = np.flatnonzero(same >= least)
        if not len(hit):
            continue
        j = hit + i + 1
        met = (leaves[j] == leaves[i]) & (leaves[i] != 0)
        met[:, tree] = True
        turn = _scramble(mark[j] ^ mark[i]) % met.sum(1).astype(np.uint64) + np.uint64(1)
        own = met.cumsum(1)[:, tree] == turn.astype(np.int64)
        left.append(np.full(own.sum(), i))
        right.append(j[own])
        agree.append(same[hit][own])
    if not left:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


def _roles(least: int):
    """``(node, tree, cls)`` of the classes that have a pair to confirm in a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "node"):
            left, right, _ = _likely(group, least)
            if len(left):
                at = pa.array(np.unique(np.concatenate([left, right])))
                for part in group.select(["node", "tree", "cls"]).take(at).to_batches():
                    yield part
    return run


def _linked(least: int, threshold: float):
    """Links ``(a, b)`` of a node that join what was apart, confirmed on the full sets."""
    part, whole = round(threshold * 10_000), 10_000

    def confirmed(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate([x, y])
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        return whole * same >= part * (len(both) - same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "node"):
            left, right, agree = _likely(group, least)
            keys = group.column("cls").to_pylist()
            sets = [np.frombuffer(b, np.uint64) for b in group.column("items").to_pylist()]
            up = list(range(len(keys)))
            a, b = [], []
            for k in np.argsort(-agree, kind="stable").tolist():
                i, j = int(left[k]), int(right[k])
                x, y = i, j
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                short, long = sorted((len(sets[i]), len(sets[j])))
                if x != y and whole * short >= part * long and confirmed(sets[i], sets[j]):
                    up[x] = y
                    a.append(keys[i])
                    b.append(keys[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def _crowds(classes: DataFrame, deep_of: Callable[[DataFrame], DataFrame], threshold: float
            ) -> tuple[DataFrame, DataFrame | None, int]:
    """The trees' nodes that are small enough to compare, ``(node, tree, cls, whole)``; the
    rows ``(node, tree, cls, rows)`` of those that are too large at the last level, if any;
    the number of trees.

    A node of more than ``NODE_ROWS`` classes is branched by the next minwise token.
    ``deep_of`` gives ``(cls, tokens)`` for all trees and levels of some classes.
    """
    levels = levels_for(threshold)
    first, most = trees_for(threshold, 1), trees_for(threshold, levels)
    small: list[DataFrame] = []
    late: list[DataFrame] = []

    def sized(level: DataFrame, depth: int) -> DataFrame | None:
        """Adds a level's small nodes; returns the rows of its large ones, if any."""
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        now = stored(level.join(sizes, "node"), f"near_nodes_{depth}")
        small.append(now.where(F.col("rows") <= NODE_ROWS).select("node", "tree", "cls", F.lit(True).alias("whole")))
        large = now.where(F.col("rows") > NODE_ROWS)
        return None if large.isEmpty() else large

    def branch(large: DataFrame | None, deep: DataFrame, depth: int) -> None:
        while large is not None and depth < levels:
            at = 4 * (F.col("tree") * levels + depth) + 1
            level = large.join(deep, "cls").select(
                "cls", "tree", F.xxhash64("node", F.substr("tokens", at, F.lit(4))).alias("node"))
            depth += 1
            large = sized(level, depth)
        if large is not None:
            late.append(large.select("node", "tree", "cls", "rows"))

    def planted(rows: DataFrame, tokens: list, begin: int) -> DataFrame:
        return rows.select("cls", F.posexplode(F.array(*tokens)).alias("k", "token")) \
            .withColumn("tree", F.col("k") + F.lit(begin)).select("cls", "tree", F.xxhash64("tree", "token").alias("node"))

    crowded = sized(planted(classes, [F.substring("tokens", 4 * t + 1, 4) for t in range(first)], 0), 1)
    if crowded is not None and levels > 1:
        deep = stored(deep_of(crowded.select("cls").distinct()), "near_deep")
        branch(crowded, deep, 1)
        more = [F.substring("tokens", 4 * t * levels + 1, 4) for t in range(first, most)]
        if more:
            branch(sized(planted(deep, more, first), 1), deep, 1)
    elif crowded is not None:
        late.append(crowded.select("node", "tree", "cls", "rows"))
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, late) if late else None, \
        most if crowded is not None else first


def _part(rows: str = "rows") -> Column:
    """The part of a large node that a class falls into, one of :func:`_parts`."""
    return F.pmod(F.xxhash64("cls"), _parts(rows))


def _parts(rows: str = "rows") -> Column:
    return F.ceil(F.col(rows) / (NODE_ROWS // 2))


def _pivoted(late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large nodes as nodes of bounded size: each part of the members with the node's pivots.
    And the first pivot of every node, ``(node, pivot)``."""
    pick = late.groupBy("node", "tree", "rows", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(PIVOTS)).alias("pick")) \
        .agg(F.min("cls").alias("cls"))
    first = pick.groupBy("node").agg(F.min("cls").alias("pivot"))
    members = late.select("node", "tree", "cls", _part().alias("part")).unionByName(
        pick.select("node", "tree", "cls", F.explode(F.sequence(F.lit(0).cast("bigint"), _parts() - 1)).alias("part")))
    nodes = members.select(F.xxhash64("node", F.lit("pivots"), "part").alias("node"), "tree", "cls",
                           F.lit(False).alias("whole")).distinct()
    return nodes, first


def _rest(late: DataFrame, first: DataFrame, reached: DataFrame) -> DataFrame:
    """Members that are not joined to their node's first pivot, against all other members."""
    label = reached.select(F.col("node").alias("known"), "label")
    of_pivot = first.join(label, F.col("pivot") == F.col("known"), "left").select("node", F.col("label").alias("pivot_label"))
    told = late.join(label, F.col("cls") == F.col("known"), "left").join(of_pivot, "node") \
        .select("node", "tree", "cls", "rows", F.coalesce(F.col("label") != F.col("pivot_label"), F.lit(True)).alias("apart"))
    apart = told.where("apart")
    lone = apart.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    # apart members in parts of their own, each beside every part of the whole node
    left = apart.join(lone, "node").select("node", "tree", "cls", "rows", _part("lone").alias("own")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), _parts() - 1)))
    right = told.join(lone, "node").select("node", "tree", "cls", _part().alias("part"), _parts("lone").alias("lone_parts")) \
        .withColumn("own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lone_parts") - 1)))
    both = left.select("node", "tree", "cls", "own", "part").unionByName(right.select("node", "tree", "cls", "own", "part"))
    return both.select(F.xxhash64("node", F.lit("rest"), "own", "part").alias("node"), "tree", "cls",
                       F.lit(False).alias("whole")).distinct()


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest key that links ``(a, b)`` reach, for every key in them.

    Minimum of the neighbours' labels, then a jump to the label's own label, until
    nothing changes; every round is a written table.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "near_edges")
    now = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                 .select("node", F.least("node", "near").alias("label")), "near_labels")
    while True:
        near = edges.join(now, edges["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = now.join(near, now["node"] == near["a"]) \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")),
                       "near_labels")
        now = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return now


class _Join:
    """The steps of one similarity join; ``rows`` and ``classes`` are written tables."""

    def __init__(self, docs: DataFrame, words: int, threshold: float):
        self.words, self.threshold, self.least = words, threshold, least_agreement(threshold)
        levels = levels_for(threshold)
        self.n_tokens = trees_for(threshold, levels) * levels
        self.texts = docs.select(row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
        id_type = docs.schema["doc_id"].dataType.simpleString()
        self.rows = stored(map_batches(
            self.texts, _sketch(words, trees_for(threshold, 1), levels),
            f"row_key binary, doc_id {id_type}, n_shingles long, cls binary, tokens binary, low binary"), "near_sketches")
        self.classes = stored(self.rows.where("n_shingles > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.first("tokens").alias("tokens"),
            F.first("low").alias("low")), "near_classes")

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """``(cls, text)`` of one row of each class (and its equal copies).  Few classes are
        broadcast, by their counted number, so that the texts of all others stay where they are."""
        wanted = stored(classes.join(self.classes.select("cls", "row_key"), "cls").select("cls", "row_key"), "near_wanted")
        if wanted.count() * KEY_BYTES <= BROADCAST_BYTES:
            wanted = F.broadcast(wanted)
        return self.texts.join(wanted, "row_key").select("cls", "text")

    def deep(self, classes: DataFrame) -> DataFrame:
        return map_batches(self.texts_of(classes), _deep_tokens(self.words, self.n_tokens), "cls binary, tokens binary") \
            .groupBy("cls").agg(F.first("tokens").alias("tokens"))

    def compare(self, nodes: DataFrame, n_trees: int, step: str) -> DataFrame:
        """Confirmed links of the pairs that meet in some nodes, stored."""
        # a class's small node in each tree, 8 bytes a tree: tells where a pair meets
        own = [F.coalesce(F.max(F.when((F.col("tree") == k) & F.col("whole"), F.col("node"))), F.lit(0)) for k in range(n_trees)]
        leaves = nodes.groupBy("cls").agg(F.concat(*[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in own]).alias("leaves"))
        marked = self.classes.select("cls", "low").join(leaves, "cls")
        members = nodes.drop("whole").join(marked, "cls")
        roles = stored(map_batches(_by_node(members.select("node", "tree", "cls", "low", "leaves")), _roles(self.least),
                                   "node long, tree int, cls binary"), f"near_roles_{step}")
        needed = stored(roles.select("cls").distinct().join(marked, "cls"), f"near_needed_{step}")
        sets = stored(map_batches(self.texts_of(needed.select("cls")), _sets(self.words), "cls binary, items binary")
                      .groupBy("cls").agg(F.first("items").alias("items")), f"near_sets_{step}")
        ready = roles.join(needed.join(sets, "cls"), "cls").select("node", "tree", "cls", "low", "leaves", "items")
        return stored(map_batches(_by_node(ready), _linked(self.least, self.threshold), _PAIR), f"near_links_{step}")

    def components(self) -> DataFrame:
        """``(cls, label, component_id)`` of every class that has words."""
        small, late, n_trees = _crowds(self.classes.select("cls", "tokens"), self.deep, self.threshold)
        if late is None:
            reached = components(self.compare(small, n_trees, "all"))
        else:
            pivoted, first = _pivoted(late)
            links = self.compare(small.unionByName(pivoted), n_trees, "all")
            rest = stored(_rest(late, first, components(links)), "near_rest")
            if not rest.isEmpty():
                links = links.unionByName(self.compare(rest, n_trees, "rest"))
            reached = components(links)
        grouped = self.classes.join(reached, self.classes["cls"] == reached["node"], "left") \
            .select("cls", "first_id", F.coalesce("label", "cls").alias("label"))
        ids = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
        return grouped.join(ids, "label").select("cls", "label", "component_id")


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut at white space; a document's set holds its
    distinct shingles of ``words`` words, or the whole sequence when it has fewer.
    Documents are linked when intersection / union is ``threshold`` or more.
    ``component_id`` is the smallest ``doc_id`` that links reach, ``kept`` marks the rows
    that carry it.  NULL, empty and blank texts have no set and are linked with nothing;
    a repeated row is linked with its copies; a NULL ``doc_id`` is never a component's id
    unless all of its component is NULL, and such rows are not kept.  Other columns
    are not read.  Shingles are compared by 64-bit hashes.
    """
    join = _Join(docs, words, threshold)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return join.rows.select("doc_id", "n_shingles", "cls").join(join.components(), "cls", "left") \
        .select("doc_id", "n_shingles", own.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, *, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, all columns: that of the smallest id (NULL
    ids last), of equal ids that with the smallest key of id and text.

    Rows without words are near nothing and stay.  Equal rows (id and text) are one document.
    """
    join = _Join(docs, words, threshold)
    named = join.rows.groupBy("row_key", "doc_id", "n_shingles", "cls").agg(F.count(F.lit(1)).alias("copies"))
    grouped = named.where("n_shingles > 0").join(join.components().select("cls", "label"), "cls")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row_key"))
    chosen = grouped.groupBy("label").agg(F.min(order)["row_key"].alias("row_key")).select("row_key", F.lit(True).alias("chosen"))
    # the keys that not just one row has, or that go: all other rows stay where they are
    kept, key = (unused(name, docs.columns) for name in ("near_kept", "near_key"))
    listed = stored(named.join(chosen, "row_key", "left")
                    .select(F.col("row_key").alias(key), "copies", ((F.col("n_shingles") == 0) | F.col("chosen").isNotNull()).alias(kept))
                    .where(~F.col(kept) | (F.col("copies") > 1)).select(key, kept), "near_listed")
    few = listed.count() * KEY_BYTES <= BROADCAST_BYTES
    told = docs.withColumn(key, row_key("doc_id", "text")).join(F.broadcast(listed) if few else listed, key, "left")
    if few:
        out = told.where(F.col(kept).isNull())
        if not listed.where(F.col(kept)).isEmpty():
            out = out.unionByName(told.where(F.col(kept)).dropDuplicates([key]))
    else:
        out = told.where(F.coalesce(F.col(kept), F.lit(True))).dropDuplicates([key])
    return out.select(*docs.columns)
