"""Mixing sources to target weights (operator 8).

Each source's words, document after document, are one long stream that is packed
into blocks of a fixed number of words.  The mix draws whole blocks:

1. every source gets a target: its weight's share of all words, never more than
   ``max_repeats`` times its own words; what a cap cuts off goes to the other
   sources by weight until no source is above its cap;
2. the target is a number of block slots.  How many slots of a source each of the
   ``shards`` output shards gets is a multinomial draw: every slot throws a seeded die
   with a side for each shard, the throws are counted per (shard, source).  The draw is
   conditioned on the targets: a source's counts add up to its slots exactly;
3. the counts address the slots: slot ``i`` of a source in a shard is its slot ``first + i``,
   with ``first`` the counts of the shards before.  Slot ``k`` reads block ``permute(k mod n)``
   of the source's ``n`` blocks, in pass ``k div n``; a different pseudorandom permutation
   holds for each source and pass, so a pass takes every block once;
4. slots and document pieces meet by an equi-join on (source, block).

All of it is arithmetic on (source, position): word counts are the only thing
computed from texts, no text is shuffled for the plan, and no step sorts a whole
source (prefix sums go over ``CHUNKS`` hash chunks first, so a source with a third
of all rows is spread as well as the others; rows are dealt to chunks by all their
columns, and equal rows are summed up before, so neither NULL ids nor copies make a
chunk larger).  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import WORD, row_key, stored, unused

#: Hash chunks of each source in the two-step prefix sums.
CHUNKS = 2048
#: Words of a block.
BLOCK_WORDS = 128
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARDS = 64
SEED = 17
#: Numbers that one row is expanded to at most.
RUN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, max_repeats: int = MAX_REPEATS
            ) -> dict[str | None, float]:
    """Target words of every source, from ``(source, size)`` with one row a source.

    Sources take the weights in turn, by code point order with NULL last.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[k % len(weights)]) for k, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), list(weight), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > max_repeats * size[s]]
        if not over:
            return out | {s: weight[s] * share for s in open_}
        for s in over:
            out[s] = float(max_repeats * size[s])
            left -= out[s]
            open_.remove(s)
    return out


def _sources(sized: DataFrame, weights, max_repeats: int) -> DataFrame:
    """A row a source: number, words, target.  Source names are a short list; it goes
    through the driver once (one row a source, counts only)."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("words")).collect()
    goal = targets([(r["source"], r["words"]) for r in rows], weights, max_repeats)
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    words = {r["source"]: r["words"] for r in rows}
    return sized.sparkSession.createDataFrame(
        [(k, s, int(words[s]), float(goal[s])) for k, s in enumerate(order)],
        "source_no int, source string, source_size long, target double")


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, uid, source, size)``; ``uid`` is a 128-bit key of all columns, equal for equal rows only."""
    return docs.select("doc_id", row_key(*docs.columns).alias("uid"), "source",
                       word_count(F.col("text")).alias("size"))


def numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """A row for each number ``0 .. count-1`` as ``name``, made in runs of ``RUN`` dealt to all tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.where(F.col(count) > 0) \
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / RUN)))) \
        .repartition(tasks)
    return runs.withColumn(name, F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col(count)) - 1))) \
        .drop("run")


def positions(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's first word in its source's stream, as ``start``.

    The stream's order is (hash chunk of the row's key, key); equal rows follow each other.
    Prefix sums run over the chunks' totals, then inside each chunk, over distinct rows.
    """
    rows = sized.groupBy("source", "uid", "size").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    docs = rows.join(sources, rows["source"].eqNullSafe(sources["source"])) \
        .select("doc_id", "uid", "size", "copies", "source_no", "source_size", "target",
                F.pmod(F.xxhash64("uid"), F.lit(CHUNKS)).cast("int").alias("chunk"))
    words = F.col("size") * F.col("copies")
    chunk_starts = docs.groupBy("source_no", "chunk").agg(F.sum(words).alias("chunk_words")) \
        .withColumn("chunk_start", F.sum("chunk_words").over(
            Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source_no", "chunk").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))) \
        .join(chunk_starts, ["source_no", "chunk"])
    # copies are rows again; a single row, the usual case, is not dealt anew
    one = placed.where("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    several = numbered(placed.where("copies > 1"), "copies", "copy")
    return one.unionByName(several) \
        .withColumn("start", F.col("inside") + F.coalesce("chunk_start", F.lit(0)) + F.col("copy") * F.col("size")) \
        .select("doc_id", "uid", "size", "source_no", "source_size", "target", "start")


def permute(index: Column, count: Column, key: Column, rounds: int = 24) -> Column:
    """Pseudorandom permutation of ``0 .. count-1``, a different one for each ``key``.

    A swap-or-not shuffle: each round pairs ``x`` with ``shift - x`` (a hash of the key
    gives the shift) and swaps the two when a hash of the pair's larger member says
    so.  Every round is its own inverse, so the whole is one to one for any ``count``.
    """
    def one_round(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), count) - x, count)
        swap = F.pmod(F.xxhash64(r, F.greatest(x, other), key), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), one_round)


def shard_counts(slots: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The multinomial draw: ``(source_no, firsts)``, in order of the shards the number of
    slots before each, from ``(source_no, slots)``.

    Every slot throws for a shard; the throws of a source are counted where they are made.
    """
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("source_no"), F.col("throw")), F.lit(shards)).cast("int")
    thrown = numbered(slots.select("source_no", "slots"), "slots", "throw") \
        .groupBy("source_no", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    counts = thrown.groupBy("source_no").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("n"))
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.col("n")[k], F.lit(0).cast("long")))
    firsts = F.aggregate(each, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return counts.select("source_no", F.slice(firsts, 1, shards).alias("firsts"))


def draw(sources: DataFrame, *, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
         seed: int = SEED) -> DataFrame:
    """The block slots of the mix: ``(source_no, shard, index, pass_no, place, block, words)``.

    ``index`` counts a shard's slots of a source.  ``words`` is what a slot takes from the
    front of its block: the whole block, but for the last slot, which ends where the
    source's target is met.
    """
    per = F.lit(block_words)
    one = sources.where("source_size > 0").select(
        "source_no", "source_size", F.round("target").cast("long").alias("goal"),
        F.ceil(F.col("source_size") / per).cast("long").alias("blocks"))
    total = one.withColumn("slots", F.ceil(F.col("goal") / F.col("source_size")).cast("long") * F.col("blocks"))
    slots = numbered(total.join(shard_counts(total, shards, seed), "source_no"), "slots", "slot")
    slots = slots.withColumn("pass_no", F.floor(F.col("slot") / F.col("blocks")).cast("long")) \
        .withColumn("at", F.col("slot") % F.col("blocks"))
    key = F.xxhash64(F.lit(seed), F.col("source_no"), F.col("pass_no"))
    # slots are listed by the block they read; the permutation gives a block's place in the pass
    slots = slots.withColumn("place", permute(F.col("at"), F.col("blocks"), key)) \
        .withColumn("short_place", permute(F.col("blocks") - 1, F.col("blocks"), key))
    # only the stream's last block is short, so the words before a place need no sum:
    # all earlier blocks are full but for the short one, if it stands earlier
    short = F.col("blocks") * per - F.col("source_size")            # words the last block lacks
    before = F.col("pass_no") * F.col("source_size") + F.col("place") * per \
        - F.when(F.col("short_place") < F.col("place"), short).otherwise(0)
    length = per - F.when(F.col("at") == F.col("blocks") - 1, short).otherwise(0)
    number = F.col("pass_no") * F.col("blocks") + F.col("place")     # the slot of this pass and place
    # the last shard that begins at or before the slot; shards without slots begin where the next does
    shard = F.size(F.filter("firsts", lambda first: first <= number)) - 1
    return slots.withColumn("block", F.col("at")) \
        .withColumn("words", F.least(length, F.col("goal") - before)) \
        .where("words > 0") \
        .withColumn("shard", shard) \
        .withColumn("index", number - F.element_at("firsts", F.col("shard") + 1)) \
        .select("source_no", "shard", "index", "pass_no", "place", "block", "words")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents cut at block borders: ``(source_no, start, block, lo, hi)``; ``lo`` and
    ``hi`` are word positions inside the block."""
    per = F.lit(block_words)
    return placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / per),
                                      F.floor((F.col("start") + F.col("size") - 1) / per)))) \
        .select("doc_id", "uid", "size", "source_no", "start", "block",
                F.greatest(F.col("start") - F.col("block") * per, F.lit(0)).alias("lo"),
                F.least(F.col("start") + F.col("size") - F.col("block") * per, per).alias("hi"))


def mix(docs: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
        block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Plan of the mix, a row for each piece of a document that a slot takes.

    Input ``(doc_id, source, text)``; output ``(doc_id, uid, size, source_no, start, shard,
    index, pass_no, place, first_word, words)``: from word ``first_word`` (0 for the first)
    of the document ``words`` words stand in block ``index`` of the source in output shard
    ``shard``; a source's pieces follow each other by (pass_no, place).  ``(source_no,
    start)`` tells equal rows apart.  NULL and empty texts have no words and are never taken; a NULL source is a
    source of its own, ordered last; repeated rows are documents of their own.  The same
    input and seed give the same plan.
    """
    sized = stored(sizes(docs), "mix_sizes")
    sources = _sources(sized, weights, max_repeats)
    placed = positions(sized, sources)
    return _taken(placed, sources, block_words, shards, seed).select(
        "doc_id", "uid", "size", "source_no", "start", "shard", "index", "pass_no", "place",
        (F.col("block") * block_words + F.col("lo") - F.col("start")).alias("first_word"), "words")


def _words() -> Column:
    return F.regexp_extract_all("text", F.lit(WORD), F.lit(0))


def _with_text(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``taken``, joined on the row's key; equal rows are read once."""
    key = unused("mixed_uid", [*docs.columns, *taken.columns])
    rows = docs.withColumn(key, row_key(*docs.columns)).dropDuplicates([key])
    return rows.join(taken.withColumnRenamed("uid", key), key)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each pass over a document.

    A document that a pass takes whole keeps its text; of others the words taken stand
    in their order, joined by spaces.  ``n_chars``, if there, counts the new text.  All
    columns are those of the very row that is taken.
    """
    runs, count, size = (unused(n, docs.columns) for n in ("mixed_runs", "mixed_words", "mixed_size"))
    taken = mix(docs, **options).groupBy("uid", "size", "source_no", "start", "pass_no").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias(runs),
        F.sum("words").alias(count)).select("uid", F.col("size").alias(size), runs, count)
    part = F.concat_ws(" ", F.transform(F.array(_words()), lambda w: F.concat_ws(" ", F.flatten(F.transform(
        runs, lambda r: F.slice(w, (r["first_word"] + 1).cast("int"), r["words"].cast("int"))))))[0])
    out = _with_text(docs, taken).withColumn("text", F.when(F.col(count) == F.col(size), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix as packed blocks: ``(shard, source, index, n_words, text)``.

    A block holds up to ``block_words`` words of one source's stream, joined by spaces;
    ``(shard, source, index)`` is its address.  Blocks that the target ends in are shorter.
    """
    taken = mix(docs.select("doc_id", "source", "text"), **options) \
        .select("uid", "shard", "index", "start", "first_word", "words")
    piece = F.array_join(F.slice(_words(), (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ")
    narrow = docs.select("doc_id", "source", "text")
    rows = _with_text(narrow, taken) \
        .select("shard", "source", "index", "start", "first_word", "words", piece.alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("start") + F.col("first_word"), F.col("piece"))))
    return rows.groupBy("shard", "source", "index").agg(
        F.sum("words").alias("n_words"), F.array_join(F.transform(parts, lambda p: p["piece"]), " ").alias("text"))


def _taken(placed: DataFrame, sources: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    slots = draw(sources, block_words=block_words, shards=shards, seed=seed) \
        .withColumnRenamed("words", "slot_words")
    # the slots come from a few rows, which hides their number from the planner: a
    # merge join, as they grow with the input and must not be broadcast
    return pieces(placed, block_words).join(slots.hint("merge"), ["source_no", "block"]) \
        .withColumn("words", F.least("hi", "slot_words") - F.col("lo")).where("words > 0")


def taken_words(docs: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
                block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, n_shards)`` for every document, zeros
    included; ``n_shards`` is the number of shards that its words went to."""
    # the texts are counted once: three plans read these counts
    sized = stored(sizes(docs), "mix_sizes")
    sources = _sources(sized, weights, max_repeats)
    placed = positions(sized, sources)
    used = _taken(placed, sources, block_words, shards, seed) \
        .groupBy("source_no", "start").agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("n_shards"))
    full = placed.where("size > 0").join(used, ["source_no", "start"], "left")
    cols = ["doc_id", "size", "source_size", "target"]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")]
    none = [F.lit(0).cast("long").alias(c) for c in ("taken", "n_shards")]
    return full.select(*cols, *counts).unionByName(placed.where("size = 0").select(*cols, *none))
