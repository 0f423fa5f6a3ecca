"""Conversation structure repair by generalised LR parsing (operator 12).

The role sequence of a conversation is parsed with a grammar, ``RULES``: an optional
system turn, then user and assistant in turn.  The parser may not only keep (shift) a
row, it may also delete it, give it another role or insert an empty turn, each at a
price.  All choices are followed together on a graph-structured stack: stacks with the
same content are one node, shared by everything that grows on them, and of the ways that
end at one stack top only the cheapest goes on, the ASCII-least edit letters (``audit``)
among equally cheap ones.  The grammar is left-recursive, so reducing keeps the stack
short and there are only a handful of nodes.

On Spark: rows are ordered by range over all conversations, so a conversation that has a
third of all rows lies on many tasks, and numbered in slabs of ``SLAB`` rows.  A task
parses a conversation's part of a slab on its own: where it can't know the stack that the
part begins with, it parses from each node.  The parts' results (cost and letters from
node to node) meet per conversation and are chained; no text is moved for that.  The
letters chosen go back to the slabs, which turn into repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches, stored

#: The role grammar: fixed values.  Terminals are role initials.
START = "conversation"
RULES = ((START, ()), (START, ("s", "turns")), (START, ("turns",)), ("turns", ("turns", "u", "a")), ("turns", ("u", "a")))
#: Roles that a row can be given, and prices of the edits and of a kept truncated row.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: Rows of a slab.
SLAB_BITS = 8


class Automaton:
    """LR(0) states of a grammar: sets of items ``(rule, place of the dot)``."""

    def __init__(self, rules=RULES, start=START):
        self.rules = rules
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(k, 0) for k, (left, _) in enumerate(rules) if left == start})

    def _state(self, kernel: set) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            for k, (left, _) in enumerate(self.rules):
                if self._next(rule, dot) == left and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        key = frozenset(items)
        if key in self.states:
            return self.states.index(key)
        self.states.append(key)
        self.moves.append({})
        me = len(self.states) - 1
        for symbol in sorted({self._next(*i) for i in items} - {None}):
            self.moves[me][symbol] = self._state({(r, d + 1) for r, d in items if self._next(r, d) == symbol})
        return me

    def _next(self, rule: int, dot: int) -> str | None:
        right = self.rules[rule][1]
        return right[dot] if dot < len(right) else None

    def finished(self, state: int) -> list[int]:
        return [r for r, d in self.states[state] if d == len(self.rules[r][1])]


class Stacks:
    """All stacks as one graph: a node is a state on top of a node, made once."""

    def __init__(self, automaton: Automaton | None = None):
        self.lr = automaton or Automaton()
        self.nodes: list[tuple[int, int | None]] = [(self.lr.start, None)]
        self.number = {self.nodes[0]: 0}
        self.after: dict[tuple[int, str], list[int]] = {}
        roles = sorted({x for _, right in self.lr.rules for x in right if len(x) == 1})
        known = 0
        while known < len(self.nodes):                # every node that some roles lead to
            for role in roles:
                self.shift(known, role)
            known += 1

    def _push(self, node: int, symbol: str) -> list[int]:
        state = self.lr.moves[self.nodes[node][0]].get(symbol)
        if state is None:
            return []
        key = (state, node)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
        top, found = self.number[key], []
        ended = self.lr.finished(state)
        if self.lr.moves[state] or any(self.lr.rules[r][0] == START for r in ended):
            found.append(top)                         # more may follow, or the end
        for rule in ended:          # reduce; the start rule waits for the end
            left, right = self.lr.rules[rule]
            if left != START:
                below = top
                for _ in right:
                    below = self.nodes[below][1]
                found += self._push(below, left)
        return found

    def shift(self, node: int, role: str) -> list[int]:
        key = (node, role)
        if key not in self.after:
            self.after[key] = self._push(node, role)
        return self.after[key]

    def accepts(self, node: int) -> bool:
        state, below = self.nodes[node]
        for rule in self.lr.finished(state):
            left, right = self.lr.rules[rule]
            under = node
            for _ in right:
                under = self.nodes[under][1]
            if left == START and under == 0:
                return True
        return False


Front = dict[int, tuple[int, str]]                    # stack top -> cheapest (cost, audit)


def _better(front: Front, node: int, way: tuple[int, str]) -> bool:
    if node in front and front[node] <= way:
        return False
    front[node] = way
    return True


def inserts(stacks: Stacks, front: Front) -> Front:
    """The front after any number of inserted turns."""
    out, todo = dict(front), list(front)
    while todo:
        node = todo.pop()
        cost, audit = out[node]
        for role in ROLES:
            todo += [n for n in stacks.shift(node, role) if _better(out, n, (cost + INSERT, audit + "I"))]
    return out


def advance(stacks: Stacks, front: Front, initial: str, gone: bool, truncated: bool, copies: int) -> Front:
    """The front after a row and its copies; copies are duplicates, so they are deleted.

    A turn inserted between deleted rows stands after them instead: ``D`` sorts before ``I``.
    """
    out: Front = {}
    rest, extra = "D" * (copies - 1), DELETE * (copies - 1)
    for node, (cost, audit) in inserts(stacks, front).items():
        _better(out, node, (cost + extra + DELETE, audit + "D" + rest))
        if gone:
            continue
        price = cost + extra + TRUNCATED * truncated
        for n in stacks.shift(node, initial):
            _better(out, n, (price, audit + "K" + rest))
        for role in ROLES:
            for n in stacks.shift(node, role):
                _better(out, n, (price + REROLE, audit + "R" + rest))
    return out


def best_end(stacks: Stacks, front: Front) -> tuple[tuple[int, str], int]:
    """The cheapest complete way ``(cost, audit)`` and the top it had after the last row."""
    return min((way, node) for node in front for top, way in inserts(stacks, {node: front[node]}).items()
               if stacks.accepts(top))


# ---------------------------------------------------------------- rows and their faults
_GAP = r"\x20\x09-\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by row: dropped, emptied, without ``.!?``, repeated, made a user's."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                      F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.where("times > 0")


def _turn() -> Column:
    """Orders turns with NULL first."""
    return F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``(at, slab, conv_id, turn, role, text, copies, blank, seen, truncated)``, stored.

    Equal rows of a conversation are one row with ``copies``.  ``at`` numbers the rows in
    order of conversation, turn (NULL first), role and text; ``slab`` is a part of that order.
    """
    copies = F.sum("times") if "times" in rows.columns else F.count(F.lit(1))
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(copies.alias("copies")) \
        .withColumn("words", F.md5("text"))
    first = each.groupBy(F.col("conv_id").alias("first_conv"), F.col("role").alias("first_role"),
                         F.col("words").alias("first_words")).agg(F.min(_turn()).alias("first_turn"))
    same = (F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("role") == F.col("first_role"))
            & (F.col("words") == F.col("first_words")))
    blank = ~F.col("text").rlike(f"[^{_GAP}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{_GAP}]*\z")
    ordered = ["conv_id", "turn", "role", "text"]
    out = each.join(first, same).select(*ordered, "copies", blank.alias("blank"), (_turn() > F.col("first_turn")).alias("seen"),
                                        truncated.alias("truncated")) \
        .repartitionByRange(*ordered).sortWithinPartitions(*ordered) \
        .withColumn("at", F.monotonically_increasing_id())
    return stored(out.withColumn("slab", F.shiftright("at", SLAB_BITS)), "repair_rows")


# ---------------------------------------------------------------- parsing
_WAY = "array<struct<start:int,stop:int,cost:long,audit:string>>"
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _conv_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    name = rows.schema["conv_id"].dataType.simpleString()
    return name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _parse(conv_type: pa.DataType):
    """Rows in order -> a part's ways from each stack it may begin with, a row per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks = Stacks()
        for slab, rows in groupby(_rows_of(batches), key=lambda r: r[0]):
            found = []
            for k, (conv, part) in enumerate(groupby(rows, key=lambda r: r[2])):
                # only the first conversation of a slab can have begun before it
                fronts = {n: {n: (0, "")} for n in (range(len(stacks.nodes)) if k == 0 else [0])}
                first, last, illegal = None, None, 0
                for _, _, _, initial, gone, truncated, copies in part:
                    fronts = {n: advance(stacks, f, initial, gone, truncated, copies) for n, f in fronts.items()}
                    illegal += copies - 1 + (last is not None and last + initial not in LEGAL)
                    first, last = initial if first is None else first, initial
                ways = [{"start": a, "stop": b, "cost": c, "audit": x} for a, f in fronts.items() for b, (c, x) in f.items()]
                found.append((conv, slab, first, last, illegal, ways))
            types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), _WAYS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate(types)],
                ["conv_id", "slab", "first", "last", "illegal", "ways"])
    return run


def _chain(conv_type: pa.DataType):
    """Parts in order -> the letters chosen for each, a conversation's totals on its first part."""
    names = ["conv_id", "slab", "parts", "letters", "before", "lead", "illegal", "cost", "audit"]
    types = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks = Stacks()
        for conv, parts in groupby(_rows_of(batches), key=lambda r: r[0]):
            front: Front = {0: (0, "")}
            slabs, back, last, illegal = [], [], None, 0
            for _, slab, first, end, wrong, ways in parts:
                after, came = {}, {}
                for w in ways:
                    if w["start"] in front:
                        cost, audit = front[w["start"]]
                        if _better(after, w["stop"], (cost + w["cost"], audit + w["audit"])):
                            came[w["stop"]] = w["start"], w["audit"]
                illegal += wrong + (last is not None and last + first not in LEGAL)
                front, last = after, end
                slabs.append(slab)
                back.append(came)
            (cost, audit), node = best_end(stacks, front)
            letters, tail = [], audit[len(front[node][1]):]      # turns inserted after the last row
            for came in reversed(back):
                node, text = came[node]
                letters.append(text + tail)
                tail = ""
            letters.reverse()
            kept = [len(x) - x.count("D") for x in letters]
            out = [(conv, s, len(slabs), x, sum(kept[:k]), sum(kept) % 2, illegal if not k else None, cost if not k else None,
                    audit if not k else None) for k, (s, x) in enumerate(zip(slabs, letters, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
    return run


def parse(rows: DataFrame) -> DataFrame:
    """``(conv_id, slab, parts, letters, before, lead, illegal, cost, audit)`` of numbered rows, stored."""
    conv, conv_type = _conv_type(rows)
    thin = rows.select("slab", "at", "conv_id", F.substring("role", 1, 1).alias("initial"),
                       (F.col("blank") | F.col("seen")).alias("gone"), "truncated", "copies")
    parts = map_batches(thin.repartition("slab").sortWithinPartitions("slab", "at"), _parse(conv_type),
                        f"conv_id {conv}, slab long, first string, last string, illegal long, ways {_WAY}")
    return stored(map_batches(parts.repartition("conv_id").sortWithinPartitions("conv_id", "slab"), _chain(conv_type),
                              f"conv_id {conv}, slab long, parts long, letters string, before long, lead int, illegal long, cost long, audit string"),
                  "repair_letters")


_LINES = "array<struct<position:long,role:string,text:string>>"
_LINE_LIST = pa.list_(pa.struct([("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _apply(conv_type: pa.DataType):
    """Each slab's letters, then its rows -> the repaired lines of each conversation's part."""
    names, types = ["conv_id", "slab", "parts", "lines"], [conv_type, pa.int64(), pa.int64(), _LINE_LIST]

    def add(plan: dict, role: str | None, text: str) -> None:
        given = ROLES["u" if (plan["at"] - plan["lead"]) % 2 == 0 else "a"]
        plan["lines"].append({"position": plan["at"], "role": given if role is None else role, "text": text})
        plan["at"] += 1

    def insert(plan: dict) -> None:
        while plan["letters"][plan["next"]:plan["next"] + 1] == "I":
            plan["next"] += 1
            add(plan, None, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, rows in groupby(_rows_of(batches), key=lambda r: r[0]):
            plans: dict = {}
            for _, _, conv, parts, letters, before, lead, role, text, copies in rows:
                if letters is not None:
                    plans[conv] = {"letters": letters, "at": before, "lead": lead, "next": 0, "parts": parts, "lines": []}
                    insert(plans[conv])
                    continue
                plan = plans[conv]
                letter = plan["letters"][plan["next"]]
                plan["next"] += copies                # the copies behind it are deleted
                if letter != "D":
                    add(plan, role if letter == "K" else None, text)
                insert(plan)
            out = [(conv, slab, p["parts"], p["lines"]) for conv, p in plans.items() if p["lines"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
    return run


def repaired_parts(rows: DataFrame, letters: DataFrame) -> DataFrame:
    """``(conv_id, slab, parts, lines)``: the conversations after their edits, a row for each
    slab that a conversation lies on (``parts`` of them); a slab bounds the lines of a row."""
    conv, conv_type = _conv_type(rows)
    plans = letters.select("slab", F.lit(-1).cast("long").alias("at"), "conv_id", "parts", "letters", "before", "lead")
    both = plans.unionByName(rows.select("slab", "at", "conv_id", "role", "text", "copies"), allowMissingColumns=True)
    return map_batches(both.repartition("slab").sortWithinPartitions("slab", "at"), _apply(conv_type),
                       f"conv_id {conv}, slab long, parts long, lines {_LINES}")


def _digests(conv_type: pa.DataType):
    """Pieces of conversations in order -> SHA-256 of each conversation, fed piece by piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, pieces in groupby(_rows_of(batches), key=lambda r: r[0]):
            digest = hashlib.sha256()
            for k, (_, _, piece) in enumerate(pieces):
                digest.update(("\n" if k else "").encode() + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([digest.hexdigest()])],
                                             ["conv_id", "repaired_sha256"])
    return run


def digests(parts: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` over ``role:text`` lines of :func:`repaired_parts`.

    A conversation on one slab is hashed where it is.  A digest runs over its text from
    first to last, so one task is fed the pieces of a conversation that lies on many slabs.
    """
    conv, conv_type = _conv_type(parts)
    lines = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    pieces = parts.select("conv_id", "slab", "parts", F.array_join(lines, "\n").alias("piece"))
    whole = pieces.where("parts = 1").select("conv_id", F.sha2("piece", 256).alias("repaired_sha256"))
    split = pieces.where("parts > 1").select("conv_id", "slab", "piece")
    return whole.unionByName(map_batches(split.repartition("conv_id").sortWithinPartitions("conv_id", "slab"),
                                         _digests(conv_type), f"conv_id {conv}, repaired_sha256 string"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest repair of every conversation: ``(summary, repaired parts)``.

    ``summary`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; the
    parts are those of :func:`repaired_parts`, :func:`lines_of` makes rows of them.  Rows (``conv_id, turn, role,
    text``; ``times`` if a row counts several times) stand by turn, NULL first, equal turns
    by role and text.  NULL roles and texts are one space, a NULL ``conv_id`` is a
    conversation of its own.  A row's first fault counts: blank, seen earlier with role and
    text, not ended by one of ``.!?``.  Roles are judged by their first character.  Other
    columns are not read.  A conversation's audit is one value, so the letters of all its
    rows meet in one task; its texts don't.
    """
    wanted = [c for c in ("conv_id", "turn", "role", "text", "times") if c in conversations.columns]
    clean = conversations.select(*wanted).withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    rows = numbered_rows(clean)
    letters = parse(rows)
    fresh = ~F.col("blank") & ~F.col("seen")
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum((fresh & F.col("truncated")).cast("long")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy(F.col("conv_id").alias("counted")).agg(
        gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    totals = letters.where("audit IS NOT NULL").select("conv_id", "illegal", "cost", "audit")
    summary = counts.join(totals, F.col("counted").eqNullSafe(F.col("conv_id"))) \
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, stored(repaired_parts(rows, letters), "repair_parts")


def lines_of(parts: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the repaired conversations, a row for each turn."""
    return parts.select("conv_id", F.inline("lines"))


def report(conversations: DataFrame) -> DataFrame:
    """Repair of the damaged conversations: counts, cost, audit and digest of every ``conv_id``."""
    summary, parts = repair(damage(conversations))
    hashed = digests(parts).withColumnRenamed("conv_id", "hashed")
    every = conversations.select(F.col("conv_id").alias("every")).distinct()
    out = every.join(summary, F.col("every").eqNullSafe(F.col("conv_id")), "left").drop("conv_id") \
        .join(hashed, F.col("every").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
