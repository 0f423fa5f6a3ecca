"""Substring dedup, conversation repair and ranked search against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import pytest

from basketlens.llm import ranked_search, role_repair, seed_extend
from basketlens.llm.queries import QUERIES
from tests.llm.helpers import LONG, PASSAGE, ROWS, docs, words

R = random.Random(11)


# ---------------------------------------------------------------- repeated windows of words
def plain_removal(rows, w=13):
    first = {}
    for i, t in rows:
        s = words(t)
        for k in range(len(s) - w + 1):
            if i is not None:
                x = tuple(s[k:k + w])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        s = words(t)
        gone = [False] * len(s)
        for k in range(len(s) - w + 1):
            if i is not None and first[tuple(s[k:k + w])] < i:
                gone[k:k + w] = [True] * w
        kept = " ".join(x for x, g in zip(s, gone) if not g)
        out.append((i, len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def removal(spark, rows, parts=3):
    got = seed_extend.report(docs(spark, rows).repartition(parts)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr)


def test_removal_on_awkward_rows(spark):
    assert removal(spark, ROWS) == plain_removal(ROWS)
    assert seed_extend.report(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n_words", [1, 2, 40])
def test_removal_on_random_texts(spark, n_words):
    """Few word forms: long runs, anchors with very many zones, repeats inside a text."""
    r = random.Random(n_words)
    form = [f"w{k}" for k in range(n_words)]
    shared = [[r.choice(form) for _ in range(r.randint(5, 40))] for _ in range(6)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(r.randint(0, 6)):
            text += r.choice(shared) if r.random() < 0.6 else [r.choice(form) for _ in range(r.randint(1, 30))]
        rows.append((r.randint(0, 50), r.choice([" ", "\n", " \t"]).join(text)))
    assert removal(spark, rows) == plain_removal(rows)


def test_passage_shared_by_many(spark):
    """Every document goes on differently after the passage: each has its own end zones."""
    rows = [(k, f"{R.random()} {R.random()} " + PASSAGE + f" {R.random()} x{k} y z") for k in range(300)]
    rows += [(1000 + k, " ".join(PASSAGE.split()[k:k + 13])) for k in range(0, 40, 5)]
    assert removal(spark, rows) == plain_removal(rows)


def test_repeats_are_maximal_runs(spark):
    head, tail = LONG.split()[:30], LONG.split()[100:140]
    rows = [(1, " ".join(head)), (2, " ".join(tail)), (3, " ".join(["new", *head, "between", *tail[:20], "end"]))]
    got = {r.doc_id: r for r in seed_extend.remove_repeats(docs(spark, rows)).collect()}
    assert [(x.start, x.end) for x in got[3].repeats] == [(1, 31), (32, 52)]
    assert got[3].kept == "new between end" and got[1].repeats == []


def test_word_hashes_in_pieces(monkeypatch):
    texts = [b"a bb ccc", b"", b"  ", b"x" * 500 + b" tail", b"a bb ccc"]
    whole, offsets = seed_extend.word_hashes(texts)
    assert offsets.tolist() == [0, 3, 3, 3, 5, 8] and whole[:3].tolist() == whole[5:].tolist()
    monkeypatch.setattr(seed_extend, "PIECE", 16)
    monkeypatch.setattr(seed_extend.Stretches, "_powers", {})
    assert seed_extend.word_hashes(texts)[0].tolist() == whole.tolist()


# ---------------------------------------------------------------- conversations
CONV = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for c, n, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, n, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's damaged rows: shortest way over (rows read, state), state by state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        inner = words(text)
        faults.append("blank" if not inner else "duplicate" if (role, text) in seen
                      else "truncated" if inner[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("e", "u"): "u", ("u", "a"): "e"}
    front = {"": (0, "", ())}

    def put(to, key, way):
        if key not in to or way[:2] < to[key][:2]:
            to[key] = way
            return True
        return False

    def closed(front):
        front, again = dict(front), True
        while again:
            again = False
            for s, (c, a, out) in list(front.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if (s, x) in step:
                        again |= put(front, step[s, x], (c + 5, a + "I", (*out, role + ":")))
        return front

    for (_, _, role, text), fault in zip(rows, faults):
        now = {}
        for s, (c, a, out) in closed(front).items():
            put(now, s, (c + 2, a + "D", out))
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                if (s, role[:1]) in step:
                    put(now, step[s, role[:1]], (c, a + "K", (*out, f"{role}:{text}")))
                for x, given in (("u", "user"), ("a", "assistant")):
                    if (s, x) in step:
                        put(now, step[s, x], (c + 1, a + "R", (*out, f"{given}:{text}")))
        front = now
    cost, audit, out = min(v for s, v in closed(front).items() if s in ("", "e"))
    turns = {r[1] for r in rows} - {None}
    count = Counter(faults)
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_report(rows):
    left = {}
    for r in plain_damage(rows):
        left.setdefault(r[0], []).append(r)
    return sorted(((c, *plain_repair(left.get(c, []))) for c in {r[0] for r in rows}), key=repr)


def repairs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, CONV)
    if extra:
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in ("at", "slab", "audit", "cost", "letters", "copies", "times", "words", "blank")])
    got = role_repair.report(df).collect()
    assert got == [] or got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                              "repaired_sha256"]
    return sorted((tuple(r) for r in got), key=repr)


def random_conversations(n, seed, most=12):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for _ in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula"])
            text = r.choice([f"text {r.randint(0, 9)}.", f"cut {r.randint(0, 9)}", "Why?", "...", " \n", "", None, "end!\t\n"])
            rows.append((c if r.random() < 0.97 else None, r.choice([None, *range(most + 4)]), role, text))
    return rows


def test_repair_of_random_conversations(spark):
    rows = random_conversations(250, 3)
    rows += [(900, 5, "user", "same.")] * 4 + [(901, None, None, None)]
    assert repairs(spark, rows, extra=True) == plain_report(rows)
    empty = spark.createDataFrame([], CONV)
    assert role_repair.report(empty).count() == 0


def test_repair_of_a_long_conversation(spark):
    """One conversation over many slabs and tasks, begun in the middle of a slab."""
    r = random.Random(5)
    rows = random_conversations(30, 8) + [
        (15, n, r.choice(["user", "assistant"]), r.choice([f"text {n}.", "again.", f"cut {n}"])) for n in range(1, 2600)]
    assert repairs(spark, rows) == plain_report(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello there."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?"),
            (2, 0, "user", "Fine."), (2, 1, "assistant", "Yes."), (3, 0, "user", " ")]
    summary, parts = role_repair.repair(spark.createDataFrame(rows, CONV))
    got = {r.conv_id: (r.duplicate, r.cost, r.audit) for r in summary.collect()}
    assert got == {1: (1, 5, "DKDR"), 2: (0, 0, "KK"), 3: (0, 2, "D")}
    assert sorted(map(tuple, role_repair.lines_of(parts).collect())) == [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "So?"), (2, 0, "user", "Fine."), (2, 1, "assistant", "Yes.")]


def test_stack_graph_is_small_and_generic():
    stacks = role_repair.Stacks()
    assert len(stacks.nodes) < 16 and stacks.accepts(0)
    front = {0: (0, "")}
    for initial in "sua":
        front = role_repair.advance(stacks, front, initial, False, False, 1)
    assert role_repair.best_end(stacks, front)[0] == (0, "KKK")


# ---------------------------------------------------------------- ranked search
def plain_terms(t):
    t = (t or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)


def plain_ranking(rows, items, k=10):
    found = [(i, Counter(plain_terms(t))) for i, t in rows]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(c.total() for _, c in found)
    df = Counter(x for _, c in found for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 25 + 75 * c.total() * n_docs // total
            scores.append((sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * c[x] // (1000 * c[x] + 8 * m))
                               for x in plain_terms(text) if x in c), i))
        scores = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def ranking(spark, rows, items, **kw):
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS score", "'y' AS rank", "'z' AS item")
    got = ranked_search.search(docs(spark, rows).repartition(3), asked, **kw).collect()
    return sorted((tuple(r) for r in got), key=repr)


ITEMS = [(1, PASSAGE), (2, "stone STONE the moon"), (3, None), (4, ""), (5, "…"), (6, "no such term"), (6, "River river"), (None, "漢字 ab12"),
         (7, "river stone the moon"), (7, "river stone the moon")]


def test_ranking_of_awkward_rows(spark):
    assert ranking(spark, ROWS, ITEMS) == plain_ranking(ROWS, ITEMS)
    assert ranking(spark, ROWS, ITEMS, k=2) == plain_ranking(ROWS, ITEMS, 2)
    assert ranked_search.search(docs(spark).limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert ranked_search.search(docs(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_ranking_over_many_blocks(spark, monkeypatch):
    r = random.Random(4)
    form = [f"t{k}" for k in range(300)]
    draw = [k ** -0.8 for k in range(1, 301)]
    rows = [(k % 400, " ".join(r.choices(form, draw, k=r.randint(0, 80)))) for k in range(900)]
    items = [(k, " ".join(r.choices(form, draw, k=12))) for k in range(40)]
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 700)          # several sets of items
    assert ranking(spark, rows, items) == plain_ranking(rows, items)


def test_blocks_and_elimination(monkeypatch):
    """Small blocks of documents and of terms give the same; the bounds leave most documents out."""
    r = random.Random(6)
    langs = [[f"{x}{k}" for k in range(200)] for x in "abcd"]
    rows = [(k, " ".join(r.choices(langs[k % 4], [j ** -1.0 for j in range(1, 201)], k=60))) for k in range(2000)]
    items = [(k, rows[37 * k][1][:150]) for k in range(20)]
    found = Counter(x for _, t in rows for x in set(ranked_search.terms(t)))
    total = sum(len(ranked_search.terms(t)) for _, t in rows)
    order = sorted(found, key=lambda x: (-found[x], x))
    corpus = ranked_search.Corpus(len(rows), total, {x: k for k, x in enumerate(order)},
                                  ranked_search.np.array([ranked_search.weight(len(rows), found[x]) for x in order]))
    monkeypatch.setattr(ranked_search, "TERM_BLOCK", 50)
    blocks = ranked_search.item_blocks([ranked_search.terms(t) for _, t in items], corpus)
    assert len(blocks) > 3
    best, scored = [ranked_search.Best(10) for _ in items], 0
    for at in range(0, 2000, 500):
        block = ranked_search.Block(corpus)
        for i, t in rows[at:at + 500]:
            block.add(i, t)
        scored += block.search(blocks, best)
    got = sorted(((q, -i, s) for q, b in enumerate(best) for s, _, i in b.heap), key=repr)
    assert got == sorted(((q, i, s) for q, _, i, s in plain_ranking(rows, items)), key=repr)
    assert scored < 0.35 * len(rows) * len(items)


@pytest.mark.parametrize("name", ["op11_seed_extend", "op13_ranked_search"])
def test_plans_have_no_cross_join(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
