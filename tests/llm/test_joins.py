"""Operators that compare rows: fingerprints, repeats, URL rules, mixing, top-k, near-duplicates."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from basketlens.llm import fingerprints, minhash_join, mixing, suffix_dedup, topk, url_filter
from tests.llm.helpers import LONG, PASSAGE, ROWS, docs, near_components, words

WORDS_OF = LONG.split()


# ---------------------------------------------------------------- fingerprints
def test_fingerprints_of_awkward_rows(spark):
    got = fingerprints.report(docs(spark)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - h] + u[:h]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[6] == prints[7] and prints[4] == prints[15] and prints[1] == prints[3] == ""
    assert next(r for r in got if r.doc_id == 6).near_next == 1.0
    assert fingerprints.fingerprints(docs(spark).limit(0)).count() == 0
    assert fingerprints.report(docs(spark).limit(0)).count() == 0
    one = fingerprints.report(docs(spark, [(1, "a b c d e f g h")])).first()
    assert one.near_next == 1.0 and one.n_chars == 15


def test_syncmers_do_not_depend_on_their_context(spark):
    rows = [(1, PASSAGE), (2, LONG[:300] + " " + PASSAGE + " " + LONG[300:600])]
    found = {}
    for r in fingerprints.anchors(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.position, r.hash))
    inside = {h for _, h in found[2]}
    assert len(found[1]) > 20 and {h for _, h in found[1]} <= inside
    shift = {p2 - p1 for p1, h1 in found[1] for p2, h2 in found[2] if h1 == h2}
    assert len(shift) < 5                       # shared anchors stand at one distance


def plain_links(found):
    found = [(p, h & 0xFFFFFFFF) for p, h in sorted(found)]
    return {(h1, p2 - p1, h2) for (p1, h1), (p2, h2) in zip(found, found[1:])} or {h for _, h in found}


def test_likeness_is_of_all_anchors_by_position(spark):
    r = random.Random(8)
    text = [" ".join(str(r.randrange(10 ** 6)) for _ in range(n)) for n in (9000, 120, 8000)]
    passage = text[1] + " " + " ".join(text[0].split()[:20])
    scattered = " ".join(w for k in range(100) for w in [*text[2].split()[70 * k:70 * k + 4], str(r.random())])
    rows = [(1, text[0] + " " + passage + " " + text[2][:900]), (2, text[2][-20000:] + " " + passage), (3, text[2]), (4, scattered),
            (5, "a"), (6, "one two three four five six seven"), (7, "seven six five four three two one"), (8, text[1])]
    found = {i: [] for i, _ in rows}
    for a in fingerprints.anchors(docs(spark, rows)).collect():
        found[a.doc_id].append((a.position, a.hash))
    want = {i: plain_links(f) for i, f in found.items()}
    got = {x.doc_id: x for x in fingerprints.report(docs(spark, rows)).collect()}
    for i, _ in rows:
        a, b = want[i], want[i % len(rows) + 1]
        assert got[i].near_next == len(a & b) / len(a | b), i
        prints, at, place = got[i].fingerprint, 0, []
        for k in range(0, len(prints), 9):
            at += int(prints[k], 16)
            place.append((at, int(prints[k + 1:k + 9], 16)))
        assert place == [(p, h & 0xFFFFFFFF) for p, h in sorted(found[i])]
    assert 0 < got[1].near_next < 0.02 and got[2].near_next > 0.2 and got[6].near_next == 0


@pytest.mark.parametrize("alphabet", [
    "".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0x0E01, 0x0E2F))), "".join(map(chr, range(0x20000, 0x20400))),
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abc.(){};=&?%/"], ids=["han", "thai", "rare", "base64", "code"])
def test_near_copies_of_unspaced_texts_are_alike(spark, alphabet):
    r = random.Random(9)
    text = "".join(r.choices(alphabet, k=600))
    rows = [(1, text), (2, text[0] + text), (3, "".join(r.choices(alphabet, k=300)) + text)]
    got = {x.doc_id: x.near_next for x in fingerprints.report(docs(spark, rows)).collect()}
    assert 0.95 < got[1] <= 1 and 0.5 < got[2] < 0.8


def test_unspaced_characters_are_tokens(spark):
    rows = [("abcdefg hi",), ("ab漢字cdefg\u0e01😀x",), ("x" * 24,), ("ab " + "y" * 25 + "漢 abcde",), (" \t",)]
    got = [x[0] for x in spark.createDataFrame(rows, "text string").coalesce(1).select(fingerprints.tokens(F.col("text"))).collect()]
    assert got == [["abcd", "efg", "hi"], ["ab", "漢", "字", "cdef", "g", "\u0e01", "😀", "x"], ["xxxx"] * 6,
                   ["ab", *"y" * 25, "漢", "abcd", "e"], []]


def test_next_rows_over_many_buckets(spark):
    r = random.Random(2)
    ids = r.sample(range(10 ** 12), 500)
    d = docs(spark, [(i, f"t{i}") for i in ids]).repartition(7)
    got = {x.doc_id: x.next_text for x in fingerprints.with_next(d, ["text"]).collect()}
    ids.sort()
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


# ---------------------------------------------------------------- repeated windows
def plain_repeats(rows, w=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - w + 1):
                x = b[k:k + w]
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - w + 1):
                if first[b[k:k + w]] < i:
                    gone[k:k + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_of_awkward_rows(spark):
    r = random.Random(4)
    noise = "".join(r.choice("abcdefgh ") for _ in range(700_000))          # longer than a chunk
    edge = suffix_dedup.CHUNK
    rows = [*ROWS, (30, noise), (31, "y" * 49), (32, "z" + "y" * 49), (33, "q" * 200), (34, noise[edge - 40:edge + 30]),
            (35, noise[100:149]), (36, noise[100:150]), (37, "é" * 30 + noise[90:150]), (29, noise[200:260] + noise[5000:5060])]
    got = suffix_dedup.report(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_repeats(rows)
    assert suffix_dedup.report(docs(spark).limit(0)).count() == 0


def test_repeats_in_a_hot_passage(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["ab", "cd", "efg", "hi"]) + str(r.randint(0, 9)) for _ in range(r.randint(5, 60)))
             + (PASSAGE if k % 3 == 0 else PASSAGE[k:k + 70] if k % 3 == 1 else "")) for k in range(120)]
    got = suffix_dedup.report(docs(spark, rows, extra=False))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_repeats(rows)


@pytest.mark.parametrize("crowd, bucket, send", [(16, 3000, 250_000), (2, 3000, 400), (1, 1 << 20, 5000)])
def test_repeats_over_many_buckets(spark, monkeypatch, crowd, bucket, send):
    """Many buckets and pages, small sends, and first digits that are known to be shared in
    their task: passages whose ends differ in every document."""
    for name, value in (("CROWD", crowd), ("BUCKET_BYTES", bucket), ("SEND", send)):
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(crowd)
    form = ["ab", "cd", "efg", "hi"]
    rows = []
    for k in range(160):
        own = [" ".join(r.choice(form) + str(r.randint(0, 30)) for _ in range(r.randint(3, 40))) for _ in range(2)]
        middle = PASSAGE if k % 3 == 0 else PASSAGE[k:k + 60] if k % 3 == 1 else "xy" * r.randint(0, 60)
        rows.append((r.randint(0, 140), own[0] + middle + own[1]))
    got = suffix_dedup.report(docs(spark, rows, extra=False).repartition(3))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_repeats(rows)


def test_crowded_digits_send_two_documents(spark):
    import numpy as np
    key = np.repeat(np.array([5, 9], np.uint64), [100, 3])
    check, doc = np.arange(103, dtype=np.uint32), np.arange(103)[::-1].copy()
    sent, told = 0, 0
    for batch in suffix_dedup._announce(key, check, doc, 1, True):
        for row in batch.to_pylist():
            if row["entries"] is not None:
                sent += len(suffix_dedup._entries(row["entries"])[0])
            if row["edge"] is not None:
                told += len(suffix_dedup.unpacked(row["edge"], "<i8", "<u8")[0])
    assert (sent, told) == (5, 100)


# ---------------------------------------------------------------- URL rules
def plain_judgement(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:n].translate({k: k + 32 for k in range(65, 91)}), rest[n:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_rules(spark):
    r = random.Random(8)
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "http://a.example.org/es/x?y#z", "http://example.org/en/12",
            "http://xexample.org/es/", "https://example.org", "http://u@m.example.org:80/es/", "s://org?x/://y", "http://example.org/en/1",
            "http://" + "a." * 3000 + "example.org/es/" + "p" * 5000, "http://.org/", "x\ny://example.org/es/\nq", "http://com/de/", "http://ü.com/fr/"]
    urls += ["http://" + ".".join(r.choice(["a", "example", "org", "com"]) for _ in range(r.randint(1, 4)))
             + r.choice(["", "/", "/es/", "/en/1", "/fr/x", "/de/"]) + r.choice(["", "?q", "#f"]) for _ in range(200)]
    rows = [(None if k == 3 else k // 2, u, "x", "y") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, short string")
    got = url_filter.judge(pages, url_filter.fixed_rules(spark)).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain_judgement(u)) for i, u, *_ in rows), key=repr)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert url_filter.judge(pages.limit(0), url_filter.fixed_rules(spark)).count() == 0
    none = url_filter.judge(pages, url_filter.fixed_rules(spark).limit(0), default="block")
    assert {(x.rule, x.verdict) for x in none.collect()} == {(None, "block")}


def test_url_rules_that_repeat_or_tie(spark):
    rules = spark.createDataFrame([("a.b", "/", "block"), ("a.b", "/", "allow"), ("b", "/xx", "allow"), ("a.b", None, "block"),
                                   (None, "/", "block")], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "h://a.b/xx"), (2, "h://a.b/"), (3, "h://a.b"), (4, "h://b/xxx")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("a.b/", "allow"), 2: ("a.b/", "allow"), 3: ("a.b", "block"), 4: ("b/xx", "allow")}


# ---------------------------------------------------------------- mixing
def test_targets_share_out_what_caps_cut_off():
    t = mixing.targets([("b", 1000), ("a", 10), (None, 1000), ("c", 0)])
    # a weighs 5, b 2, c 1, NULL 5; a is capped at 30, c at 0
    assert t["a"] == 30 and t["c"] == 0 and math.isclose(sum(t.values()), 2010)
    assert math.isclose(t["b"] / t[None], 2 / 5)
    assert mixing.targets([("a", 10)]) == {"a": 10.0} and mixing.targets([]) == {}


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 17, 100, 1000):
        df = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n), F.lit(5)).alias("a"),
                                   mixing.permute(F.col("id"), F.lit(n), F.lit(6)).alias("b"))
        rows = df.collect()
        assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
        assert n < 10 or [r.a for r in rows] != [r.b for r in rows]


def mixed_rows():
    r = random.Random(9)
    return [*ROWS, *[(100 + k, " ".join(f"w{r.randint(0, 50)}" for _ in range(r.randint(0, 400)))) for k in range(150)]]


def test_mixing_meets_its_targets(spark):
    rows = mixed_rows()
    got = mixing.taken_words(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == \
        sorted((i, len(words(t))) for i, t in rows if i is not None)
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    by_source = {}
    for r in got:
        n, goal, taken = by_source.get(r.source_size, (0, r.target, 0))
        assert goal == r.target
        by_source[r.source_size] = (n + r.size, goal, taken + r.taken)
    assert all(n == size and taken == round(goal) for size, (n, goal, taken) in by_source.items())
    again = mixing.taken_words(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.taken_words(docs(spark).limit(0)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [r for r in mixed_rows()]
    d = docs(spark, rows)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    taken, mixed, texts = {}, {}, dict(rows)
    for r in mixing.taken_words(d).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for r in out.collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
        if r.doc_id is not None and r.doc_id != 10:
            it = iter(words(texts[r.doc_id]))
            assert all(w in it for w in words(r.text))       # in their order
    assert mixed == {i: n for i, n in taken.items() if n}


def test_shard_counts_decide_the_slots(spark):
    """The counts per (shard, source) are the drawn ones, every slot is dealt once, and another
    number of shards draws anew."""
    rows = mixed_rows()
    d = docs(spark, rows, extra=False)
    sized = mixing.sizes(d)
    sources = mixing._sources(sized, mixing.WEIGHTS, 3)
    slots = mixing.draw(sources, block_words=16, shards=5).collect()
    by_source = {r.source_no: r for r in sources.collect()}
    for no, r in by_source.items():
        own = [x for x in slots if x.source_no == no]
        blocks = -(-r.source_size // 16)
        assert sum(x.words for x in own) == round(r.target)
        assert len({(x.pass_no, x.place) for x in own}) == len({(x.pass_no, x.block) for x in own}) == len(own)
        total = -(-round(r.target) // r.source_size) * blocks if r.source_size else 0
        drawn = [0] * 5
        if total:
            throws = spark.range(total).select(F.pmod(F.xxhash64(
                F.lit(mixing.SEED), F.lit("shard"), F.lit(no), F.col("id")), F.lit(5)).alias("k")).collect()
            for x in throws:
                drawn[x.k] += 1
        firsts = [sum(drawn[:k]) for k in range(5)]
        for x in own:
            number = x.pass_no * blocks + x.place
            assert firsts[x.shard] <= number < firsts[x.shard] + drawn[x.shard] and x["index"] == number - firsts[x.shard]
    plan = {n: sorted((r.start, r.first_word, r.shard) for r in mixing.mix(d, shards=n).collect()) for n in (1, 7)}
    assert {s for *_, s in plan[1]} == {0} and len({s for *_, s in plan[7]}) > 3


def test_packed_shards_hold_the_words_taken(spark):
    rows = mixed_rows()
    d = docs(spark, rows)
    blocks = mixing.mixed_shards(d, block_words=32, shards=6).collect()
    assert all(len(words(b.text)) == b.n_words <= 32 for b in blocks)
    assert len({(b.shard, b.source, b["index"]) for b in blocks}) == len(blocks)
    taken = mixing.taken_words(d, block_words=32, shards=6).collect()
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in taken)
    assert all((r.n_shards > 0) == (r.taken > 0) and r.n_shards <= 6 for r in taken)
    known = {}
    for k, (i, t) in enumerate(rows):
        known.setdefault(None if k % 4 == 0 else f"src{k % 3}", set()).update(words(t))
    assert all(set(words(b.text)) <= known[b.source] for b in blocks)


def test_rows_of_two_sources_are_told_apart(spark):
    text = " ".join(WORDS_OF[:200])
    d = spark.createDataFrame([(1, text, "en", "x", 5), (1, text, "de", "y", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    goal = mixing.targets([("x", 200), ("y", 200)])
    got = {"x": 0, "y": 0}
    for r in mixing.mixed_documents(d).collect():
        assert r.lang == {"x": "en", "y": "de"}[r.source]
        got[r.source] += len(words(r.text))
    assert got == {s: round(g) for s, g in goal.items()}


def test_stream_chunks_stay_small(spark):
    """NULL ids and copies are spread: a chunk's window holds few distinct rows."""
    rows = [(None, f"text number {k} of them") for k in range(3000)] + [(5, "the same again")] * 9000
    d = docs(spark, rows, extra=False).withColumn("source", F.lit("one"))
    placed = mixing.positions(mixing.sizes(d), mixing._sources(mixing.sizes(d), mixing.WEIGHTS, 3))
    got = sorted((r.start, r.size) for r in placed.collect())
    assert len(got) == 12000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    per = mixing.sizes(d).select("uid").distinct().groupBy(F.pmod(F.xxhash64("uid"), F.lit(mixing.CHUNKS))).count()
    assert per.agg(F.max("count")).first()[0] < 12


# ---------------------------------------------------------------- top-k
def plain_topk(rows, k=5):
    good = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows
            if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q, x in {i: x for i, x in sorted(good, key=lambda r: (r[0], r[1]), reverse=True)}.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, n, i, -v) for n, (v, i) in enumerate(s, 1)]
    return sorted(out)


def test_topk_is_exact(spark):
    r = random.Random(10)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(8)]) for k in range(700)]
    same = [0.5] * 8
    rows += [(1000 + k, same) for k in range(120)] + [(1000, same), (2000, None), (2001, []), (2050, [float("nan")] * 8),
             (None, same), (3000, [1.0, None] * 4), (4000, [2.0, 3.0]), (4001, [1.0, -1.0]), (4050, [9.0, 9.0, 9.0]), (5000, [0.0] * 8)]
    df = spark.createDataFrame([(i, x, 1, "x") for i, x in rows], "vec_id long, embedding array<float>, label int, dim string")
    as_float = {(i, k): x for k, (i, x, *_) in enumerate((tuple(t) for t in df.collect()))}
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == plain_topk([(i, x) for (i, _), x in as_float.items()])
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df, df.where("vec_id = -1")).count() == 0


def test_topk_over_many_groups(spark, monkeypatch):
    """Blocks, groups and query blocks of a few rows, queries met by several tasks."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "GROUP_ROWS", 80)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = random.Random(12)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(6)]) for k in range(900)] + [(950, [0.25] * 6)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == plain_topk(rows)


def test_topk_refuses_inexact_products(spark):
    df = spark.createDataFrame([(0, [1e20, 1.0]), (1, [1e20, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2\\^53"):
        topk.search(df, df, 5)


@pytest.mark.parametrize("dims, share", [(3, 0.1), (64, 0.35)])
def test_topk_bounds_eliminate(dims, share):
    """Exact against brute force, and most candidates are never evaluated, even where vectors
    have no structure at all (64 random dimensions)."""
    import numpy as np
    r = np.random.default_rng(1)
    x = r.normal(size=(8000, dims))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 256)
    norm2 = (x * x).sum(1).max()
    pivots = topk.Pivots(np.unique(x[:topk.PIVOTS], axis=0), norm2)
    ids, task, got = np.arange(8000), topk.Search({dims: pivots}, 5), {}
    q, qids = x[:40].copy(), ids[:40].astype("<i8").tobytes()
    for at in range(0, 8000, topk.BLOCK_ROWS):
        part = slice(at, at + topk.BLOCK_ROWS)
        row = {"dim": dims, "ids": ids[part].astype("<i8").tobytes(), "xs": x[part].tobytes(),
               "ds": pivots.distances(x[part], False).tobytes(), "qids": qids, "qxs": q.tobytes(),
               "qds": pivots.distances(q, True).tobytes()}
        for i, found, scores in task.blocks(row):
            got.setdefault(i, []).extend(zip((-scores).tolist(), found.tolist()))
    for i in range(40):
        assert sorted(got[i])[:5] == sorted((-float(x[j] @ q[i]), j) for j in range(8000) if j != i)[:5]
    assert task.met == 40 * 8000 and task.evaluated < share * task.met


# ---------------------------------------------------------------- near-duplicates
def near_rows(seed=11):
    r = random.Random(seed)
    rows = list(ROWS)
    for family in range(12):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(r.randint(4, 120))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                w[r.randrange(len(w))] = str(r.random())
            rows.append((100 + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("n, threshold, node_rows", [(4, 0.8, 2000), (5, 0.8, 3), (5, 0.6, 2000)])
def test_near_duplicates_equal_exhaustive_search(spark, monkeypatch, n, threshold, node_rows):
    monkeypatch.setattr(minhash_join, "NODE_ROWS", node_rows)        # 3: branches, then parts of a node
    rows = near_rows()
    got = minhash_join.near_duplicates(docs(spark, rows), words=n, threshold=threshold).collect()
    want = near_components(rows, n, threshold)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_trees_keep_links_at_every_depth(spark, monkeypatch):
    for threshold in (0.5, 0.6, 0.8, 0.9):
        for depth in range(1, minhash_join.levels_for(threshold) + 1):
            n = minhash_join.trees_for(threshold, depth)
            assert (1 - threshold ** depth) ** n <= 1e-6 and n * depth <= minhash_join.HASHES
    monkeypatch.setattr(minhash_join, "NODE_ROWS", 20)
    n = minhash_join.trees_for(0.8, 4)
    assert n >= 26
    deep = {bytes([1, k]): bytes(4 * 4 * n) for k in range(50)}                   # one node down to the last level
    deep |= {bytes([2 + j, k]): bytes([k + 1]) * (4 * 4 * n) for k in range(10) for j in (0, 1)}      # pairs of classes
    asked = []

    def deep_of(classes):
        asked.extend(bytes(r.cls) for r in classes.collect())
        return spark.createDataFrame([(c, deep[c]) for c in asked], "cls binary, tokens binary")

    nodes, late, most = minhash_join._crowds(
        spark.createDataFrame([(c, t[:40]) for c, t in deep.items()], "cls binary, tokens binary"), deep_of, 0.8)
    assert sorted(asked) == sorted(c for c in deep if c[0] == 1)                  # only crowded classes get deep tokens
    trees = {}
    for r in nodes.collect() + late.collect():
        trees.setdefault(bytes(r.cls), set()).add(r.tree)
    assert most == n and len(trees) == 70
    assert all(trees[c] == set(range(n if c[0] == 1 else 10)) for c in trees)


def test_near_duplicates_by_shuffled_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BROADCAST_BYTES", 0)
    rows = near_rows(12)
    got = minhash_join.near_duplicates(docs(spark, rows, extra=False), words=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == \
        sorted(near_components(rows, 4, 0.8), key=repr)


def test_large_families_cost_linear_work(spark, monkeypatch):
    """Nodes too large at the last level: parts with pivots, and all others for the rest only."""
    monkeypatch.setattr(minhash_join, "NODE_ROWS", 20)
    late = spark.range(400).selectExpr("1L AS node", "0 AS tree", "CAST(CAST(id AS STRING) AS BINARY) AS cls", "400L AS rows")
    nodes, first = minhash_join._pivoted(late)
    sizes = [r["count"] for r in nodes.groupBy("node").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 40 and sum(sizes) <= 400 + 40 * minhash_join.PIVOTS
    reached = spark.range(398).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS node", "CAST('0' AS BINARY) AS label")
    rest = minhash_join._rest(late, first, reached).collect()
    met = {}
    for r in rest:
        met.setdefault(r.node, set()).add(bytes(r.cls))
    pairs = {frozenset((x, y)) for group in met.values() for x in group for y in group if x != y}
    every = {str(k).encode() for k in range(400)}
    assert all(frozenset((x, y)) in pairs for x in (b"398", b"399") for y in every - {x})
    assert len(rest) < 600
    assert minhash_join._rest(late, first, spark.range(400).selectExpr(
        "CAST(CAST(id AS STRING) AS BINARY) AS node", "CAST('0' AS BINARY) AS label")).count() == 0


def test_family_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "NODE_ROWS", 12)
    r = random.Random(3)
    base = [str(r.random()) for _ in range(120)]
    rows = [(k, " ".join([*base[:r.randrange(118)], f"x{k}", *base[60:]][:120])) for k in range(40)]
    rows += [(100 + k, " ".join([*base[:k], f"y{k}", *base[k + 1:]])) for k in range(80)]
    got = minhash_join.near_duplicates(docs(spark, rows), words=4).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(near_components(rows, 4, 0.8))


def test_rows_without_id_cost_linear_work(spark):
    """Each class reads one text, whatever the ids say."""
    rows = [(None if k % 2 else 7, f"{' '.join(WORDS_OF[k:k + 20])} {k}") for k in range(200)]
    join = minhash_join._Join(docs(spark, rows), 5, 0.8)
    assert join.texts_of(join.classes.select("cls")).count() == 200


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    d = docs(spark, rows)
    out = minhash_join.deduplicate(d)
    assert out.columns == d.columns
    want = {i for i, _, c in near_components(rows, 5, 0.8) if i is not None and i == c}
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert {i for i in ids if i is not None} == want
    assert sum(i == 10 for i in ids) == 1 and sum(i is None for i in ids) == 1     # the empty text
    assert minhash_join.near_duplicates(d.limit(0)).count() == 0


def test_survivors_are_rows_not_ids(spark):
    a, b, c = (" ".join(WORDS_OF[k:k + 30]) for k in (0, 40, 80))
    kept = minhash_join.deduplicate(docs(spark, [(0, b), (1, a), (1, b), (None, c), (None, c + " end"), (None, c)]))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 3 and {(0, b), (1, a)} < set(got) and [i for i, _ in got].count(None) == 1


@pytest.mark.parametrize("limit", [minhash_join.BROADCAST_BYTES, 0])
def test_survivors_texts_stay_in_their_tasks(spark, monkeypatch, limit):
    """Rows that are not repeated are not shuffled; many listed keys are joined by shuffle, with the same rows."""
    monkeypatch.setattr(minhash_join, "BROADCAST_BYTES", limit)
    a, b, c = (" ".join(WORDS_OF[k:k + 30]) for k in (0, 40, 80))
    rows = [(1, a), (2, a + " end"), (3, b), (None, c), (4, c), (5, None), (None, ""), (6, " ")]
    out = minhash_join.deduplicate(docs(spark, rows))
    want = [(1, a), (3, b), (4, c), (5, None), (None, ""), (6, " ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == (limit == 0)
    twice = minhash_join.deduplicate(docs(spark, rows + [(1, a), (5, None), (None, ""), (3, b), (3, b), (2, a + " end")]))
    assert sorted(((r.doc_id, r.text) for r in twice.collect()), key=repr) == sorted(want, key=repr)


def test_components_of_a_chain(spark):
    pairs = [(bytes([a]), bytes([a + 1])) for a in range(40)] + [(bytes([100]), bytes([90]))]
    got = dict(tuple(map(bytes, r)) for r in minhash_join.components(spark.createDataFrame(pairs, "a binary, b binary")).collect())
    assert got == {bytes([k]): bytes([0]) for k in range(41)} | {bytes([100]): bytes([90]), bytes([90]): bytes([90])}
