"""Operators that map texts: token counts, toxicity, byte-level BPE, personal data."""

import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.llm import byte_bpe, pii, token_counts, toxicity
from basketlens.llm.words import tokenize
from tests.llm.helpers import LONG, ROWS, docs

PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", "the ", "\n", "  ", "\t", "é", "漢", "😀", "1", "'s", "ing", "\x1c", "\x85", "\xa0", "\u2028", "!!", "A", " ", "▁"]


def fuzz(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def by_row(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# ---------------------------------------------------------------- token counts
@pytest.fixture(scope="module")
def unigram_reference():
    import sentencepiece
    from tokenizers import Tokenizer, models
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0,
                                 byte_fallback=True))
    return lambda s: len(t.encode("▁" + s.replace(" ", "▁")).ids) if s else 0


def test_counts_equal_the_tokenizer(unigram_reference):
    model = token_counts.unigram(PIECES)
    for s in [*fuzz(1500), LONG, "a" * 5000, "▁▁", "x"]:
        assert model.count(s) == unigram_reference(s), s[:60]


def test_counts_ties_and_unsplittable_vocabulary():
    # "ab" + "c" and "a" + "bc" score the same: the earlier start of the last piece wins
    tie = token_counts.Unigram({"▁": -1, "a": -2, "b": -9, "c": -2, "ab": -2, "bc": -2})
    assert tie.count("abc") == 3
    crossing = token_counts.Unigram({"▁": -1, "a": -1, "a▁a": -0.5})
    assert not crossing.by_word and crossing.count("a a") == 2
    assert token_counts.Unigram({}).count("é") == 3 + 2      # U+2581 and é, byte by byte


def test_counts_of_awkward_rows(spark, unigram_reference):
    got = by_row(token_counts.count(docs(spark), PIECES), "doc_id", "n_tokens")
    assert got == sorted(((i, unigram_reference(t or "")) for i, t in ROWS), key=repr)
    assert token_counts.count(docs(spark).limit(0), PIECES).count() == 0


# ---------------------------------------------------------------- byte-level BPE
@pytest.fixture(scope="module")
def bpe_reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(bpe_reference):
    v = byte_bpe.vocabulary(RANKS, P.PATTERN)
    r = random.Random(3)
    odd = ["".join(chr(r.choice([r.randint(0, 255), r.randint(0, 0x2FFF), r.randint(0x10000, 0x10FFFF)]))
                   for _ in range(r.randint(0, 25))) for _ in range(500)]
    for s in [*fuzz(2000), *odd, LONG, "a" * 20000, "ab" * 9000, "\n" * 500, "<|endoftext|>"]:
        ids = v.encode(s)
        assert memoryview(ids).cast("I").tolist() == bpe_reference.encode_ordinary(s), s[:60]
        assert v.decode(ids) == s.encode()


def test_bpe_backtracks():
    ranks = {bytes([c]): k for k, c in enumerate(b"abcd")} | {b"bc": 4, b"ab": 5, b"cd": 6, b"abc": 7}
    v = byte_bpe.Vocabulary(ranks, r"\S+")
    assert v.merge(b"abcd") == [0, 4, 3] or v.merge(b"abcd") == [7, 3]
    with pytest.raises(ValueError):
        v.merge(b"z")


def test_bpe_of_awkward_rows(spark, bpe_reference):
    got = by_row(byte_bpe.digests(docs(spark), RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

    def row(i, t):
        ids = bpe_reference.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(byte_bpe.pack(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == sorted((row(*r) for r in ROWS), key=repr)
    coded = byte_bpe.encode(docs(spark), RANKS, P.PATTERN)
    back = byte_bpe.decode(coded, RANKS, P.PATTERN)
    assert by_row(back.select("doc_id", F.decode("decoded", "UTF-8").alias("t")), "doc_id", "t") == \
        sorted(((i, t or "") for i, t in ROWS), key=repr)
    assert byte_bpe.encode(docs(spark).limit(0), RANKS, P.PATTERN).count() == 0


# ---------------------------------------------------------------- personal data
def plain_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(d[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in d[-2::-2])
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_plain_rules():
    r = random.Random(5)
    parts = ["a", "b@", "c.d", "1", "22", "255", "256", ".", "@", "-", " ", "+", "(", ")", "0", "4111 1111 1111 1111", "é", "x@y.z"]
    for _ in range(20000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(s) == plain_spans(s), s


@pytest.mark.parametrize("text, kind, found", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("jоhn@exаmple.cоm", "email", "jоhn@exаmple.cоm"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jo\u200bhn@exam\u200bple.com!", "email", "jo\u200bhn@exam\u200bple.com"),
    ("write to bob at mail dot example dot org today", "email", "bob at mail dot example dot org"),
    ("bob.1 at mail.example.org", "email", "bob.1 at mail.example.org"),
    ("call plus one nine eight eight five five five two four eight five ok", "phone",
     "plus one nine eight eight five five five two four eight five"),
    ("+１ ９８８ ５５５ ２４８５", "phone", "+１ ９８８ ５５５ ２４８５"),
    ("at one nine two dot one six eight dot zero dot one!", "ip", "one nine two dot one six eight dot zero dot one"),
    ("pay four double one triple one one one one one one one one one one one", "card",
     "four double one triple one one one one one one one one one one one"),
    ("4111\u00a01111\u00a01111\u00a01111", "card", "4111\u00a01111\u00a01111\u00a01111"),
])
def test_disguised_spans_are_mapped_back(text, kind, found):
    spans = [(pii.KINDS[k], text[a:b], base) for k, a, b, base in pii.all_spans(text)]
    assert (kind, found, False) in spans


@pytest.mark.parametrize("text, kind, found", [
    ("+1 415 555 267 one", "phone", "+1 415 555 267 one"),
    ("at 192.168.1.five!", "ip", "192.168.1.five"),
    ("pay 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
    ("john at example\ndot com", "email", "john at example\ndot com"),
    ("john at mail\tdot\texample\tdot\tcom", "email", "john at mail\tdot\texample\tdot\tcom"),
    ("john&COMMAT;example&Period;com", "email", "john&COMMAT;example&Period;com"),
    ("ip 192 dot 168 dot 1 dot 5 ok", "ip", "192 dot 168 dot 1 dot 5"),
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("card four one one one, one one one one, one one one one, one one one one end", "card",
     "four one one one, one one one one, one one one one, one one one one"),
])
def test_disguises_pass_the_gate(text, kind, found):
    assert (kind, found, False) in [(pii.KINDS[k], text[a:b], base) for k, a, b, base in pii.all_spans(text)]


def test_spans_are_the_same_without_the_gate(monkeypatch):
    r = random.Random(6)
    parts = ["john", "b.1", "mail", "example", "com", "at", "AT", "dot", "Dot", ".", "@", "[at]", "( dot )", "&#64;", "&Period;", "&commat;",
             "one", "Five", "double", "triple two", "plus", "oh", "192", "168", "1", "+1", "4111 1111 1111 111", "é", "İ", "\u212a",
             ",", "-", " ", " ", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "x"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " ", "\n", "-"]) for _ in range(r.randint(1, 14))) for _ in range(20000)]
    gated = [pii.all_spans(t) for t in texts]
    edited = [bool(pii._word_edits(t)) for t in texts]
    passed = [pii.may_be_disguised(t) for t in texts]
    assert sum(edited) > 2000 and passed.count(False) > 2000
    assert [t for t, e, p in zip(texts, edited, passed) if e and not p] == []
    monkeypatch.setattr(pii, "may_be_disguised", lambda text: True)
    assert [t for t, s in zip(texts, gated) if pii.all_spans(t) != s] == []


def test_time_grows_with_the_number_of_spans():
    """One disguise in a mailing list of many addresses costs no look at all pairs."""
    def seconds(n):
        text = " ".join(f"user{k}@example{k % 97}.org" for k in range(n)) + " bob [at] example.org"
        begun = time.process_time()
        assert len(pii.all_spans(text)) == n + 1
        return time.process_time() - begun

    assert seconds(40_000) < 40 * max(seconds(4000), 0.05)


def test_plain_prose_has_no_spans():
    for t in ("the cat sat on a mat. One two three, four!", "3.5 of 100 at noon", "Ünïcödé wörds — ok", LONG):
        assert pii.all_spans(t) == []


def test_pii_of_awkward_rows(spark):
    rows = [*ROWS, (20, "a@b.cd 10.0.0.1, +1 (988) 555-2485; 4111 1111 1111 1111"), (21, "a@b.cd x@y.zz"), (22, "a" * 50000 + "@b.c")]
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.report(docs(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        s = sorted(plain_spans(t or ""))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in s)
        n = [sum(k == x[0] for x in s) for k in range(4)]
        want.add((i, *n, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got == want
    masked = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert masked[20] == "<EMAIL> <IP>, <PHONE>; <CARD>" and masked[3] is None and masked[6] == LONG
    assert pii.redact(docs(spark)).columns == docs(spark).columns
    assert pii.find(docs(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity
def test_marginals_equal_plain_forward_backward():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 333):
        logit, first = r.normal(size=n) * 3, r.random(n) < 0.1
        first[0] = True
        trans, start = np.exp(r.normal(size=(2, 2))), np.exp(r.normal(size=2))
        want = np.zeros(n)
        cuts = [*np.flatnonzero(first), n]
        for a, b in zip(cuts, cuts[1:]):
            e = np.c_[np.ones(b - a), np.exp(logit[a:b])]
            fwd, bwd = [start * e[0]], [np.ones(2)]
            for t in range(1, b - a):
                fwd.append(fwd[-1] @ trans * e[t])
            for t in range(b - a - 1, 0, -1):
                bwd.append(trans @ (e[t] * bwd[-1]))
            m = np.array(fwd) * np.array(bwd[::-1])
            want[a:b] = m[:, 1] / m.sum(1)
        assert np.allclose(toxicity.marginals(logit, first, trans, start), want)
        m, pairs, begun = toxicity.marginals(logit, first, trans, start, pairs=True)
        assert np.isclose(pairs.sum(), n - first.sum()) and np.isclose(begun.sum(), first.sum())


def test_token_offsets():
    texts = ["a  bc\tdé 😀x", "", None, " z"]
    t = tokenize(pa.array(texts, pa.string()))
    assert [(k, (texts[k] or "")[a:b]) for k, a, b in zip(t.text, t.start, t.end)] == \
        [(0, "a"), (0, "bc"), (0, "dé"), (0, "😀x"), (3, "z")]


def sample(n, seed=0):
    r = random.Random(seed)
    calm = [f"w{k}" for k in range(300)]
    out = []
    for i in range(n):
        toxic = r.random() < 0.3
        w = [r.choice(calm) for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(2, 4) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(["nastyface", "nastyhead", "vile"])
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_rare_labels_are_learnt(spark):
    """120 toxic documents among 120,000, told apart by two words that occur nowhere else."""
    words = [F.concat(F.lit("w"), (F.abs(F.xxhash64("id", F.lit(k))) % 3000).cast("string")) for k in range(12)]
    sign = F.when(F.col("id") % 2000 == 7, "vilefoo").when(F.col("id") % 2000 == 1007, "grimbarq")
    d = spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *words[:6], sign, *words[6:]).alias("text"))
    labels = d.select("doc_id", (F.col("doc_id") % 1000 == 7).cast("int").alias("toxic"))
    model = toxicity.train(d, labels)
    got = toxicity.score(d, model).groupBy((F.col("doc_id") % 1000 == 7).alias("toxic")).agg(
        F.count_if(F.col("score") >= 0.3).alias("hit"),
        F.count(F.lit(1)).alias("n")).collect()
    hit = {r.toxic: r.hit for r in got}
    assert hit[True] >= 114 and hit[False] <= 12


def test_no_model_is_reported(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 1)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no toxicity model"):
        assert toxicity.train(d, labels) is None
    assert toxicity.fit(["a b", "c d", "e f"], [0, 0, 1]) is None
    same = spark.createDataFrame([(i, int(i % 2)) for i in (4, 15)], "doc_id long, toxic int")      # one text, two labels
    with pytest.warns(UserWarning):
        assert toxicity.train(d, same) is None


def test_memo_tables_are_bounded_and_emptied():
    from basketlens.llm.common import Memo, release
    memo = Memo(10_000)
    for k in range(2000):
        memo.put(f"key {k}", k)
        assert memo.used <= 10_000 and len(memo) < 100
    release()
    assert not memo and memo.used == 0


def test_toxicity_on_held_out_rows(spark):
    rows = sample(1200)
    d = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "vile"), (5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (3, None, "x")],
                                   "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.judge(d, labels).collect()}
    assert len(got) == 1203 and not got[None].held_out
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert np.mean([p == y for p, y in held]) >= 0.98 and len(held) > 200
    assert got[5000].score < 0.3 and got[5001].score == got[5000].score
    model = toxicity.train(d, labels)
    tagged = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    i, t, _ = next(r for r in rows if r[2] and "vile" in r[1])
    assert "vile" in {t[s.start:s.end] for s in tagged[i].spans}
    kept = toxicity.clean(d, model)
    assert kept.columns == d.columns and {5000, 5001} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs(spark), none) is None
    assert {r.score for r in toxicity.judge(docs(spark), none).collect()} == {0.0}
    assert toxicity.clean(docs(spark), None).count() == len(ROWS)
    assert toxicity.judge(docs(spark).limit(0), none).count() == 0
