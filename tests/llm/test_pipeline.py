"""The pipeline's stages against plain versions, and the registered queries."""

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from basketlens.llm import byte_bpe, mixing, pii, queries, toxicity
from basketlens.llm.common import stored, table
from tests.llm.helpers import ROWS, docs, near_components, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    out, now = {}, table(spark, SF, "documents")
    out["documents"] = now
    for name, stage in corpus_pipeline.STAGES:
        out[name] = now = stored(stage(spark, now, SF), name)
    return out


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_stage(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert stages[n].columns == COLUMNS
    model = toxicity.train(stages["documents"], table(spark, SF, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scores = {r.doc_id: r.score for r in toxicity.score(stages["documents"], model).collect()}
    rows = {n: stages[n].collect() for n in names}
    assert {r.doc_id for r in rows["toxicity"]} == {i for i, s in scores.items() if s < corpus_pipeline.TOXIC_AT}
    kept = {i for i, _, c in near_components([(r.doc_id, r.text) for r in rows["toxicity"]], 5, 0.8) if i == c}
    assert {r.doc_id for r in rows["near_duplicates"]} == kept
    before = {r.doc_id: r.text for r in rows["near_duplicates"]}
    assert {r.doc_id: r.text for r in rows["personal_data"]} == {i: pii.mask(t) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in rows["personal_data"])
    taken = {r.doc_id: r.taken for r in mixing.taken_words(stages["personal_data"]).collect()}
    mixed = {}
    for r in rows["mixing"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
    assert mixed == {i: n for i, n in taken.items() if n}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    want = sorted((r.doc_id, byte_bpe.pack(enc.encode_ordinary(r.text))) for r in rows["mixing"])
    assert sorted((r.doc_id, bytes(r.ids)) for r in rows["byte_bpe"]) == want
    assert all(r.round_trip for r in rows["byte_bpe"])


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == \
        sorted((r.doc_id, r.n_tokens) for r in stages["byte_bpe"].collect())


@pytest.mark.parametrize("at", range(5))
def test_stages_take_awkward_rows(spark, at):
    """NULLs, empty and long texts, repeated rows and clashing columns: every stage's rows."""
    name, stage = corpus_pipeline.STAGES[at]
    d = docs(spark)
    out = stage(spark, d, SF)
    assert at == 4 or out.columns == d.columns
    assert stage(spark, d.limit(0), SF).count() == 0
    got = out.collect()
    if at == 0:                                    # nothing in it is toxic
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(ROWS, key=repr)
    if at == 1:
        groups = {}
        for (i, t), (_, n, c) in zip(ROWS, near_components(ROWS, 5, 0.8)):
            groups.setdefault(c if n else ("no words", i, t), set()).add((i is None, i or 0, t))
        want = {min(g, key=lambda r: r[:2])[:2] for g in groups.values()}
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want)
    if at == 2:
        assert sorted(((r.doc_id, r.text, r.n_chars) for r in got), key=repr) == \
            sorted(((i, pii.mask(t), None if t is None else len(pii.mask(t))) for i, t in ROWS), key=repr)
    if at == 3:
        taken = {}
        for r in mixing.taken_words(d).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        mixed = {}
        for r in got:
            mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
        assert mixed == {i: n for i, n in taken.items() if n}
    if at == 4:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
        assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == \
            sorted(((i, byte_bpe.pack(enc.encode_ordinary(t or ""))) for i, t in ROWS), key=repr)
        assert all(r.round_trip for r in got)


def test_queries_are_registered():
    import __spark_entry__ as e
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    from tests.oracle_harness import compare, duck
    problems, *_ = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name])
    assert not problems, problems
