"""Registered queries of the operators: ``opN_<name>`` over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketlens.llm import (
    byte_bpe, fingerprints, minhash_join, mixing, pii, ranked_search, role_repair, seed_extend, suffix_dedup, token_counts,
    topk, toxicity, url_filter,
)
from basketlens.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                            public_tokenizers.PATTERN)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fixed_rules(spark))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.report(table(spark, sf_dir, "documents"))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.report(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_minhash_join": op10_minhash_join,
    "op11_seed_extend": op11_seed_extend,
    "op12_role_repair": op12_role_repair,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op7_url_filter": url_filter.SQL,
    "op9_topk": topk.SQL,
    "op11_seed_extend": seed_extend.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
