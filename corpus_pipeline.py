"""A training-data pipeline over ``documents``, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import byte_bpe, minhash_join, mixing, pii, toxicity
from basketlens.llm.common import stored, table

#: Documents at or above this toxicity go.
TOXIC_AT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject.

    NULL and empty texts score low and stay, as do all documents where no model can be
    fitted (a warning says so); repeated rows and NULL ids are judged row by row.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.clean(docs, model, TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the
    smallest id, NULL ids last.  Equal rows (id and text) are one; texts without words stay."""
    return minhash_join.deduplicate(docs, words=5, threshold=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with e-mail and IP addresses, card and phone numbers replaced by their kind.

    A row out for each row in; NULL texts stay NULL, with a NULL length.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the sources' target weights ask for.

    NULL, empty and blank texts have no words and are never taken; a NULL source is a source
    of its own; every repeated row is a document of its own.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to its bytes.

    A row out for each row in; a NULL text is an empty one.
    """
    both = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                           with_decoded=True, keep=("text", "lang", "source"))
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: The stages learn, hash and tokenize: SQL cannot express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
