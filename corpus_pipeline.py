"""From raw documents to tokens: five stages, each over all rows that the one before kept.

Toxic documents go, one document of each group of near copies stays, documents that hold benchmark
items go, secrets are blotted out, and what is left is encoded as token ids and decoded again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestrata.llm.bpe import decode, encode
from cuestrata.llm.decontaminate import without_leaks
from cuestrata.llm.jaccard import one_of_each
from cuestrata.llm.secrets import redact
from cuestrata.llm.toxicity import without_toxic
from cuestrata.session import stage

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens, and whether the decoded bytes are the text's."""
    hashed = docs.withColumn("text_sha256", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    both = decode(encode(hashed, RANKS), RANKS)
    return both.select(
        "doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", blot_secrets),
    ("bpe", tokenise),
]
#: The stages learn, hash and tokenise; the tests hold them against plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
