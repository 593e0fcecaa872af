"""Corpus pipeline: rules, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from headgrid.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from headgrid.llm.common import stored
from headgrid.llm.queries import BUDGET, MULTI_RANKS, TARGETS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return quality_rules.keep_good(docs, quality_rules.CORPUS_BANDS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group (4-word shingles, 4 bits)."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the domains' words meet the target weights on average."""
    return mixing.mix_documents(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS, BUDGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    both = bpe.bpe_round_trip(docs, MULTI_RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("bpe", encode)]

#: zstandard, SimHash components and the fitted mix are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
