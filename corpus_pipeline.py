"""Training-data pipeline: each stage reads what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet
and reread. All but the last return the columns of documents; the last returns the
encoded form of every document that is left.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, language_id, mixing, piece_bpe, simhash
from sparkloom.llm.queries import TARGETS, labelled, table
from sparkloom.plans.tables import materialize

#: Documents below this probability of their language go; with a few languages a clear text is far above it.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or without a clear language go."""
    return language_id.in_known_language(docs, language_id.train(docs), LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at most four fingerprint bits connect."""
    return simhash.without_near_duplicates(docs, radius=4, words=4)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their fitted rates: good text stays, poor and toxic text is thinned out or repeated until totals match."""
    return mixing.mixed(docs, labelled(spark, sf_dir), TARGETS, cap=math.inf, anchor="good")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and digest of the text that they decode to."""
    return piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing", target_weights),
    ("SentencePiece", encoded),
]

#: Language ID, fingerprints and encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
