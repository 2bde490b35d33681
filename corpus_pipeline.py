"""A training-data pipeline over ``documents``: toxic documents go, exact and near copies are reduced to one, sources are
mixed to target weights, and what is left is encoded to tokens and checked by decoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of
the next. All stages but the last return the columns of ``documents``. Where an id is null, empty text, or a table
empty, the stages do what their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burnish.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from burnish.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learnt from the labels of these documents, scores as toxic go."""
    grammar = toxicity.train(toxicity.learning_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_civil(docs, grammar)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text that of the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.75 or more of five-word shingles the smallest id stays."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get the share of the square root of their size, by repeating documents; the copies are shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, and digests of their ids and of the text they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Neither the grammar's learning nor the tokens can be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
