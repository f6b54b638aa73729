"""A training corpus from raw documents: five stages, each written and read again.

Toxic documents go, one document of each group of near duplicates stays, personal data is
replaced, sources are mixed to their weights, and what is left is packed into sequences.

Cases, alike in every stage: null and empty texts are clean documents without words, and as
near duplicates of each other one of them stays; rows with a null doc_id are kept; repeated
rows are judged each, and one stays behind the SimHash stage; ties go to the smaller doc_id,
then to a hash of the text; an empty table stays empty; very long texts are read whole; other
columns of the documents may have any name and go along until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginflow.llm import mixing, packing, pii, queries, simhash, toxicity
from marginflow.llm.shared import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, directory), queries.TOXIC_FROM)


def simhash_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Sequences of token ids."""
    return packing.pack(docs, public_tokenizers.path(queries.WORD_IDS), queries.PACK_END, queries.LONGEST)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, fingerprints and tokenizer have no SQL.  Tests hold the rows of each stage, and of
#: the whole run, against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, directory), name)
    return docs
