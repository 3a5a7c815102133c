"""From documents to token ids: the text operators chained, each stage on all the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, pii, simhash, toxicity
from tidemark.llm.queries import SHARE, WEIGHT, with_domain
from tidemark.llm.shared import documents
from tidemark.storage import written


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents at or over the toxicity threshold of their language go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return simhash.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.masked(docs, pii.trained(docs))


def to_weights(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources are brought to their target weights; a document can be taken in several epochs."""
    names = docs.columns
    return mixing.mixed(with_domain(docs), F.expr(WEIGHT), SHARE).select(*names)


def to_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts are encoded, and decoded again to see that nothing was lost."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", to_weights),
    ("tokens", to_ids),
]

# Trained models and XXH64 have no SQL form: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again for the next."""
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
