"""The text operators as registered queries over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    best_position, bpe, mixing, order_minhash, ordinal, pii, quality, quotes, sharding, simhash, toxicity, whitening, winnowing)
from tidemark.llm.shared import documents
from tidemark.llm.sql import SQL  # noqa: F401

# Sources are dealt to four domains. The weight of a leaf is that of its language, or 1, times one
# that its source gives; the budget is a share of all tokens.
DOMAINS = 4
WEIGHT = ("case lang when 'en' then 4 when 'de' then 3 when 'fr' then 2 else 1 end "
          "* (crc32(cast(coalesce(source, '') as binary)) % 5 + 1)")
SHARE = 0.6
TOKENIZER = "byte_bpe_50k.json"


def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return order_minhash.edited_fingerprints(documents(spark, folder))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every document and the group it belongs to."""
    return simhash.groups(simhash.fingerprints(documents(spark, folder)))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.digests(documents(spark, folder), public_tokenizers.path(TOKENIZER))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    docs = documents(spark, folder)
    return pii.digests(docs, pii.trained(docs))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in uniform order in eight shards."""
    return sharding.digests(documents(spark, folder))


def op6_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations out of the turns, seen as mail in which each quotes the one before."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    found = quotes.conversations(quotes.as_mail(turns))
    return found.select("conversation", "message", "parent", "depth", "path", F.sha2("text", 256).alias("text_sha256"))


def with_domain(docs: DataFrame) -> DataFrame:
    """``docs`` with the top level of the tree, by source."""
    return docs.withColumn("domain", F.concat(F.lit("d"), F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % DOMAINS))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that bring languages and sources to their weights, with the epochs that take them."""
    found = mixing.mixed(with_domain(documents(spark, folder)), F.expr(WEIGHT), SHARE)
    return found.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules on every document, lines counted over all documents of a source."""
    return quality.judged(documents(spark, folder))


def op9_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade of every document, from two judgements of some."""
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    ratings = ordinal.grades_of(labels.where(~toxicity.held_out(F.col("doc_id"))))
    return ordinal.graded(docs, ordinal.trained(docs, ratings, 3))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from three quarters of the labels."""
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    found = toxicity.scored(docs, toxicity.trained(docs, labels, ~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= toxicity.PREDICTED_FROM).cast("int").alias("predicted"), "toxic")


def op11_best_position(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that rank highest for each benchmark item."""
    return best_position.ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return winnowing.digests(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the whitened main components."""
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_simhash, op3_bpe, op4_pii, op5_sharding, op6_quotes, op7_mixing, op8_quality,
                                   op9_ordinal, op10_toxicity, op11_best_position, op12_winnowing, op13_whitening)}
