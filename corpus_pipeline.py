"""From raw documents to token digests: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm import bpe_codec, decontamination, language_id, line_dedup, simhash
from specula.llm.common import drop_written, table, written
from specula.sources.package import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; of the others ``lang`` becomes the predicted one.

    Where no language could be learned ``lang`` stays as it is.
    """
    model = language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    found = language_id.predict(docs, model, letters="_letters").where("_letters")
    return found.withColumn("lang", F.coalesce(F.nullif("lang_pred", F.lit("und")), "lang")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no line is left. ``n_chars`` follows the text.

    Documents without a doc_id come after all others, in the order of their texts' hashes.
    """
    last = docs.withColumn("_none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    found = line_dedup.line_dedup(last).where("n_lines = 0 or n_exact + n_near < n_lines")
    found = found.withColumn("doc_id", F.when(~F.col("_none"), F.col("doc_id")))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest doc_id, or without one if none of the group has any."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_codec.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can't express merging, support vector machines or random walks; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
