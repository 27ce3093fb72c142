"""Cleaning a corpus: language, exact and near copies, benchmark leaks, then a proof that it encodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelquery.llm import bpe_stream, decontamination, exact_dedup, lang_id, queries, resemblance
from reelquery.llm.common import table
from reelquery.session import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; texts without letters and uncertain ones go."""
    return lang_id.keep_known(docs, lang_id.train(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts linked at 0.8 of their five-word shingles."""
    return resemblance.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; the last stage."""
    return bpe_stream.encode_decode(docs, queries.vocabulary(queries.BYTE_VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact),
    ("simhash", drop_near),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The network of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
