"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Language identification drops documents without a known language; of every group of near copies one stays;
passages of the benchmark are cut out, and documents that are mostly benchmark go; findings of the secret scan
are replaced by a mark; what is left is tokenized and packed. All stages but the last return the columns of
``documents``; where a text changes, ``n_chars`` follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import decontaminate, langid, secrets, simhash
from symloom.llm.queries import packed, table
from symloom.llm.shared import free_name, stored

#: No stage can be told in SQL as a whole: the network, the profiles and the tokenizer are not SQL.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to the profile of a language; profiles and the least score are learned from the labelled ones."""
    return langid.identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows with one id, and of groups without any id, the row with the lowest text hash stays.
    """
    columns, row = docs.columns, free_name(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row).alias("row"))
    found = simhash.near_duplicates(rows.select(order.alias("doc_id"), "text"))
    first = found.where(F.col("id") == F.col("component_id")).select(F.col("id.row").alias(row))
    return rows.join(first, row, "left_semi").select(*columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages of ten words; those with more than half of their words in such passages go."""
    return _counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10))


def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every secret found."""
    return _counted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 2048 tokens."""
    return packed(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scan", cover_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
