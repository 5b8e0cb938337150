"""Inputs of the registered queries, all derived from the given tables by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import paths
from symloom.operators import symbols as sy
from symloom.operators.events import CHANGE, CLOSE, OPEN
from symloom.operators.symbols import Rule
from symloom.session import default_filesystem, read_spread, text_batches
from symloom.sources.files import open_filesystem

NAME = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
PROSE = ("de", "en", "es", "fr")

# A line that starts with a capitalised word defines it; the last character of the line gives the kind.
PROSE_RULES = [
    Rule(PROSE, "function", rf"(?s)^({NAME}).*[.]\z"),
    Rule(PROSE, "method", rf"(?s)^({NAME}).*!\z"),
    Rule(PROSE, "module", rf"(?s)^({NAME}).*[|]\z"),
    Rule(PROSE, "enum", rf"(?s)^({NAME}).*#\z"),
    Rule(PROSE, "interface", rf"(?s)^({NAME}).*%\z"),
    Rule(PROSE, "class", rf"^({NAME})"),
]
PROSE_REFERENCES = [Rule(PROSE, "word", f"({NAME})")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one table with long texts, spread over the cores."""
    return read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id")


def document_path():
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files of one workspace per language."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.col("lang").alias("workspace"),
        document_path().alias("path"),
        "text",
        paths.content_fingerprint(F.col("text")).alias("md5"),
    )


def symbols(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return sy.symbol_table(sy.extract_symbols(files(spark, sf_dir), PROSE_RULES, **options))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.extract_references(files(spark, sf_dir), PROSE_REFERENCES)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a label: an index made earlier, of low quality where its content is out of date."""
    return files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def prior_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.md5(F.concat(F.col("text"), F.lit("x")))
    return labelled(spark, sf_dir).select(
        "workspace", "path", F.when(F.col("quality") == 0, old).otherwise(F.col("md5")).alias("md5")
    )


def prior_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of that index, under other names where the content is out of date."""
    quality = labelled(spark, sf_dir).select("workspace", "path", "quality")
    name = F.when(F.col("quality") == 0, F.concat("name", F.lit("Old"))).otherwise(F.col("name"))
    return symbols(spark, sf_dir).join(quality, ["workspace", "path"]).withColumn("name", name).drop("quality")


def open_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsaved texts: toxic documents under edit, and benchmark items as files not stored yet."""
    edited = (
        labelled(spark, sf_dir)
        .where(F.col("toxic") == 1)
        .select("workspace", "path", F.concat(F.lit("unsaved\n"), "text").alias("text"))
    )
    new = table(spark, sf_dir, "benchmark").select(
        F.lit("scratch").alias("workspace"), F.concat(F.lit("item/"), "item_id").alias("path"), "text"
    )
    return edited.unionByName(new)



def _instant(column: str):
    """A timestamp without zone, taken as UTC."""
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    )


def document_events(spark: SparkSession, sf_dir: str, keep: list[str] = ()) -> DataFrame:
    """``events`` as editor messages: a user's signup opens a document, an error closes it, all else edits it."""
    uri = F.concat(F.lit("file:///u/"), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    method = F.when(kind == "signup", OPEN).when(kind == "error", CLOSE).otherwise(CHANGE)
    opened = F.format_string(
        '{"textDocument":{"uri":"%s","languageId":"log","version":%d,"text":"start %d\\n"}}',
        uri, F.col("event_id"), F.col("event_id"),
    )
    closed = F.format_string('{"textDocument":{"uri":"%s"}}', uri)
    changed = F.format_string(
        '{"textDocument":{"uri":"%s","version":%d},"contentChanges":[{"range":{"start":'
        '{"line":0,"character":0},"end":{"line":0,"character":0}},"text":"%s\\n"}]}',
        uri, F.col("event_id"), kind,
    )
    params = F.when(kind == "signup", opened).when(kind == "error", closed).otherwise(changed)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), method.alias("method"), params.alias("params"), _instant("ts").alias("ts"),
        *keep,
    )


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages with a symbol query for each purchase, and JSON that breaks off where value > 50."""
    is_query = F.col("event_type") == "purchase"
    query = F.format_string('{"query":"user %d"}', F.col("seq"))
    events = document_events(spark, sf_dir, keep=["event_type", "value"])
    params = F.when(is_query, query).otherwise(F.col("params"))
    broken = F.when(F.col("value") > 50, F.substring(params, F.lit(1), F.length(params) - 1))
    return events.select(
        "seq",
        F.when(is_query, "workspace/symbol").otherwise(F.col("method")).alias("method"),
        F.coalesce(broken, params).alias("params"),
        "ts",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chunk streams."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), "text"
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context spec per document; the variety follows the label, the last one is wrong."""
    path, label = F.col("path"), F.col("quality") + 2 * F.col("toxic")
    first_word = F.regexp_extract("text", f"^({NAME})", 1)
    spec = (
        F.when(label.isNull(), F.concat(path, F.lit("\n\n"), path, F.lit(" 1:2 "), first_word, F.lit(' "2:2"')))
        .when(label == 0, F.concat(F.lit('"'), path, F.lit('" 3:4 1:1000')))
        .when(label == 1, F.concat(path, F.lit(" A")))
        .when(label == 2, F.concat(path, F.lit("\n"), path, F.lit(" 7:3")))
        .otherwise(F.concat(path, F.lit(' "1:1')))
    )
    return (
        files(spark, sf_dir)
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("spec_id"), "workspace", spec.alias("spec"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.round(F.col("value") * 1000000).cast("bigint").alias("nanos")
    )


def document_tree(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Write every document below root as a file of its own, by tasks; gives the written paths."""

    default = default_filesystem(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = open_filesystem(root, default=default)
        for batch in batches:
            for row in batch.itertuples(index=False):
                folder, _, name = row.path.rpartition("/")
                system.create_dir(f"{inner}/{folder}", recursive=True)
                with system.open_output_stream(f"{inner}/{folder}/{name}", compression=None) as stream:
                    stream.write(row.text.encode())
            yield pd.DataFrame({"path": root + "/" + batch["path"]})

    return text_batches(files(spark, sf_dir).select("path", "text")).mapInPandas(write, "path string")
