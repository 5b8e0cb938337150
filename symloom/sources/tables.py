"""Index tables on shared storage, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import paths
from symloom.session import hadoop_path, scratch_dir


def write_file_table(files: DataFrame, path: str, mode: str = "append") -> None:
    """File rows ``(workspace, path, md5)`` with their id, one directory per workspace."""
    (
        files.select(
            paths.file_id(F.col("workspace"), F.col("path")).alias("file_id"), "workspace", "path", "md5"
        )
        .write.mode(mode)
        .partitionBy("workspace")
        .parquet(path)
    )


def write_symbol_table(
    symbols: DataFrame, path: str, embedding_path: str | None = None, mode: str = "append"
) -> None:
    """Symbol rows; an embedding row for each symbol that has one.

    Range-partitioned and sorted by workspace and folded name, so that a prefix reads few files and, by their
    statistics, few row groups of them. The rows are written once to the shared folder and the tables come from there:
    range partitioning reads its input twice, but symbols are extracted, and a model is asked, once.
    """
    spark = symbols.sparkSession
    made = scratch_dir(spark, "made-symbols")
    symbols.write.parquet(made)
    symbols = spark.read.schema(symbols.schema).parquet(made)
    columns = [c for c in symbols.columns if c not in ("embedding", "symbol_text")]
    (
        symbols.select(*columns)
        .repartitionByRange("workspace", "name_fold", "symbol_id")
        .sortWithinPartitions("workspace", "name_fold")
        .write.mode(mode)
        .partitionBy("workspace")
        .parquet(path)
    )
    if embedding_path is not None:
        (
            symbols.where(F.col("embedding").isNotNull())
            .select("workspace", "symbol_id", F.col("embedding").cast("array<float>").alias("embedding"))
            .write.mode(mode)
            .partitionBy("workspace")
            .parquet(embedding_path)
        )
    folder, system = hadoop_path(spark, made)
    system.delete(folder, True)


def read_workspace_index(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """The rows of exactly one workspace; other workspaces' directories are not listed by the scan."""
    return spark.read.parquet(path).where(F.col("workspace") == F.lit(workspace))


def symbol_record() -> Column:
    """A symbol as its report record. Needs the location column."""
    return F.struct(
        F.col("name"),
        F.col("kind"),
        F.col("location"),
        F.col("path").alias("RelativePath"),
        F.lit("").alias("Description"),
        F.lit(None).cast("array<double>").alias("Embedding"),
    )


def index_report_json(files: DataFrame, located_symbols: DataFrame) -> DataFrame:
    """``{"symbols": [...]}`` per file, NULL list for a file without symbols.

    The list holds the symbols of one file, so the text of that file bounds it.
    """
    per_file = located_symbols.groupBy("workspace", "path").agg(
        F.array_sort(F.collect_list(F.struct("symbol_no", symbol_record().alias("record")))).alias("_list")
    )
    return (
        files.select("workspace", "path")
        .join(per_file, ["workspace", "path"], "left")
        .select(
            "workspace",
            "path",
            F.to_json(
                F.struct(F.transform("_list", lambda s: s["record"]).alias("symbols")),
                {"ignoreNullFields": "false"},
            ).alias("report"),
        )
    )


def _float_text(value: Column) -> Column:
    """Shortest decimal digits of a float32; exponents only below 1e-4 and from 1e21 on, as in ``1e-05``."""

    def digits(count: int) -> Column:
        return F.format_string(f"%.{count - 1}e", value.cast("double"))

    # Six to nine digits tell any two float32 values apart; the first count that reads back is the shortest.
    exact = F.coalesce(*[F.when(digits(n).cast("float") == value, digits(n)) for n in (6, 7, 8)], digits(9))
    mantissa = F.regexp_replace(F.substring_index(exact, "e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(exact.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    size = F.abs(value)
    return (
        F.when(value == 0, "0")
        .when(
            (size < F.lit(1e-4).cast("float")) | (size >= F.lit(1e21).cast("float")),
            F.concat(mantissa, F.lit("e"), F.substring_index(exact, "e", -1)),
        )
        .otherwise(plain)
    )


def format_embedding(embedding: Column) -> Column:
    """``[a, b, ...]`` of the values narrowed to float32, and the dimension count."""
    narrow = embedding.cast("array<float>")
    return F.struct(
        F.concat(F.lit("["), F.array_join(F.transform(narrow, _float_text), ", "), F.lit("]")).alias("vector"),
        F.size(narrow).alias("dimensions"),
    )


def open_documents_snapshot(states: DataFrame) -> DataFrame:
    """Open documents as ``uri`` and wire record, one row per document.

    A reply that is one map of all of them would not fit a row at scale; each row is one entry of it.
    """
    return states.where("is_open").select(
        "uri",
        F.struct("uri", "language_id", "version", "text", "last_edit", "last_edited_line").alias("document"),
    )
