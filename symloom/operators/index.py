"""Index upkeep as joins: what changed, what to remove, what replaces it, and counts over it.

Every join is keyed by workspace and path, which tell the files apart, never by the workspace alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import paths
from symloom.operators.scale import BEFORE_HERE, UP_TO_HERE
from symloom.session import checkpointed

FILE_KEY = ["workspace", "path"]


def detect_changed_files(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Files that are new, or differ from the indexed content."""
    return scan.join(index.select(*FILE_KEY, "md5"), [*FILE_KEY, "md5"], "left_anti")


def skip_unchanged_files(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Files that are indexed with the same content."""
    return scan.join(index.select(*FILE_KEY, "md5"), [*FILE_KEY, "md5"], "left_semi")


def delete_files(files: DataFrame, symbols: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and their symbols without those of ``gone(workspace, path)``: every row of such a path goes."""
    keys = gone.select(*FILE_KEY)
    return files.join(keys, FILE_KEY, "left_anti"), symbols.join(keys, FILE_KEY, "left_anti")


def replace_file_index(
    files: DataFrame,
    symbols: DataFrame,
    changed: DataFrame,
    new_symbols: DataFrame,
    scan: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The next files and symbols: rows of changed files are swapped, all others stay.

    Files that are gone from disk stay too. Given the ``scan``, they are dropped instead.
    """
    kept_files, kept_symbols = delete_files(files, symbols, changed)
    if scan is not None:
        present = scan.select(*FILE_KEY)
        kept_files = kept_files.join(present, FILE_KEY, "left_semi")
        kept_symbols = kept_symbols.join(present, FILE_KEY, "left_semi")
    next_files = kept_files.select(*FILE_KEY, "md5").unionByName(changed.select(*FILE_KEY, "md5"))
    return next_files, kept_symbols.unionByName(new_symbols)


def symbols_per_file(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol count of every indexed file, 0 included."""
    counts = symbols.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("n_symbols"))
    return (
        files.select(*FILE_KEY)
        .join(counts, FILE_KEY, "left")
        .withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)).cast("bigint"))
    )


def index_totals(per_file: DataFrame) -> DataFrame:
    return per_file.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("n_symbols")
    )


def failed_files(files: DataFrame) -> DataFrame:
    """One row per file whose extraction failed, with the reason."""
    return files.where(F.col("error").isNotNull()).select(*FILE_KEY, "error")


def running_symbol_totals(per_file: DataFrame) -> DataFrame:
    """Running symbol total after each file, in the order a directory walk visits the files.

    The files are range-partitioned by workspace and visit order, so a workspace of any size is spread
    over the partitions; one short row per partition carries the total on.
    """
    ranged = checkpointed(
        per_file.withColumn("_visit", paths.walk_order(F.col("path")))
        .repartitionByRange("workspace", "_visit")
        .withColumn("_block", F.spark_partition_id())
    )
    totals = ranged.groupBy("workspace", "_block").agg(F.sum("n_symbols").alias("_sum"))
    before = Window.partitionBy("workspace").orderBy("_block").rowsBetween(*BEFORE_HERE)
    carry = totals.select(
        "workspace", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy("workspace", "_block").orderBy("_visit").rowsBetween(*UP_TO_HERE)
    return (
        ranged.withColumn("_local", F.sum("n_symbols").over(inside))
        .join(carry, ["workspace", "_block"])
        .select(*FILE_KEY, "n_symbols", (F.col("_local") + F.col("_carry")).alias("total_symbols"))
    )
