"""Workspace configuration and model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import paths

# Model names where a configuration gives none.
DEFAULT_MODEL = "llama3.1:8b"
DEFAULT_EMBEDDING_MODEL = "nomic-embed-text"
DEFAULT_EXPLAIN_CODE_MODEL = "starcoder2:3b"


def _lowest_per(config: DataFrame, key: Column, row: Column) -> DataFrame:
    """One configuration per key: that of the lowest name."""
    return (
        config.withColumn("_key", key)
        .where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.min_by(row, F.col("name")).alias("_row"))
    )


def resolve_workspace_config(directories: DataFrame, config: DataFrame) -> DataFrame:
    """Configuration of each directory: an exact path beats a name equal to the base name; else the default.

    Both matches are equi-joins to one configuration per key; Spark broadcasts them while they are small.
    """
    row = F.struct("name", "path", "include", "exclude")
    by_path = _lowest_per(config, F.col("path"), row).select(
        F.col("_key").alias("directory"), F.col("_row").alias("_by_path")
    )
    by_name = _lowest_per(config, F.col("name"), row).select(
        F.col("_key").alias("_base"), F.col("_row").alias("_by_name")
    )
    matched = (
        directories.withColumn("_base", paths.base_name(F.col("directory")))
        .join(by_path, "directory", "left")
        .join(by_name, "_base", "left")
    )
    best = F.coalesce("_by_path", "_by_name")
    nothing = F.array().cast("array<string>")
    return matched.select(
        *directories.columns,
        F.coalesce(best["name"], F.col("_base")).alias("config_name"),
        F.coalesce(best["include"], nothing).alias("include"),
        F.coalesce(best["exclude"], nothing).alias("exclude"),
        F.when(F.col("_by_path").isNotNull(), "path")
        .when(F.col("_by_name").isNotNull(), "name")
        .otherwise("default")
        .alias("matched_by"),
    )


def model_defaults(models: DataFrame) -> DataFrame:
    """Fill the missing model names."""
    fill = {
        "default_model": DEFAULT_MODEL,
        "embedding": DEFAULT_EMBEDDING_MODEL,
        "explain_code": DEFAULT_EXPLAIN_CODE_MODEL,
    }
    return models.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
