"""Timing statistics and listing comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duration_stats(samples: DataFrame, group: list[str], value: str = "nanos") -> DataFrame:
    """Average (whole nanoseconds, truncated), minimum and maximum per group."""
    return samples.groupBy(*group).agg(
        F.expr(f"sum({value}) div count({value})").alias("avg_nanos"),
        F.min(value).alias("min_nanos"),
        F.max(value).alias("max_nanos"),
    )


def duration_ratio(samples: DataFrame, group: str, subject: str, base: str, value: str = "nanos") -> DataFrame:
    """Ratio of the averages of two groups, and whether the subject is slower or faster than the base."""

    def average(name: str):
        nanos = F.when(F.col(group) == name, F.col(value))
        total, rows = F.sum(nanos), F.count(nanos)
        return ((total - total % rows) / rows).alias(f"_{name}")

    return samples.agg(average(subject).alias("_subject"), average(base).alias("_base")).select(
        F.lit(subject).alias("subject"),
        F.lit(base).alias("base"),
        (F.col("_subject") / F.col("_base")).alias("ratio"),
        F.when(F.col("_subject") / F.col("_base") > 1, "slower").otherwise("faster").alias("verdict"),
    )


def compare_listings(first: DataFrame, second: DataFrame) -> DataFrame:
    """File counts of two listings, and whether they differ; both are counted in one aggregate."""
    tagged = first.select(F.lit(1).alias("_of")).unionByName(second.select(F.lit(2).alias("_of")))
    count = lambda number: F.count(F.when(F.col("_of") == number, 1))
    return tagged.agg(count(1).alias("n_first"), count(2).alias("n_second")).withColumn(
        "mismatch", F.col("n_first") != F.col("n_second")
    )
