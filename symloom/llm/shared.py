"""Helpers of the training-data operators: stored tables, order over range partitions, connected components."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.session import discard, stored, text_batches  # noqa: F401

#: Bins of one look for an order statistic, and the rows that are few enough to be sorted in one place.
BINS = 1024


def least_of_top(counts: DataFrame, number: str, limit: int) -> int | None:
    """The lowest number that at most ``limit`` rows reach; None when more rows share the highest one, or none exist.

    The driver gets the numbers that occur.
    """
    per_count = counts.groupBy(number).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc(number)).limit(limit + 1)
    taken, least = 0, None
    for row in per_count.collect():
        taken += row["_rows"]
        if taken > limit:
            break
        least = row[number]
    return least


def most_frequent(counts: DataFrame, name: str, number: str, limit: int) -> list:
    """At most ``limit`` rows with the highest counts: those above the lowest count that leaves no more than that.

    Rows with equal counts are taken together or not at all. The driver gets the counts that occur, and the rows.
    """
    least = least_of_top(counts, number, limit)
    if least is None:
        return []
    return sorted(counts.where(F.col(number) >= least).select(name, *[c for c in counts.columns if c != name]).collect())


def kth_smallest(rows: DataFrame, column: str, k: int) -> float | None:
    """The value that ``k`` others precede in order, exactly; counts of bins narrow it down until few rows are left."""
    value = F.col(column)
    while True:
        n, low, high = rows.agg(F.count(value), F.min(value), F.max(value)).first()
        if n <= k or low == high:
            return None if n <= k else low
        if n <= BINS:
            return sorted(r[0] for r in rows.select(value).collect())[k]
        bin_of = F.least(F.floor((value - low) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        for number, count in sorted(map(tuple, rows.groupBy(bin_of).count().collect())):
            if k < count:
                rows = rows.where(bin_of == number)
                break
            k -= count


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, for caches that later tasks of the worker use again."""
    module = sys.modules.setdefault("symloom_worker_state", types.ModuleType("symloom_worker_state"))
    return module.__dict__.setdefault(name, {})


def placed_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Range-partition rows by ``order`` and store them with the number ``_part`` of their partition.

    Every row of a part comes before every row of the next. ``_tie`` is unique, so that even a third of all
    rows with equal values is split among parts.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id())
    return stored(ranged, name)


def prefix_sums(placed: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add to rows of ``placed_in_order`` the sums over all rows before them, ``before_<name>``, and ``total_<name>``.

    Totals of the parts (one short row for each) are summed first; each part then sums inside itself.
    """
    totals = placed.groupBy("_part").agg(*[F.sum(amount).cast("long").alias(f"_in_{n}") for n, amount in sums.items()])
    parts = Window.orderBy("_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    every = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in sums],
        *[F.sum(f"_in_{n}").over(every).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*", *[F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long").alias(f"_sum_{n}") for n, amount in sums.items()]
    )
    joined = local.join(F.broadcast(carry), "_part")
    for n in sums:
        joined = joined.withColumn(f"before_{n}", F.col(f"_sum_{n}") + F.col(f"_carry_{n}"))
    return joined.drop("_part", "_tie", *[f"_sum_{n}" for n in sums], *[f"_carry_{n}" for n in sums])


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    Rounds of contraction: every node hangs on its smallest neighbour, chains are shortened by doubling, and
    the edges between the remaining roots go to the next round. A round leaves at most half of the nodes that
    still have an edge. Sums and minima combine before the shuffle; the joins read stored tables, so that
    adaptive execution can split a node with many edges. Only counts reach the driver.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        parent = stored(parent, f"{name}-parent")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("up"))
            jumped = stored(parent.join(up, "p").select("a", F.col("up").alias("p"), (F.col("p") != F.col("up")).alias("moved")), f"{name}-jump")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), "p")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = stored(labels, f"{name}-labels")
        of_a = edges.join(parent, "a").select(F.col("p").alias("a"), "b")
        of_b = of_a.join(parent.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        edges = stored(of_b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    return labels
