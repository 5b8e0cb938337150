"""Packing by cutting stock: column generation over length-histogram patterns, assigned to ranked documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.shared import placed_in_order, prefix_sums, stored, text_batches
from symloom.llm.tokens import encoder

#: Lengths are counted in classes of this many tokens, rounded up.
UNIT = 8
#: Column generation stops here at the latest; what it has by then is a valid solution.
MAX_PIVOTS = 6000
#: Prices divided by the worth of the best pattern are feasible for the dual program, so at this worth the
#: program is within a thousandth of its optimum.
CLOSE_ENOUGH = 1.001
PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
#: Pieces below this length are packed in bundles of about so many tokens, since a class would waste much of them.
SHORT, BUNDLE = 64, 128


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Tokenize documents and cut them: whole sequences of ``capacity`` tokens, and one rest of what is left.

    One row per piece, with the checksum of its ids and, when asked for, the ids as little-endian unsigned 32-bit integers.
    A null text is empty, so its document is the end id alone. A null id stays null; each row is a document of its own.
    """
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [data + end for data in encoder(tokenizer).encode(batch["text"].tolist())]
            tokens = np.fromiter(map(len, held), np.int64, len(held)) // 4
            counts = -(-tokens // capacity)
            row = np.repeat(np.arange(len(held)), counts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
            parts = [data[k : k + step] for data in held for k in range(0, len(data), step)]
            numbers = pd.array(batch["id"].to_numpy()[row], dtype="Int64")
            numbers[batch["_none"].to_numpy()[row]] = pd.NA
            yield pd.DataFrame({
                "doc_id": numbers, "start": start, "length": np.minimum(capacity, tokens[row] - start), "doc_tokens": tokens[row],
                "ids_crc32": np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)),
                "ids": parts if with_ids else [None] * len(parts),
            })

    rows = text_batches(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(id_col).isNull().alias("_none"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    pieces = rows.mapInPandas(cut, PIECES)
    return pieces if with_ids else pieces.drop("ids")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest pattern that fits, by dynamic programming over the capacity (unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room], choice[room] = value[room - 1], -1
        k = fitting[room]
        if k:
            with_item = value[room - sizes[:k]] + prices[:k]
            best = int(np.argmax(with_item))
            if with_item[best] > value[room] + 1e-12:
                value[room], choice[room] = with_item[best], best
    counts = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often to use each, so that every class is served exactly.

    The linear program starts with patterns of one class each. Its dual prices go to the knapsack, whose best
    pattern enters the basis by a simplex step, until none is worth much more than a sequence. Uses are rounded
    down; what then remains (less than one use per pattern of the basis) is packed by first fit decreasing.
    """
    if not len(sizes):
        return []
    most = capacity // sizes
    basis = np.diag(most.astype(float))
    inverse = np.diag(1.0 / most)
    uses = demand / most
    for _ in range(MAX_PIVOTS):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, prices, capacity)
        if worth <= CLOSE_ENOUGH:
            break
        step = inverse @ pattern
        ratio = np.full(len(step), np.inf)
        np.divide(uses, step, out=ratio, where=step > 1e-9)
        leaving = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaving]):
            break
        by = uses[leaving] / step[leaving]
        uses = np.maximum(uses - by * step, 0)
        uses[leaving] = by
        pivot_row = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, pivot_row)
        inverse[leaving] = pivot_row
        basis[:, leaving] = pattern
    patterns, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-uses, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        needed = pattern > 0
        times = min(int(uses[k] + 1e-6), int((left[needed] // pattern[needed]).min()))
        if times > 0:
            patterns.append((times, pattern))
            left -= times * pattern
    bins: list[np.ndarray] = []
    rooms: list[int] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            at = next((b for b, room in enumerate(rooms) if room >= sizes[k]), None)
            if at is None:
                at = len(rooms)
                rooms.append(capacity)
                bins.append(np.zeros(len(sizes), np.int64))
            rooms[at] -= int(sizes[k])
            bins[at][k] += 1
    return patterns + [(1, pattern) for pattern in bins]


class Plan:
    """Where the n-th piece goes when pieces are ranked by class: a table with a row per class of each pattern."""

    def __init__(self, histogram: dict[int, int], capacity_units: int):
        classes = np.array(sorted(c for c in histogram if c <= capacity_units), np.int64)
        demand = np.array([histogram[int(c)] for c in classes], np.int64)
        starts, each, base, first = [], [], [], 0
        served = np.cumsum(demand) - demand
        for times, pattern in cutting_stock(classes, demand, capacity_units):
            for k in np.flatnonzero(pattern):
                starts.append(int(served[k]))
                each.append(int(pattern[k]))
                base.append(first)
                served[k] += times * pattern[k]
            first += times
        # Pieces that fill a sequence come last in rank; each is a sequence of its own.
        starts.append(int(demand.sum()))
        each.append(1)
        base.append(first)
        order = np.argsort(np.array(starts), kind="stable")
        self.starts, self.each, self.base = (np.array(x, np.int64)[order] for x in (starts, each, base))

    def sequence_of(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, rank, side="right") - 1
        return self.base[at] + (rank - self.starts[at]) // self.each[at]


def bundled(short: DataFrame, size: int = BUNDLE) -> tuple[DataFrame, DataFrame]:
    """Short pieces, each with its ``bundle`` and its place ``inside``, and the bundles ``(doc_id, start, length)``.

    Pieces follow each other by length, document and place; the tokens before a piece tell its bundle, which starts within
    ``size`` tokens and ends with a piece. A bundle's number stands in the place of a document's.
    """
    order = ["length", "doc_id", "start"]
    summed = prefix_sums(placed_in_order(short, order, "short-pieces"), order, {"tokens": F.col("length")})
    numbered = stored(summed.withColumn("bundle", F.expr(f"before_tokens div {size}")).drop("total_tokens"), "bundled")
    bundles = numbered.groupBy("bundle").agg(F.min("before_tokens").alias("first"), F.sum("length").alias("length"))
    inside = numbered.join(bundles.select("bundle", "first"), "bundle")
    placed = inside.withColumn("inside", F.col("before_tokens") - F.col("first")).drop("before_tokens", "first")
    return placed, bundles.select(F.col("bundle").alias("doc_id"), F.lit(0).cast("long").alias("start"), "length")


def pack(pieces: DataFrame, capacity: int, unit: int = UNIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``doc_id``, ``start`` and ``length``.

    A sequence holds at most ``capacity`` tokens; its pieces lie without gaps from 0. Pieces below ``SHORT`` tokens are packed in
    bundles, the others alone. The driver gets the histogram, at most ``capacity / unit`` + 1 rows, and solves the program
    on it. What is packed is ranked by class, document and place over a range partitioning with totals per part, so a class of any size
    is spread; a sequence has at most ``capacity`` pieces. No pieces give no rows. Rows equal in every ranked column
    are interchangeable.
    """
    columns = pieces.columns
    is_short = F.col("length") < min(SHORT, capacity // 4)
    short, bundles = bundled(pieces.where(is_short), min(BUNDLE, capacity // 2))
    items = pieces.where(~is_short).withColumn("_bundle", F.lit(False))
    items = items.unionByName(bundles.withColumn("_bundle", F.lit(True)), allowMissingColumns=True)
    seated = stored(_seated(items, capacity, unit), "seated")
    alone = seated.where("not _bundle").select(*columns, "sequence_id", "offset")
    at = seated.where("_bundle").select(F.col("doc_id").alias("bundle"), "sequence_id", F.col("offset").alias("_offset"))
    within = short.join(at, "bundle").withColumn("offset", F.col("_offset") + F.col("inside"))
    return alone.unionByName(within.select(*columns, "sequence_id", "offset"))


def _seated(items: DataFrame, capacity: int, unit: int) -> DataFrame:
    units = capacity // unit
    full = F.col("length") >= capacity
    classed = items.withColumn("_class", F.when(full, units + 1).otherwise(F.ceil(F.col("length") / unit)).cast("int"))
    histogram = {r["_class"]: r["count"] for r in classed.groupBy("_class").count().collect()}
    plan = Plan(histogram, units)
    order = ["_class", "_bundle", "doc_id", "start"]
    ranked = prefix_sums(placed_in_order(classed, order, "pieces"), order, {"rows": F.lit(1).cast("long")})

    @F.pandas_udf("long")
    def sequence(rank: pd.Series) -> pd.Series:
        return pd.Series(plan.sequence_of(rank.to_numpy()))

    seated = ranked.withColumn("sequence_id", sequence("before_rows"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "before_rows")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return seated.withColumn("offset", offset).drop("_class", "before_rows", "total_rows")
