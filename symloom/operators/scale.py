"""Building blocks that keep one hot key from landing in one task.

* ``join_unique``: equi-join to a side with unique keys; hot keys are salted.
* ``join_in_blocks``: equi-join of two sides that may both have many rows of a key, block by block.
* ``running_totals``: running sums in two levels, blocks first, so a hot group is spread over tasks.
* ``concat_in_order``: ordered concatenation by blocks, one whole text per key.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A key with more rows than this gets a salt for each such share; the most frequent keys, 100 bytes each or so, are sent
# to the tasks.
ROWS_PER_SALT = 1_000_000
HOT_KEYS = 65536
# The same for rows that take or carry a text: their number says little of their bytes.
TEXTS_PER_SALT = 4096
ROWS_PER_BLOCK = 65536
# A task of ``join_in_blocks`` meets about the square of this many pairs of a key at a time.
ROWS_PER_JOIN_BLOCK = 4096
# It gives about that many pairs in all; beyond so many tasks each gives more.
PAIRS_PER_TASK = ROWS_PER_JOIN_BLOCK**2
MOST_TASKS = 16384
ROWS_PER_TEXT_BLOCK = 512
# A row holds one text; Spark's rows end at 2 GB.
MAX_TEXT_BYTES = 1 << 30

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE_HERE = (Window.unboundedPreceding, -1)


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    salt_by: list[str] | None = None,
    counted: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds each key once.

    A key with more than ``rows_per_salt`` rows of ``left`` is split into shares of about that many, and its
    row of ``right`` is repeated for each. ``salt_by`` names the columns that tell the rows of one key apart (all
    columns when not given). The keys are counted in ``left``, or in the cheaper frame ``counted`` that has the
    same keys: ``left`` is read twice otherwise, so give it a stored or checkpointed table when it is dear to
    compute. Of keys beyond the ``HOT_KEYS`` most frequent, none has more than that part of all rows.
    """
    hot = (
        (left if counted is None else counted)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_salt)
        .orderBy(F.desc("_rows"), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_salt).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*(salt_by or left.columns)), salts).cast("int")
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt)
    repeated = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted.drop("_salts").join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_in_blocks(
    left: DataFrame, right: DataFrame, keys: list[str], rows_per_block: int = ROWS_PER_JOIN_BLOCK, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Inner join of two sides that may both have many rows of a key, in blocks of about ``rows_per_block`` rows of a key.

    Every block of a key's rows on the left meets every block of them on the right under a key of its own, so no task holds or
    gives more than a pair of blocks of a key. A side is copied to the blocks of the other side: a pair of rows costs
    ``2 / rows_per_block`` copies. Only keys of more than a block are sent to the tasks, at most one for each block of
    all rows. The pairs are counted first and dealt to as many tasks as they need, since the bytes of the sides say little of
    them. Both sides are read several times: give stored tables.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        many = counted(df, "_rows").where(F.col("_rows") > rows_per_block)
        return F.broadcast(many.select(*keys, F.ceil(F.col("_rows") / rows_per_block).cast("int").alias(name)))

    pairs = counted(left, "_m").join(counted(right, "_n"), keys).agg(F.sum(F.col("_m") * F.col("_n").cast("double"))).first()[0]
    tasks = min(ceil((pairs or 0) / pairs_per_task), MOST_TASKS)
    usual = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_left, of_right = blocks(left, "_left_blocks"), blocks(right, "_right_blocks")
    pair = ["_left", "_right"]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        number = lambda side: F.coalesce(f"_{side}_blocks", F.lit(1))
        rows = (
            df.join(of_left, keys, "left")
            .join(of_right, keys, "left")
            .withColumn(f"_{own}", F.pmod(F.xxhash64(*df.columns), number(own)).cast("int"))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), number(other) - 1)))
            .drop("_left_blocks", "_right_blocks")
        )
        return rows.repartition(max(tasks, usual), *keys, *pair) if tasks > 1 else rows

    return dealt(left, "left", "right").join(dealt(right, "right", "left"), [*keys, *pair]).drop(*pair)


def seq_block(seq: str, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block number of an integer order column."""
    return F.expr(f"`{seq}` div {rows}")


def _keyed(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Add the block; rows without a key have no place in any group.

    Both readers of the blocks get the same filter here, so Spark can share one shuffle between them.
    """
    blocked = df.withColumn("_block", block)
    for key in (*keys, "_block"):
        blocked = blocked.where(F.col(key).isNotNull())
    return blocked


def running_totals(
    df: DataFrame, group: list[str], order: list[str], block: Column, sums: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums per group.

    ``block`` must not decrease along ``order``. The rows are shuffled by group and block, even where they
    are partitioned by the group already; what a single task sees of a hot group is some of its blocks,
    and one short row per block for the carry.
    """
    blocked = _keyed(df, group, block)
    totals = blocked.groupBy(*group, "_block").agg(
        *[F.sum(amount).alias(f"_sum_{name}") for name, amount in sums.items()]
    )
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(*BEFORE_HERE)
    carry = totals.select(
        *group,
        "_block",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums],
    )
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(*UP_TO_HERE)
    spread = blocked.repartition(*group, "_block")
    local = spread.select("*", *[F.sum(amount).over(inside).alias(name) for name, amount in sums.items()])
    added = local.join(carry, [*group, "_block"])
    for name in sums:
        added = added.withColumn(name, F.col(name) + F.col(f"_carry_{name}"))
    return added.drop("_block", *[f"_carry_{name}" for name in sums])


def concat_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    block: Column,
    result: str = "text",
    error: str | None = None,
    highest: str | None = None,
    max_bytes: int = MAX_TEXT_BYTES,
) -> DataFrame:
    """Concatenate ``text`` per key in order: one row per key with its whole text, at any size that a row can hold.

    The texts of a block are joined first, so a key of many short rows is joined by many tasks and the last
    step moves its blocks only. A text beyond ``max_bytes`` stops the job and names its key: it would not fit a row.
    With an ``error`` column, a key with any error gives its first error and no text. The largest value of
    the column ``highest`` comes along with each key.
    """
    mark = F.lit(None) if highest is None else F.col(highest)
    failure = F.lit(None).cast("string") if error is None else F.col(error)
    piece = F.struct(*order, F.when(failure.isNull(), F.col(text)).alias("_text"), failure.alias("_error"))
    blocks = (
        _keyed(df, keys, block)
        .repartition(*keys, "_block")
        .groupBy(*keys, "_block")
        .agg(F.array_sort(F.collect_list(piece)).alias("_pieces"), F.max(mark).alias("_mark"))
        .select(
            *keys,
            "_block",
            "_mark",
            F.array_join(F.transform("_pieces", lambda p: p["_text"]), "").alias("_text"),
            F.get(
                F.filter(F.transform("_pieces", lambda p: p["_error"]), lambda e: e.isNotNull()), F.lit(0)
            ).alias("_error"),
        )
    )
    whole = blocks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_block", "_text"))).alias("_texts"),
        F.sum(F.octet_length("_text").cast("bigint")).alias("_bytes"),
        F.min(F.when(F.col("_error").isNotNull(), F.struct("_block", "_error"))).alias("_first"),
        F.max("_mark").alias("_mark"),
    )
    too_long = F.raise_error(
        F.concat(F.lit("text longer than a row can hold: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
    )
    joined = F.array_join(F.transform("_texts", lambda p: p["_text"]), "")
    columns = [
        F.when(F.col("_first").isNotNull(), None)
        .when(F.col("_bytes") > max_bytes, too_long.cast("string"))
        .otherwise(joined)
        .alias(result)
    ]
    if error is not None:
        columns.append(F.col("_first._error").alias(error))
    if highest is not None:
        columns.append(F.col("_mark").alias(highest))
    return whole.select(*keys, *columns)
