"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.shared import placed_in_order, prefix_sums, stored

ORDER = ["id", "text_crc32", "size"]


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", extra: int = 8) -> DataFrame:
    """Contiguous shards of near equal bytes: ``(id, size, text_crc32, shard, slot)``, one row per document.

    Documents are ordered by id (nulls first; equal ids by text checksum and size; rows equal in all of that
    keep the order they are read in). A document's size is the UTF-8 bytes of its text plus ``extra``; a null
    text has no bytes and the checksum 0. The document whose middle byte lies in the n-th of ``shards`` equal
    parts of all bytes goes to shard n, so shards differ from the target by less than the two documents
    at their ends. ``slot`` counts from 0 in a shard. An empty table gives no rows. Other columns are ignored.

    Only ids, sizes and checksums are shuffled. A part of the range partitioning is summed on its own; what is
    shared are one row per part and one per shard.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(extra)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = placed_in_order(rows, ORDER, "shard-sizes")
    summed = prefix_sums(placed, ORDER, {"bytes": F.col("size"), "rows": F.lit(1).cast("long")})
    part = F.expr(f"((2 * before_bytes + size) * {shards}) div greatest(2 * total_bytes, 1)")
    cut = stored(
        summed.withColumn("shard", F.least(part, F.lit(shards - 1)).cast("int"))
        .select("id", "size", "text_crc32", "shard", "before_rows"),
        "shard-cuts",
    )
    first = cut.groupBy("shard").agg(F.min("before_rows").alias("_first"))
    return cut.join(F.broadcast(first), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("before_rows") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write documents with unique ids as one folder of Parquet files per shard, in the order of their slots."""
    keys = assigned.select(F.col("id").alias(id_col), "shard", "slot")
    joined = docs.drop("shard", "slot").join(keys, id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
