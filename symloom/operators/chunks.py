"""Ordered text chunks of a stream: full text, insert positions, finished lines.

``chunks(stream_id, seq, text)`` with a unique integer seq per stream. A stream may hold any share of all
chunks: positions come from running totals in two levels, texts are joined block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import text as tx
from symloom.operators import scale

STREAM = ["stream_id"]


def stream_full_text(chunks: DataFrame) -> DataFrame:
    """All chunks of a stream in order as one text."""
    return scale.concat_in_order(
        chunks,
        STREAM,
        ["seq"],
        "text",
        scale.seq_block("seq", scale.ROWS_PER_TEXT_BLOCK),
        result="full_text",
    )


def stream_cursor(
    chunks: DataFrame,
    starts: DataFrame | None = None,
    unit: str = "char",
    rows_per_block: int = scale.ROWS_PER_BLOCK,
) -> DataFrame:
    """Where each chunk is inserted, and the cursor after it.

    ``starts(stream_id, line, character)`` gives the first cursor, 0:0 where there is none. Lines add up.
    The column after a chunk is its running length less the running length at the last newline; that
    baseline never falls, so a running maximum finds it and no chunk looks back for a reset.
    """
    offset = tx.text_end_offset(F.col("text"), unit)
    blocked = chunks.select(
        "stream_id",
        "seq",
        "text",
        scale.seq_block("seq", rows_per_block).alias("_block"),
        offset["line"].cast("bigint").alias("_lines"),
        offset["character"].cast("bigint").alias("_chars"),
    )
    inside = Window.partitionBy("stream_id", "_block").orderBy("seq")
    local = blocked.repartition("stream_id", "_block").withColumns(
        {
            "_line_sum": F.sum("_lines").over(inside.rowsBetween(*scale.UP_TO_HERE)),
            "_char_sum": F.sum("_chars").over(inside.rowsBetween(*scale.UP_TO_HERE)),
        }
    ).withColumn("_at_newline", F.when(F.col("_lines") > 0, F.col("_char_sum") - F.col("_chars")))
    totals = local.groupBy("stream_id", "_block").agg(
        F.sum("_lines").alias("_lines"), F.sum("_chars").alias("_chars"), F.max("_at_newline").alias("_base")
    )
    before = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(*scale.BEFORE_HERE)
    sums = totals.select(
        "stream_id",
        "_block",
        "_base",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_carry_lines"),
        F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_carry_chars"),
    )
    carry = sums.select(
        "stream_id",
        "_block",
        "_carry_lines",
        "_carry_chars",
        F.max(F.col("_base") + F.col("_carry_chars")).over(before).alias("_carry_base"),
    )
    if starts is None:
        carry = carry.withColumns({"_line0": F.lit(0), "_char0": F.lit(0)})
    else:
        first = starts.select("stream_id", F.col("line").alias("_line0"), F.col("character").alias("_char0"))
        carry = carry.join(first, STREAM, "left").fillna(0, ["_line0", "_char0"])

    joined = local.join(carry, ["stream_id", "_block"])
    base = F.coalesce(
        F.max("_at_newline").over(inside.rowsBetween(*scale.UP_TO_HERE)) + F.col("_carry_chars"),
        F.col("_carry_base"),
        -F.col("_char0"),
    )
    base_before = F.coalesce(
        F.max("_at_newline").over(inside.rowsBetween(*scale.BEFORE_HERE)) + F.col("_carry_chars"),
        F.col("_carry_base"),
        -F.col("_char0"),
    )
    line = F.col("_line0") + F.col("_carry_lines") + F.col("_line_sum")
    char_sum = F.col("_carry_chars") + F.col("_char_sum")
    return joined.select(
        "stream_id",
        "seq",
        "text",
        (line - F.col("_lines")).alias("insert_line"),
        (char_sum - F.col("_chars") - base_before).alias("insert_character"),
        line.alias("next_line"),
        (char_sum - base).alias("next_character"),
    )


def line_pieces(chunks: DataFrame, rows_per_block: int = scale.ROWS_PER_BLOCK) -> DataFrame:
    """Chunks cut at their first newline, each piece numbered by the line report it belongs to.

    The head of a chunk with a newline closes a report; its tail, later newlines included, opens the next.
    """
    text = F.col("text")
    has_newline = F.instr(text, "\n") > 0
    counted = scale.running_totals(
        chunks.select("stream_id", "seq", "text"),
        STREAM,
        ["seq"],
        scale.seq_block("seq", rows_per_block),
        {"_newlines": F.when(has_newline, 1).otherwise(0)},
    )

    def piece(report: Column, place: int, value: Column, closed_by: Column) -> Column:
        return F.struct(
            report.alias("report"), F.lit(place).alias("place"), value.alias("piece"), closed_by.alias("closed_by")
        )

    number, open_end = F.col("_newlines"), F.lit(None).cast("bigint")
    first = F.substring_index(text, "\n", 1)
    cut = F.array(
        piece(number - 1, 1, first, F.col("seq").cast("bigint")),
        piece(number, 0, F.substring(text, F.length(first) + 2, F.length(text)), open_end),
    )
    whole = F.array(piece(number, 1, text, open_end))
    return counted.select("stream_id", "seq", F.inline(F.when(has_newline, cut).otherwise(whole)))


def stream_lines(
    chunks: DataFrame,
    prefix: str = "",
    pending: DataFrame | None = None,
    rows_per_block: int = scale.ROWS_PER_BLOCK,
) -> DataFrame:
    """Line reports ``(stream_id, seq, message)`` of the chunks that have a newline.

    A report is the pending text and the chunk up to its first newline, after ``prefix``.
    ``pending(stream_id, seq, place, piece)`` are the pieces that earlier chunks left open.
    """
    return close_reports(open_pieces(chunks, pending, rows_per_block), prefix)


def open_pieces(
    chunks: DataFrame, pending: DataFrame | None = None, rows_per_block: int = scale.ROWS_PER_BLOCK
) -> DataFrame:
    """The pieces of ``line_pieces``, with what earlier chunks left open in front, and ``closed``: whether a report closes.

    The report after the last newline of a stream stays open; its pieces are what the next chunks go on from.
    """
    pieces = line_pieces(chunks, rows_per_block)
    if pending is not None:
        earlier = pending.select(
            "stream_id",
            F.col("seq").cast("bigint").alias("seq"),
            F.lit(0).cast("bigint").alias("report"),
            F.col("place").cast("int").alias("place"),
            "piece",
            F.lit(None).cast("bigint").alias("closed_by"),
        )
        pieces = pieces.unionByName(earlier)
    last = pieces.groupBy("stream_id").agg(
        F.coalesce(F.max(F.when(F.col("closed_by").isNotNull(), F.col("report"))), F.lit(-1)).alias("_last")
    )
    return pieces.join(last, "stream_id").withColumn("closed", F.col("report") <= F.col("_last")).drop("_last")


def pending_text(pieces: DataFrame) -> DataFrame:
    """The open pieces ``(stream_id, seq, place, piece)`` of each stream as one text, ``pending``."""
    block = scale.seq_block("seq", scale.ROWS_PER_TEXT_BLOCK)
    return scale.concat_in_order(pieces, STREAM, ["seq", "place"], "piece", block, result="pending")


def close_reports(pieces: DataFrame, prefix: str = "") -> DataFrame:
    """The closed reports of ``open_pieces``, joined: ``(stream_id, seq, message)``."""
    texts = scale.concat_in_order(
        pieces.where("closed"),
        ["stream_id", "report"],
        ["seq", "place"],
        "piece",
        scale.seq_block("seq", scale.ROWS_PER_TEXT_BLOCK),
        result="message",
        highest="closed_by",
    )
    return texts.select(
        "stream_id", F.col("closed_by").alias("seq"), F.concat(F.lit(prefix), F.col("message")).alias("message")
    )


def stream_line_progress(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """The line report of each chunk that has a newline."""
    return stream_lines(chunks, prefix)
