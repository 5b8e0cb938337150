"""Model-output chunks as they come: cursor, line reports and full text per stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from symloom.operators.chunks import pending_text, stream_full_text
from symloom.streaming.runner import KeyedStream

CURSOR = "line bigint, character bigint, last_seq bigint, is_done boolean"
PIECE = "seq bigint, place int, piece string"
EDIT_COLUMNS = ["stream_id", "seq", "text", "insert_line", "insert_character", "next_line", "next_character"]
# One output for all that the processor gives; ``kind`` is a folder of the sink.
OUTPUT = (
    "stream_id bigint, seq bigint, text string, done boolean, insert_line bigint, insert_character bigint, "
    "next_line bigint, next_character bigint, kind string"
)


def _row(kind: str, stream: int, seq: int, text: str | None, done: bool | None = None, at: tuple = (None,) * 4) -> Row:
    places = dict(zip(EDIT_COLUMNS[3:], at, strict=True))
    return Row(stream_id=stream, seq=seq, text=text, done=done, **places, kind=kind)


class CompletionProcessor(StatefulProcessor):
    """Keeps a stream's cursor as a value and the pieces since its last newline as a list in the state store.

    A batch without a newline appends its pieces and does not read the earlier ones; a newline joins them all.
    """

    def __init__(self, prefix: str, forget_after_ms: int | None):
        self.prefix, self.forget_after_ms = prefix, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", CURSOR)
        self.pieces = handle.getListState("pieces", PIECE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stream = key[0]
        chunks = sorted(rows, key=lambda r: (r["seq"], r["text"] is not None, r["text"] or "", bool(r["done"])))
        line, character, last_seq, is_done = self.cursor.get() if self.cursor.exists() else (0, 0, None, False)
        fresh, cut, changed = [], False, False
        for chunk in chunks:
            seq, text = chunk["seq"], chunk["text"] or ""
            if is_done or (last_seq is not None and seq <= last_seq):
                yield _row("late", stream, seq, chunk["text"], chunk["done"])
                continue
            before = (line, character)
            head, newline, tail = text.partition("\n")
            if newline:
                earlier = [] if cut else [piece for _, _, piece in self.pieces.get()]
                message = "".join([self.prefix, *earlier, *[piece for _, _, piece in fresh], head])
                yield _row("line", stream, seq, message)
                fresh, cut = [(seq, 0, tail)], True
                line, character = line + text.count("\n"), len(text) - text.rindex("\n") - 1
            else:
                fresh.append((seq, 1, text))
                character += len(text)
            yield _row("edit", stream, seq, chunk["text"], chunk["done"], (*before, line, character))
            last_seq, is_done, changed = seq, bool(chunk["done"]), True
        if not changed:
            return
        self.cursor.update((line, character, last_seq, is_done))
        if cut:
            self.pieces.put(fresh)
        else:
            self.pieces.appendList(fresh)
        if is_done and self.forget_after_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.cursor.clear()
        self.pieces.clear()
        return iter(())

    def close(self) -> None:
        pass


class CompletionStream:
    """Consumes ``(stream_id, seq, text, done)``; keeps the cursor and the pending line between batches.

    Late chunks are ignored and reported: those at or below the last applied seq of their stream, those after the
    done flag, in earlier batches or in their own, and repeats of a seq inside a batch, of which the one that
    sorts first by text is applied. With ``forget_after_ms`` a stream that is done leaves the state that long after.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "", forget_after_ms: int | None = None):
        self._stream = KeyedStream(spark, root, "stream_id", OUTPUT)
        self._processor = CompletionProcessor(prefix, forget_after_ms)

    def run(self, chunks: DataFrame) -> None:
        """Take in what is available of a stream of chunks."""
        rows = chunks.where(F.col("seq").isNotNull()).select(
            F.col("stream_id").cast("long"), F.col("seq").cast("long"), "text", "done"
        )
        self._stream.run_rows(rows, self._processor, timers=self._processor.forget_after_ms is not None, by=["kind"])

    def _kind(self, kind: str) -> DataFrame:
        return self._stream.written().where(F.col("kind") == kind)

    def cursors(self) -> DataFrame:
        """``(stream_id, line, character, last_seq, is_done)`` of each stream in the state."""
        return self._stream.variable("cursor", f"stream_id bigint, {CURSOR}")

    def edits(self) -> DataFrame:
        """Each chunk with its insert position, as in ``stream_cursor``."""
        return self._kind("edit").select(*EDIT_COLUMNS)

    def reports(self) -> DataFrame:
        """The line reports of all batches."""
        return self._kind("line").select("stream_id", "seq", F.col("text").alias("message"))

    def pending(self) -> DataFrame:
        """The text since the last newline of each stream that has any: ``(stream_id, pending)``."""
        return pending_text(self._stream.variable("pieces", f"stream_id bigint, {PIECE}"))

    def late(self) -> DataFrame:
        return self._kind("late").select("stream_id", "seq", "text", "done")

    def full_text(self) -> DataFrame:
        """The text of each stream so far; that of a stream that is done is final."""
        return stream_full_text(self.edits().select("stream_id", "seq", "text"))
