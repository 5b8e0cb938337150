"""Open, change and close events folded into the state of open documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from symloom.operators.events import parse_event_json
from symloom.streaming.edit_fold import Document
from symloom.streaming.runner import KeyedStream

# What is kept of a document, its last applied seq included.
STATE = (
    "is_open boolean, language_id string, version int, text string, last_edit timestamp, last_edited_line int, last_seq bigint"
)
PROBLEMS = "uri string, seq bigint, reason string"
# Events without a uri change no state; they are spread over so many keys, which no uri starts like.
NO_URI, NO_URI_KEYS = "\0", 64

_EVENT_COLUMNS = ["uri", "seq", "event", "language_id", "version", "text", "changes", "ts", "error"]
_FIELDS = [field.split()[0] for field in STATE.split(", ")]


class DocumentProcessor(StatefulProcessor):
    """Applies a document's events of a micro-batch, in seq order, to its value in the state store; gives the problems."""

    def __init__(self, corrected: bool, forget_after_ms: int | None):
        self.corrected, self.forget_after_ms = corrected, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: (r["seq"] is not None, r["seq"] or 0, r["hash"]))
        held = self.document.get() if self.document.exists() else None
        document = Document(None if held is None else dict(zip(_FIELDS, held, strict=True)))
        changed = False
        for event in events:
            if event["error"] is not None:
                reason = event["error"]
            elif event["seq"] is None:
                reason = "no seq"
            elif document.last_seq is not None and event["seq"] <= document.last_seq:
                reason = "late"
            else:
                reason, changed = document.apply(event.asDict(recursive=True), self.corrected), True
            if reason is not None:
                yield Row(uri=event["uri"], seq=event["seq"], reason=reason)
        if changed:
            state = document.state()
            self.document.update(tuple(state[name] for name in _FIELDS))
            self._watch(state["is_open"], timerValues)

    def _watch(self, is_open: bool, timers) -> None:
        if self.forget_after_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not is_open:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.forget_after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.document.clear()
        return iter(())

    def close(self) -> None:
        pass


class DocumentStateStream:
    """Document state, one value per uri in Spark's state store; problems are rows of an output table.

    Events apply in seq order per uri. An event at or below the last applied seq of its uri is late, and so is a
    repeat of a seq inside a batch, of which the one with the lowest hash is applied: a late event changes nothing
    and is reported. A closed document stays as a row that is not open; with ``forget_after_ms`` it is forgotten, with
    the seq that tells late events, by the first batch that runs so long after its close.
    """

    def __init__(self, spark: SparkSession, root: str, corrected: bool = False, forget_after_ms: int | None = None):
        self._stream = KeyedStream(spark, root, "key", PROBLEMS)
        self._processor = DocumentProcessor(corrected, forget_after_ms)

    def run(self, events: DataFrame) -> None:
        """Take in what is available of a stream of ``(seq, method, params, ts)``."""
        parsed = parse_event_json(events).where(F.col("event").isin("open", "close", "change"))
        spread = F.concat(F.lit(NO_URI), F.pmod(F.xxhash64("seq", "params"), F.lit(NO_URI_KEYS)).cast("string"))
        rows = parsed.select(
            F.coalesce("uri", spread).alias("key"), *_EVENT_COLUMNS,
            F.xxhash64("event", "version", "text", "changes", "ts").alias("hash"),
        )
        self._stream.run_rows(rows, self._processor, timers=self._processor.forget_after_ms is not None)

    def documents(self) -> DataFrame:
        """Current state rows; closed documents stay as rows that are not open."""
        return self._stream.variable("document", f"key string, {STATE}").withColumnRenamed("key", "uri")

    def problems(self) -> DataFrame:
        """Late events, events with bad params, and changes that failed, with the reason."""
        return self._stream.written()
