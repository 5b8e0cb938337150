"""Editor messages ``(seq, method, params)``: decoding, fingerprints, one-way messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom import schemas

# The handled methods, and what each does.
OPEN = "textDocument/didOpen"
CLOSE = "textDocument/didClose"
CHANGE = "textDocument/didChange"
HANDLED_METHODS = {
    OPEN: "open",
    CLOSE: "close",
    CHANGE: "change",
    "workspace/symbol": "symbol",
    "textDocument/codeAction": "action",
    "workspace/executeCommand": "command",
}

# Methods of messages that expect no reply.
NOTIFICATION_METHODS = [
    "initialized",
    "exit",
    "window/workDoneProgress/cancel",
    "$/logTrace",
    "$/setTrace",
    "textDocument/didChange",
    "workspace/didChangeConfiguration",
    "workspace/didChangeWatchedFiles",
    "workspace/didChangeWorkspaceFolders",
    "textDocument/didClose",
    "textDocument/didOpen",
    "textDocument/didSave",
    "textDocument/willSave",
    "workspace/didCreateFiles",
    "workspace/didRenameFiles",
    "workspace/didDeleteFiles",
]


def _edit(change: Column) -> Column:
    start, end = change["range"]["start"], change["range"]["end"]
    return F.struct(
        start["line"].alias("sl"),
        start["character"].alias("sc"),
        end["line"].alias("el"),
        end["character"].alias("ec"),
        change["text"].alias("text"),
    ).cast(schemas.EDIT)


def parse_event_json(events: DataFrame) -> DataFrame:
    """Typed fields of each message by its method.

    Bad JSON in a handled message gives an error and NULL fields; other methods pass without fields.
    """
    action = F.create_map(*[F.lit(x) for pair in HANDLED_METHODS.items() for x in pair])[F.col("method")]
    parsed = events.withColumn("event", action).withColumn(
        "_p",
        F.when(
            F.col("event").isNotNull(),
            F.from_json("params", schemas.EVENT_PARAMS, {"columnNameOfCorruptRecord": "_corrupt"}),
        ),
    )
    bad = F.col("event").isNotNull() & (F.col("_p").isNull() | F.col("_p._corrupt").isNotNull())
    field = lambda name: F.when(~bad, F.col(f"_p.{name}"))
    document, place = field("textDocument"), field("range")
    return parsed.select(
        *events.columns,
        "event",
        document["uri"].alias("uri"),
        document["languageId"].alias("language_id"),
        document["version"].alias("version"),
        document["text"].alias("text"),
        F.transform(field("contentChanges"), _edit).alias("changes"),
        field("query").alias("query"),
        place["start"]["line"].alias("sl"),
        place["start"]["character"].alias("sc"),
        place["end"]["line"].alias("el"),
        place["end"]["character"].alias("ec"),
        field("command").alias("command"),
        field("arguments").alias("arguments"),
        F.when(bad, "bad params").alias("error"),
    )


def event_fingerprint(events: DataFrame, arrival: str = "ts") -> DataFrame:
    """SHA-1 of the raw params, and the arrival time in nanoseconds."""
    return events.withColumns(
        {
            "request_hash": F.sha1(F.col("params")),
            "request_timestamp": F.unix_micros(F.col(arrival)) * F.lit(1000),
        }
    )


def is_notification(method: Column) -> Column:
    return method.isin(*NOTIFICATION_METHODS)


def notification_filter(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One-way messages, and messages that expect a reply."""
    return events.where(is_notification(F.col("method"))), events.where(~is_notification(F.col("method")))
