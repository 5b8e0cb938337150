"""Fixed schemas. Positions are 0-based, range ends are exclusive."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_BYTES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.BinaryType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

DIR_ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
    ]
)

EDIT = T.StructType(
    [
        T.StructField("sl", T.IntegerType()),
        T.StructField("sc", T.IntegerType()),
        T.StructField("el", T.IntegerType()),
        T.StructField("ec", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

_POSITION = T.StructType(
    [T.StructField("line", T.IntegerType()), T.StructField("character", T.IntegerType())]
)
_RANGE = T.StructType([T.StructField("start", _POSITION), T.StructField("end", _POSITION)])

# One schema for the params of every handled method; fields of other methods stay NULL.
EVENT_PARAMS = T.StructType(
    [
        T.StructField(
            "textDocument",
            T.StructType(
                [
                    T.StructField("uri", T.StringType()),
                    T.StructField("languageId", T.StringType()),
                    T.StructField("version", T.IntegerType()),
                    T.StructField("text", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "contentChanges",
            T.ArrayType(
                T.StructType([T.StructField("range", _RANGE), T.StructField("text", T.StringType())])
            ),
        ),
        T.StructField("query", T.StringType()),
        T.StructField("range", _RANGE),
        T.StructField("command", T.StringType()),
        T.StructField("arguments", T.ArrayType(T.StringType())),
        T.StructField("_corrupt", T.StringType()),
    ]
)

DOCUMENT_STATE = T.StructType(
    [
        T.StructField("uri", T.StringType(), False),
        T.StructField("is_open", T.BooleanType(), False),
        T.StructField("language_id", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("last_edit", T.TimestampType()),
        T.StructField("last_edited_line", T.IntegerType()),
        T.StructField("last_seq", T.LongType(), False),
    ]
)
