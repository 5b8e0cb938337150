"""Expressions that read context specs: tokens of a line, line ranges, items of a whole spec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token: plain characters (a backslash takes the next one as it is) up to a closing quote,
# or up to a space. Possessive runs keep the match linear in the line length.
_PLAIN = r'(?:[^\\" ]++|\\.)'
_QUOTED = r'"(?:[^\\"]++|\\.)*+"'
TOKEN = rf"(?s)(?:{_PLAIN}*+{_QUOTED}|{_PLAIN}++)"
_QUOTE_OR_ESCAPE = r'(?s)\\(.)|"'

ERROR_QUOTE = "unclosed quote"
ERROR_BLANK = "blank line"
ERROR_RANGE = "bad range"

ITEM = (
    "struct<parts:array<string>,type:string,filename:string,identifier:string,"
    "range_start:bigint,range_end:bigint>"
)


def tokenize_spec_line(line: Column) -> Column:
    """Tokens of a line split on spaces; quotes and backslashes are honoured. NULL on an unclosed quote."""
    raw = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    rest = F.regexp_replace(line, TOKEN, "")
    tokens = F.transform(raw, lambda token: F.regexp_replace(token, _QUOTE_OR_ESCAPE, "$1"))
    return F.when(~rest.contains('"'), tokens)


def parse_line_range(text: Column) -> Column:
    """``a:b`` as ``struct<range_start, range_end>``; NULL unless both are integers and a <= b."""
    parts = F.split(text, ":", -1)
    start = F.get(parts, F.lit(0)).try_cast("bigint")
    end = F.get(parts, F.lit(1)).try_cast("bigint")
    numeric = text.rlike(r"\A[+-]?[0-9]+:[+-]?[0-9]+\z")
    return F.when(
        numeric & (start <= end), F.struct(start.alias("range_start"), end.alias("range_end"))
    )


def _item(parts: Column, kind: Column, identifier: Column, line_range: Column | None) -> Column:
    no_number = F.lit(None).cast("bigint")
    return F.struct(
        parts.alias("parts"),
        kind.alias("type"),
        F.get(parts, F.lit(0)).alias("filename"),
        identifier.alias("identifier"),
        (no_number if line_range is None else line_range["range_start"]).alias("range_start"),
        (no_number if line_range is None else line_range["range_end"]).alias("range_end"),
    ).cast(ITEM)


def _token_item(parts: Column, token: Column) -> Column:
    line_range = parse_line_range(token)
    shown = F.concat_ws(":", line_range["range_start"], line_range["range_end"])
    return F.when(
        token.contains(":"), _item(parts, F.lit("range"), shown, line_range)
    ).otherwise(_item(parts, F.lit("symbol"), token, None))


def spec_line_items(parts: Column) -> Column:
    """Items of a tokenised line: the file itself, or one item per further token."""
    whole_file = F.array(_item(parts, F.lit("file"), F.lit(""), None))
    further = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)), lambda token: _token_item(parts, token)
    )
    return F.when(F.size(parts) == 1, whole_file).otherwise(further)


def spec_line_error(parts: Column) -> Column:
    bad_range = F.exists(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda token: token.contains(":") & parse_line_range(token).isNull(),
    )
    return (
        F.when(parts.isNull(), ERROR_QUOTE)
        .when(F.size(parts) == 0, ERROR_BLANK)
        .when(bad_range, ERROR_RANGE)
    )


def spec_lines(spec: Column) -> Column:
    """Lines of a spec without a trailing carriage return."""
    return F.transform(F.split(spec, "\n", -1), lambda line: F.regexp_replace(line, r"\r\z", ""))
