"""Text slices, offsets and edits as column expressions.

``unit="char"`` counts code points, ``unit="byte"`` counts UTF-8 bytes. What the model defines as a
crash (an index out of bounds) is NULL here. ``corrected=True`` gives the evidently intended result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT_STATE = "struct<lines:array<string>,error:string>"


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _with_lines(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` over the lines of a text, which is split once however often they are used."""
    return F.element_at(F.transform(F.array(split_lines(text)), use), 1)


def length_in(text: Column, unit: str) -> Column:
    return F.octet_length(text) if unit == "byte" else F.length(text)


def _cut(text: Column, start, size, unit: str) -> Column:
    if unit == "byte":
        return F.substring(text.cast("binary"), start, size).cast("string")
    return F.substring(text, start, size)


def head(text: Column, count, unit: str = "char") -> Column:
    return _cut(text, F.lit(1), _column(count), unit)


def tail(text: Column, start, unit: str = "char") -> Column:
    return _cut(text, _column(start) + 1, length_in(text, unit), unit)


def slice_lines(lines: Column, sl, sc, el, ec, unit: str = "char", corrected: bool = False) -> Column:
    """Text between two positions of a line array; NULL when a position lies outside the text.

    A range inside one line gives its tail and its head as two lines, unless ``corrected``.
    """
    sl, sc, el, ec = (_column(c) for c in (sl, sc, el, ec))
    first, last = F.get(lines, sl), F.get(lines, el)
    inside = (sc <= length_in(first, unit)) & (ec <= length_in(last, unit))
    middle = F.slice(lines, sl + 2, F.greatest(el - sl - 1, F.lit(0)))
    pieces = F.concat(F.array(tail(first, sc, unit)), middle, F.array(head(last, ec, unit)))
    sliced = F.array_join(pieces, "\n")
    if corrected:
        one_line = _cut(first, sc + 1, F.greatest(ec - sc, F.lit(0)), unit)
        sliced = F.when(sl == el, one_line).otherwise(sliced)
    return F.when(inside, sliced)


def slice_text_range(text: Column, sl, sc, el, ec, unit: str = "char", corrected: bool = False) -> Column:
    return _with_lines(text, lambda lines: slice_lines(lines, sl, sc, el, ec, unit, corrected))


def slice_line_range(text: Column, start, end, corrected: bool = False) -> Column:
    """Lines ``start..end``, 1-based and inclusive; NULL when the range lies outside the text.

    An end at or past the line count loses the last line, unless ``corrected``.
    """
    first, end = F.greatest(_column(start) - 1, F.lit(0)), _column(end)

    def cut(lines: Column) -> Column:
        count = F.size(lines)
        last = F.when(end >= count, count if corrected else count - 1).otherwise(end)
        size = F.greatest(last - first, F.lit(0))
        wanted = F.array_join(F.slice(lines, (first + 1).cast("int"), size.cast("int")), "\n")
        return F.when((first < count) & (first <= last), wanted)

    return _with_lines(text, cut)


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def text_end_offset(text: Column, unit: str = "char") -> Column:
    """How far a text moves a cursor: newlines, and the length after the last of them."""
    return F.struct(
        count_newlines(text).alias("line"),
        length_in(F.substring_index(text, "\n", -1), unit).alias("character"),
    )


def _apply_edit(state: Column, edit: Column, unit: str, corrected: bool) -> Column:
    lines = state["lines"]
    count = F.size(lines)
    whole = edit["sl"].isNull()
    sl, el = F.coalesce(edit["sl"], F.lit(0)), F.coalesce(edit["el"], F.lit(0))
    first, last = F.get(lines, sl), F.get(lines, el)
    sc = F.least(F.coalesce(edit["sc"], F.lit(0)), length_in(first, unit))
    ec = F.coalesce(edit["ec"], F.lit(0))
    if corrected:
        ec = F.least(ec, length_in(last, unit))
    text = F.coalesce(edit["text"], F.lit(""))

    before = F.concat(head(first, sc, unit), text)
    after = tail(last, ec, unit)
    pieces = split_lines(before)
    closed = F.concat(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.array(F.concat(F.element_at(pieces, -1), after)),
    )
    if not corrected:
        # An edit inside one line is not split again, even when its text holds newlines.
        closed = F.when(sl == el, F.array(F.concat(before, after))).otherwise(closed)
    replaced = F.concat(F.slice(lines, F.lit(1), sl), closed, F.slice(lines, el + 2, count))
    if corrected:
        replaced = F.when(whole, split_lines(text)).otherwise(replaced)

    outside = (sl >= count) | (el >= count)
    past_line = ec > length_in(last, unit)
    error = (
        F.when(state["error"].isNotNull(), state["error"])
        .when(outside, F.lit("line out of bounds"))
        .when(past_line, F.lit("column out of bounds"))
    )
    return F.struct(
        F.when(error.isNull(), replaced).otherwise(lines).alias("lines"), error.alias("error")
    )


def apply_text_edits(text: Column, edits: Column, unit: str = "char", corrected: bool = False) -> Column:
    """Apply an ordered batch of ranged edits; ``struct<text, error>`` with NULL text on an error."""
    start = F.struct(split_lines(text).alias("lines"), F.lit(None).cast("string").alias("error"))
    return F.aggregate(
        edits,
        start.cast(EDIT_STATE),
        lambda state, edit: _apply_edit(state, edit, unit, corrected).cast(EDIT_STATE),
        lambda state: F.struct(
            F.when(state["error"].isNull(), F.array_join(state["lines"], "\n")).alias("text"),
            state["error"].alias("error"),
        ),
    )


def symbol_embedding_text(symbol_text: Column) -> Column:
    return F.concat(F.lit("\n"), symbol_text)


def definition_uid(path: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    return F.format_string("%s %d:%d-%d:%d", path, sl, sc, el, ec)


def definition_place(uid: Column) -> Column:
    """The path and the range in a ``definition_uid``: a path may hold blanks, a range holds none."""
    place = F.substring_index(uid, " ", -1)
    number = lambda k: F.get(F.split(place, "[:-]"), F.lit(k)).try_cast("int")
    return F.struct(
        F.left(uid, F.length(uid) - F.length(place) - 1).alias("path"),
        *[number(k).alias(name) for k, name in enumerate(["start_line", "start_col", "end_line", "end_col"])],
    )
