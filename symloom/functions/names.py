"""Symbol kinds, and name matching with ASCII case folding."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind word -> protocol code. Any other word, "type" and "macro" included, is 13.
KIND_CODES = {
    "class": 5,
    "function": 12,
    "method": 6,
    "type": 13,
    "module": 2,
    "interface": 11,
    "enum": 10,
    "macro": 13,
}
OTHER_KIND = 13

# No name holds this character, so it turns the escape of LIKE off.
_NO_ESCAPE = "\u0001"


def map_symbol_kind(word: Column) -> Column:
    code = F.lit(OTHER_KIND)
    for kind, value in KIND_CODES.items():
        if value != OTHER_KIND:
            code = F.when(word == kind, value).otherwise(code)
    return code


def fold_name(name: Column) -> Column:
    """Lower-case A to Z only; other letters keep their case."""
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def has_prefix(name_fold: Column, prefix: Column | str, corrected: bool = False) -> Column:
    """Prefix match on folded names. ``%`` and ``_`` are wildcards, unless ``corrected``.

    A literal prefix without wildcards reaches the Parquet scan as a StringStartsWith filter.
    """
    folded = F.lit(fold_text(prefix)) if isinstance(prefix, str) else fold_name(prefix)
    if corrected:
        return name_fold.startswith(folded)
    pattern = F.lit(fold_text(prefix) + "%") if isinstance(prefix, str) else F.concat(folded, F.lit("%"))
    return F.like(name_fold, pattern, F.lit(_NO_ESCAPE))


def literal_start(prefix: Column, corrected: bool = False) -> Column:
    """The characters of a prefix that every match must start with."""
    folded = fold_name(prefix)
    return folded if corrected else F.regexp_extract(folded, r"(?s)^[^%_]*", 0)
