"""Path, language and fingerprint expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions with a known language.
KNOWN_LANGUAGES = ("go", "py", "ts", "tsx", "jsx", "js")

# Characters that stay as they are in the path of a file URI, which url_encode escapes.
_URI_PATH_PLAIN = {
    "+": "%20",
    "%2F": "/",
    "%7E": "~",
    "%24": "$",
    "%26": "&",
    "%2B": "+",
    "%2C": ",",
    "%3A": ":",
    "%3B": ";",
    "%3D": "=",
    "%40": "@",
}


def _class_to_regex(body: str, negation: str) -> str:
    negated = body.startswith(negation)
    members = body[1:] if negated else body
    if not members:
        raise ValueError("empty character class in a glob")
    inner = "".join("-" if char == "-" and 0 < at < len(members) - 1 else re.escape(char)
                    for at, char in enumerate(members))
    return f"[{'^' if negated else ''}{inner}]"


def _translate(pattern: str, any_char: str, negation: str, alternatives: bool) -> str:
    out, depth, at = [], 0, 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif char == "*":
            out.append(any_char + "*")
        elif char == "?":
            out.append(any_char)
        elif char == "[":
            close = pattern.find("]", at + 2)
            if close < 0:
                raise ValueError(f"unclosed character class in glob {pattern!r}")
            out.append(_class_to_regex(pattern[at + 1 : close], negation))
            at = close
        elif char == "{" and alternatives:
            depth += 1
            out.append("(?:")
        elif char == "," and depth:
            out.append("|")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append(re.escape(char))
        at += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {pattern!r}")
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """Regex for an exclude glob: ``*`` and ``?`` match any character, ``/`` included; ``[!a]``, ``{a,b}``."""
    return _translate(pattern, ".", "!", alternatives=True)


def name_glob_to_regex(pattern: str) -> str:
    """Regex for one name of an include glob: ``*`` and ``?`` stop at ``/``; ``[^a]``, no alternatives."""
    return _translate(pattern, "[^/]", "^", alternatives=False)


def matches_any_glob(path: Column, patterns: list[str]) -> Column:
    """True where the whole path matches one of the patterns; one regex over all of them."""
    if not patterns:
        return F.lit(False)
    return path.rlike(r"(?s)\A(?:" + "|".join(glob_to_regex(p) for p in patterns) + r")\z")


def relative_path(path: Column, root: str) -> Column:
    """Path below the workspace root; NULL where the path lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, F.length(path)))


def base_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def detect_language(path: Column) -> Column:
    """The last extension without its dot; empty where there is none."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def is_known_language(language: Column) -> Column:
    return language.isin(*KNOWN_LANGUAGES)


def walk_order(path: Column) -> Column:
    """A key that sorts paths as a directory walk visits them: name by name, not character by character."""
    return F.replace(path, F.lit("/"), F.lit("\u0001"))


def file_uri(path: Column, root: str = "") -> Column:
    """``file://`` URI of a path below ``root``, percent-encoded like a URL path."""
    absolute = F.concat(F.lit(root.rstrip("/") + "/"), path)
    encoded = F.replace(F.url_encode(absolute), F.lit("*"), F.lit("%2A"))
    for escaped, plain in _URI_PATH_PLAIN.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return F.concat(F.lit("file://"), encoded)


def content_fingerprint(content: Column) -> Column:
    return F.md5(content)


def file_id(workspace: Column, path: Column) -> Column:
    """A 128-bit id: two of a hundred billion paths still do not meet."""
    return F.md5(F.concat_ws("\n", workspace, path))


def symbol_id(workspace: Column, path: Column, symbol_no: Column) -> Column:
    return F.concat_ws(":", file_id(workspace, path), symbol_no.cast("string"))
