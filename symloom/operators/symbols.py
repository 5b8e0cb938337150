"""Extraction of definitions and references from file texts, and the symbol table built from them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import names, paths
from symloom.functions import text as tx


@dataclass(frozen=True)
class Rule:
    """A line pattern of some languages. Group 1 is the name; the pattern is anchored at the line start."""

    languages: tuple[str, ...]
    kind: str
    pattern: str


_SCRIPT = ("ts", "tsx", "jsx", "js")
_EXPORT = r"^(?:export\s+)?(?:default\s+)?"

DEFINITION_RULES = [
    Rule(("go",), "method", r"^func\s+\([^)]*\)\s*(\w+)"),
    Rule(("go",), "function", r"^func\s+(\w+)"),
    Rule(("go",), "interface", r"^type\s+(\w+)\s+interface\b"),
    Rule(("go",), "type", r"^type\s+(\w+)"),
    Rule(("py",), "function", r"^(?:async\s+)?def\s+(\w+)"),
    Rule(("py",), "class", r"^class\s+(\w+)"),
    Rule(_SCRIPT, "function", _EXPORT + r"(?:async\s+)?function\s*\*?\s*(\w+)"),
    Rule(_SCRIPT, "class", _EXPORT + r"(?:abstract\s+)?class\s+(\w+)"),
    Rule(_SCRIPT, "interface", _EXPORT + r"interface\s+(\w+)"),
    Rule(_SCRIPT, "enum", _EXPORT + r"(?:const\s+)?enum\s+(\w+)"),
    Rule(_SCRIPT, "module", _EXPORT + r"(?:namespace|module)\s+(\w+)"),
    Rule(_SCRIPT, "type", _EXPORT + r"type\s+(\w+)"),
]

# Group 1 is the captured node.
REFERENCE_RULES = [
    Rule(("go",), "field_identifier", r"\.(\w+)"),
    Rule(("go",), "identifier", r"(?<![\w.])(?<!func )(?<!\) )(\w+)\("),
    Rule(("go",), "type_identifier", r"\w\.(\w+)\{"),
]

_FOUND = "struct<line:int,hit:struct<name:string,kind_word:string>>"


def _first_rule(line: Column, rules: list[Rule]) -> Column:
    found = F.lit(None).cast("struct<name:string,kind_word:string>")
    for rule in reversed(rules):
        hit = F.struct(
            F.regexp_extract(line, rule.pattern, 1).alias("name"), F.lit(rule.kind).alias("kind_word")
        )
        found = F.when(line.rlike(rule.pattern), hit).otherwise(found)
    return found


def _definitions_of(lines: Column, rules: list[Rule]) -> Column:
    located = F.transform(
        lines, lambda line, number: F.struct(number.alias("line"), _first_rule(line, rules).alias("hit"))
    )
    return F.filter(located, lambda found: found["hit"].isNotNull()).cast(f"array<{_FOUND}>")


def _definitions(lines: Column, language: Column, rules: list[Rule]) -> Column:
    """Definitions of a line array, by the rules of its language; empty for a language without rules."""
    result = F.array().cast(f"array<{_FOUND}>")
    groups: dict[tuple[Rule, ...], list[str]] = {}
    for one in dict.fromkeys(name for rule in rules for name in rule.languages):
        groups.setdefault(tuple(rule for rule in rules if one in rule.languages), []).append(one)
    for of_language, languages in groups.items():
        found = _definitions_of(lines, list(of_language))
        result = F.when(language.isin(*languages), found).otherwise(result)
    return result


def supported_language_filter(files: DataFrame, rules: list[Rule] = DEFINITION_RULES) -> DataFrame:
    """Mark files whose language has rules. Every file stays; the others yield no symbols."""
    languages = sorted({name for rule in rules for name in rule.languages})
    return files.withColumn("language", paths.detect_language(F.col("path"))).withColumn(
        "supported", F.col("language").isin(*languages)
    )


def add_text_errors(files: DataFrame) -> DataFrame:
    """Mark files that cannot be read as text: those with a NUL character."""
    return files.withColumn(
        "error", F.when(F.instr(F.col("text"), "\u0000") > 0, F.lit("not a text file"))
    )


def extract_symbols(
    files: DataFrame, rules: list[Rule] = DEFINITION_RULES, with_text: bool = False, corrected: bool = False,
    keep: list[str] = (),
) -> DataFrame:
    """One row per top-level definition of ``files(workspace, path, text)``, with the columns of the file to ``keep``.

    A definition ends where the line before the next definition ends, or at the end of the text. All of
    it happens inside the row of the file: no shuffle, and only the lines array is held.
    """
    readable = F.instr(F.col("text"), "\u0000") == 0
    located = (
        files.where(readable)
        .select("workspace", "path", *keep, tx.split_lines(F.col("text")).alias("_lines"))
        .withColumn("_found", _definitions(F.col("_lines"), paths.detect_language(F.col("path")), rules))
    )
    lines = F.col("_lines")

    def extent(found, number):
        end_line = F.coalesce(F.get(F.col("_found"), number + 1)["line"], F.size(lines)) - 1
        end_col = F.length(F.get(lines, end_line))
        fields = [
            number.alias("symbol_no"),
            names.map_symbol_kind(found["hit"]["kind_word"]).alias("kind"),
            found["hit"]["kind_word"].alias("kind_word"),
            found["hit"]["name"].alias("name"),
            found["line"].alias("start_line"),
            F.lit(0).alias("start_col"),
            end_line.alias("end_line"),
            end_col.alias("end_col"),
        ]
        if with_text:
            cut = tx.slice_lines(lines, found["line"], F.lit(0), end_line, end_col, corrected=corrected)
            fields.append(cut.alias("symbol_text"))
        return F.struct(*fields)

    return located.select("workspace", "path", *keep, F.inline(F.transform("_found", extent)))


def symbol_table(symbols: DataFrame) -> DataFrame:
    """The stored form: ids and the folded name that prefix search filters on."""
    return symbols.select(
        paths.symbol_id(F.col("workspace"), F.col("path"), F.col("symbol_no")).alias("symbol_id"),
        paths.file_id(F.col("workspace"), F.col("path")).alias("file_id"),
        names.fold_name(F.col("name")).alias("name_fold"),
        "*",
    )


def symbol_location_struct(symbols: DataFrame, root: str = "") -> DataFrame:
    """Flat symbol rows as nested records."""
    position = lambda line, column: F.struct(
        F.col(line).alias("line"), F.col(column).alias("character")
    )
    return symbols.withColumn(
        "location",
        F.struct(
            paths.file_uri(F.col("path"), root).alias("uri"),
            F.struct(
                position("start_line", "start_col").alias("start"),
                position("end_line", "end_col").alias("end"),
            ).alias("range"),
        ),
    )


def _group_is_all(pattern: str) -> bool:
    """Whether group 1 spans the whole pattern, so that a match is its capture."""
    depth, at, in_class = 0, 0, False
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 1
        elif in_class:
            in_class = sign != "]"
        elif sign == "[":
            in_class = True
        elif sign in "()":
            depth += 1 if sign == "(" else -1
            if depth == 0:
                return at == len(pattern) - 1
        at += 1
    return False


def _captures(line: Column, number: Column, rule: Rule) -> Column:
    """All captures of a rule in a line, as the regular expression finds them one after the other.

    One pass writes each match between NUL characters, which no readable text has; the lengths of the pieces give the
    places. What stands before the name in a match is a group of its own here, so its length is known, too. Where group 1 is
    the whole pattern, the matches are the names and nothing stands before them.
    """
    lead = re.search(r"(?<!\\)\((?!\?)", rule.pattern).start()
    plain = lead == 0 and _group_is_all(rule.pattern)
    pattern = f"(?U)({rule.pattern[:lead]}){rule.pattern[lead:]}"
    marked = F.regexp_replace(line, pattern, "\0$0\0" if plain else "\0$0\0$1\0$2\0")
    # A lambda holds the pieces, so they are made once however often they are used.
    pieces = F.transform(F.array(F.split(marked, "\0", -1)), lambda parts: _located(parts, number, rule.kind, plain))
    return F.element_at(pieces, 1)


def _located(parts: Column, number: Column, kind: str, plain: bool) -> Column:
    """Captures from the pieces of a line: a gap, a match and, unless plain, what precedes the name in it and the name; a gap ends them."""
    width = 2 if plain else 4
    part = lambda k: F.filter(parts, lambda _, at: at % width == k)
    steps = F.zip_with(
        F.slice(part(0), F.lit(1), F.floor(F.size(parts) / width).cast("int")),
        part(1),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size")),
    )
    state = "struct<at:int,starts:array<int>>"
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")).cast(state),
        lambda sums, step: F.struct(
            (sums["at"] + step["gap"] + step["size"]).alias("at"),
            F.concat(sums["starts"], F.array(sums["at"] + step["gap"])).alias("starts"),
        ).cast(state),
        lambda sums: sums["starts"],
    )
    found = part(1) if plain else part(3)
    columns = starts if plain else F.zip_with(starts, part(2), lambda start, before: start + F.length(before))
    return F.zip_with(
        columns,
        found,
        lambda column, name: F.struct(
            number.alias("line"),
            column.alias("start_col"),
            (column + F.length(name)).alias("end_col"),
            F.lit(kind).alias("node_type"),
            name.alias("content"),
        ),
    )


_CAPTURE = "struct<line:int,start_col:int,end_col:int,node_type:string,content:string>"


def extract_references(files: DataFrame, rules: list[Rule] = REFERENCE_RULES) -> DataFrame:
    """One row per captured node of ``files(workspace, path, text)``, with its line and columns.

    Group 1 of a rule is the node; a pattern matches text and is nowhere empty. All of it happens inside the row of the file.
    """
    language = F.col("_language")
    by_language: dict[tuple[Rule, ...], list[str]] = {}
    for one in dict.fromkeys(name for rule in rules for name in rule.languages):
        by_language.setdefault(tuple(rule for rule in rules if one in rule.languages), []).append(one)
    found = F.array().cast(f"array<{_CAPTURE}>")
    for of_language, languages in by_language.items():

        def captures(line: Column, number: Column, of_language=of_language) -> Column:
            return F.concat(*[_captures(line, number, rule) for rule in of_language]).cast(f"array<{_CAPTURE}>")

        nodes = F.flatten(F.transform(F.col("_lines"), lambda line, number: captures(line, number)))
        found = F.when(language.isin(*languages), nodes).otherwise(found)
    supported = sorted({name for rule in rules for name in rule.languages})
    return (
        files.where(F.instr(F.col("text"), "\u0000") == 0)
        .select("workspace", "path", paths.detect_language(F.col("path")).alias("_language"), tx.split_lines(F.col("text")).alias("_lines"))
        .where(language.isin(*supported))
        .select("workspace", "path", F.inline(found))
    )
