"""Context specs to tagged context text, and the prompt around a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import names
from symloom.functions import specs as sp
from symloom.functions import text as tx
from symloom.operators.scale import TEXTS_PER_SALT, concat_in_order, join_unique
from symloom.operators.search import SYMBOL_ORDER, prefix_matches, prefix_search_many

# Fixed value: the instruction block of the prompt.
SYSTEM_PROMPT = """<SystemPrompt>
A user's prompt, in the form of a question, or a description code to write, is shown below. Satisfy the user's prompt or question to the best of your ability. If asked to complete code, DO NOT type out any extra text, or backticks since your response will be appended to the end of the CurrentFile. DO NOT regurgitate the whole file. Simply return the new code, or the modified code.
</SystemPrompt>
"""  # noqa: E501

# Items hold file texts, so only a few are joined at a time.
ITEMS_PER_BLOCK = 16

ERROR_NO_FILE = "file not found"
ERROR_NO_SYMBOL = "symbol not found"
ERROR_OUTSIDE = "range outside the file"


def parse_context_specs(specs: DataFrame) -> DataFrame:
    """One row per item of ``specs(spec_id, spec)``; a spec with a bad line gives one error row instead.

    A spec is read inside its own row: its first error is known without grouping.
    """
    lines = F.filter(
        F.transform(
            sp.spec_lines(F.col("spec")),
            lambda line, number: F.struct(
                number.alias("line_no"),
                line.alias("line"),
                sp.tokenize_spec_line(line).alias("parts"),
            ),
        ),
        lambda entry: entry["line"] != "",
    )
    read = specs.withColumn("_lines", lines).withColumn(
        "error",
        F.get(
            F.filter(
                F.transform("_lines", lambda entry: sp.spec_line_error(entry["parts"])),
                lambda message: message.isNotNull(),
            ),
            F.lit(0),
        ),
    )
    keep = [c for c in specs.columns if c != "spec"]
    good = F.when(F.col("error").isNull(), F.col("_lines"))
    # A spec with an error, or without items, keeps one row when there is something to report.
    per_line = read.select(*keep, "error", F.explode_outer(good).alias("_line")).select(
        *keep, "error", F.col("_line.line_no").alias("line_no"), F.col("_line.parts").alias("_parts")
    )
    per_item = per_line.select(
        *keep, "error", "line_no", F.posexplode_outer(sp.spec_line_items(F.col("_parts"))).alias("item_no", "_item")
    ).where(F.col("_item").isNotNull() | F.col("error").isNotNull())
    return per_item.select(*keep, "line_no", "item_no", "_item.*", "error")


def open_document_overlay(files: DataFrame, open_documents: DataFrame) -> DataFrame:
    """Current text of each path: the unsaved text of an open document wins over the stored one.

    The open documents are the small side of both joins; of the files, only keys meet the open documents that
    are no files yet.
    """
    key = ["workspace", "path"]
    opened = open_documents.select(*key, F.col("text").alias("_open_text"))
    stored = files.join(opened, key, "left").withColumns(
        {"is_open": F.col("_open_text").isNotNull(), "text": F.coalesce("_open_text", "text")}
    ).drop("_open_text")
    new = opened.join(files.select(*key), key, "left_anti").select(
        *key, F.col("_open_text").alias("text"), F.col("_open_text").isNotNull().alias("is_open")
    )
    return stored.unionByName(new, allowMissingColumns=True)


# Lengths of the path ends that join wanted files to symbols; a wanted file uses the longest that its name fills.
TAILS = [1, 2, 4, 8, 16, 24, 32, 48, 64]


def _symbols_of_files(symbols: DataFrame, asked: DataFrame, absolute: Column) -> DataFrame:
    """Symbols of the files whose path ends with each ``asked`` filename, by an equi-join on the end of the path."""
    sizes = F.array(*[F.lit(size) for size in TAILS])
    size = F.array_max(F.filter(sizes, lambda size: size <= F.length("filename")))
    tailed = asked.withColumn("_size", size).withColumn("_tail", F.right("filename", F.col("_size")))
    # A handful of numbers.
    used = sorted(r[0] for r in tailed.select("_size").distinct().collect() if r[0] is not None)
    lengths = F.array(*[F.lit(size) for size in used or TAILS[:1]])
    fitting = F.filter(lengths, lambda size: size <= F.length(absolute))
    tails = F.transform(fitting, lambda size: F.right(absolute, size))
    return (
        symbols.withColumn("_tail", F.explode(tails))
        .join(tailed.drop("_size"), ["workspace", "_tail"])
        .where(absolute.endswith(F.col("filename")))
        .drop("_tail")
    )


def find_symbol_in_file(
    symbols: DataFrame, wanted: DataFrame, root: str = "", corrected: bool = False, limit: int | None = None
) -> DataFrame:
    """Range of the first prefix hit whose path ends with the filename, per ``(filename, identifier)``.

    All hits are tried, and a name meets the symbols of its own files only; with a ``limit``, that many
    first hits of an identifier in the workspace are looked through, as a search page would give them.
    """
    keys = ["workspace", "filename", "identifier"]
    asked = wanted.select(*keys).distinct()
    absolute = F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))
    matches = names.has_prefix(F.col("name_fold"), F.col("identifier"), corrected)
    if limit is None:
        hits = _symbols_of_files(symbols, asked.where("filename <> ''"), absolute).where(matches)
        # Every path ends with the empty name: those look by identifier.
        anywhere = asked.where("filename = ''").withColumn("query", F.col("identifier"))
        columns = [*keys, *SYMBOL_ORDER, "end_line", "end_col"]
        hits = hits.select(*columns).unionByName(prefix_matches(symbols, anywhere, corrected).select(*columns))
    else:
        queries = asked.select(
            "workspace", F.col("identifier").alias("query_id"), F.col("identifier").alias("query")
        ).distinct()
        first_hits = prefix_search_many(symbols, queries, limit, corrected).withColumn("identifier", F.col("query_id"))
        hits = asked.join(first_hits, ["workspace", "identifier"]).where(absolute.endswith(F.col("filename")))
    return (
        hits.groupBy(*keys)
        .agg(
            F.min_by(
                F.struct("start_line", "start_col", "end_line", "end_col"), F.struct(*SYMBOL_ORDER)
            ).alias("_place")
        )
        .select(*keys, "_place.*")
    )


def _with_text(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Add the current text of the file each item names; other files' texts leave before the shuffle."""
    named = texts.select("workspace", F.col("path").alias("filename"), "text").join(
        items.select("workspace", "filename").distinct(), ["workspace", "filename"], "left_semi"
    )
    return items.join(named, ["workspace", "filename"], "left")


def _symbol_text(corrected: bool) -> Column:
    return tx.slice_text_range(
        F.col("text"), F.col("start_line"), F.col("start_col"), F.col("end_line"), F.col("end_col"),
        corrected=corrected,
    )


def lookup_symbol_text(
    symbols: DataFrame, wanted: DataFrame, texts: DataFrame, root: str = "", corrected: bool = False
) -> DataFrame:
    """Text of the symbol each ``wanted(workspace, filename, identifier)`` names, or an error.

    The text is cut from the file of exactly that name, though the symbol may lie in a file whose path
    only ends with it.
    """
    items = wanted.withColumns(
        {
            "type": F.lit("symbol"),
            "range_start": F.lit(None).cast("bigint"),
            "range_end": F.lit(None).cast("bigint"),
            "error": F.lit(None).cast("string"),
        }
    )
    found = fetch_context_items(items, symbols, texts, root, corrected)
    return found.select("workspace", "filename", "identifier", "content", "error")


def fetch_context_items(
    items: DataFrame, symbols: DataFrame, texts: DataFrame, root: str = "", corrected: bool = False
) -> DataFrame:
    """Content of each parsed item: a file, some of its lines, or one of its symbols; else an error.

    ``items`` needs a workspace column. Symbols are looked up once per file and name; then one join with
    the texts serves all items.
    """
    named = items.where((F.col("type") == "symbol") & F.col("error").isNull())
    places = find_symbol_in_file(symbols, named, root, corrected)
    placed = items.join(places, ["workspace", "filename", "identifier"], "left")
    is_symbol = F.col("type") == "symbol"
    lines = tx.slice_line_range(F.col("text"), F.col("range_start"), F.col("range_end"), corrected)
    content = (
        F.when(F.col("type") == "file", F.col("text"))
        .when(is_symbol, _symbol_text(corrected))
        .otherwise(lines)
    )
    error = F.coalesce(
        "error",
        F.when(is_symbol & F.col("start_line").isNull(), ERROR_NO_SYMBOL)
        .when(F.col("text").isNull(), ERROR_NO_FILE)
        .when(F.col("content").isNull(), ERROR_OUTSIDE),
    )
    fetched = _with_text(placed, texts).withColumn("content", content).withColumn("error", error)
    return fetched.select(*[c for c in items.columns if c != "error"], "content", "error")


def render_context_item(kind, filename, identifier, content):
    """``<Tag``, its attributes, ``>``, the content and ``</Tag>``, each on lines of their own."""
    tag = F.when(kind == "file", "File").when(kind == "range", "FileRange").otherwise("FileSymbol")
    attribute = F.when(kind == "file", "").otherwise(
        F.concat(F.when(kind == "range", "range").otherwise("symbol"), F.lit('="'), identifier, F.lit('"\n'))
    )
    return F.concat(
        F.lit("<"), tag, F.lit('\nfile="'), filename, F.lit('"\n'), attribute, F.lit(">\n"),
        content, F.lit("\n</"), tag, F.lit(">\n"),
    )


def build_context(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rendered items of each spec in order, one whole context per spec; any failing item fails the whole spec."""
    rendered = items.withColumn(
        "_text",
        render_context_item(F.col("type"), F.col("filename"), F.col("identifier"), F.col("content")),
    )
    block = F.struct("line_no", F.floor(F.col("item_no") / ITEMS_PER_BLOCK))
    return concat_in_order(
        rendered, keys, ["line_no", "item_no"], "_text", block, result="context", error="error"
    )


def selection_prompt(
    selections: DataFrame, open_documents: DataFrame, contexts: DataFrame, corrected: bool = False
) -> DataFrame:
    """The prompt for ``selections(workspace, path, sl, sc, el, ec)``; NULL and an error where it fails.

    ``contexts(workspace, context, error)`` holds one context per workspace. The text before the end line
    shows the start line already cut, and on one line the end column counts after that cut; ``corrected``
    shows the line whole and counts columns as selected. Documents meet the context of their workspace in shares of
    ``TEXTS_PER_SALT``, whole texts until then.
    """
    sl, sc, el, ec = (F.col(c) for c in ("sl", "sc", "el", "ec"))
    opened = open_documents.select("workspace", "path", F.col("text").alias("_text"))
    context = contexts.select("workspace", "context", F.col("error").alias("_context_error"))
    joined = selections.join(opened, ["workspace", "path"], "left")
    joined = join_unique(
        joined, context, ["workspace"], salt_by=selections.columns, counted=selections, rows_per_salt=TEXTS_PER_SALT
    )
    lines = F.concat(tx.split_lines(F.col("_text")), F.array(F.lit("")))
    joined = joined.withColumn("_lines", lines).drop("_text")

    first, last = F.get("_lines", sl), F.get("_lines", el)
    cut_first = tx.tail(first, sc)
    one_line = sl == el
    on_last = F.when(one_line, cut_first).otherwise(last)
    fits = (sl <= el) & (sc <= F.length(first))
    if corrected:
        fits &= (ec <= F.length(last)) & (~one_line | (sc <= ec))
        selected_one = F.substring(first, sc + 1, ec - sc)
        before = F.slice("_lines", F.lit(1), el)
    else:
        fits &= ec <= F.length(on_last)
        selected_one = tx.head(cut_first, ec)
        trimmed = F.concat(
            F.slice("_lines", F.lit(1), sl), F.array(cut_first), F.slice("_lines", sl + 2, F.greatest(el - sl - 1, F.lit(0)))
        )
        before = F.when(one_line, F.slice("_lines", F.lit(1), el)).otherwise(trimmed)
    selected_more = F.concat(
        F.array(cut_first),
        F.slice("_lines", sl + 2, F.greatest(el - sl - 1, F.lit(0))),
        F.array(tx.head(last, ec)),
    )
    selected = F.when(one_line, selected_one).otherwise(F.array_join(selected_more, "\n"))
    prompt = F.concat(
        F.coalesce("context", F.lit("")),
        F.lit('<CurrentFile path="'), F.col("path"), F.lit('">\n'),
        F.array_join(before, "\n"),
        F.lit("\n</CurrentFile>\n"),
        F.lit(SYSTEM_PROMPT),
        F.lit("<UserPrompt>\n"), selected, F.lit("\n</UserPrompt>\n"),
    )
    error = (
        F.when(F.col("_lines").isNull(), "document not open")
        .when(F.col("_context_error").isNotNull(), F.col("_context_error"))
        .when(~F.coalesce(fits, F.lit(False)), ERROR_OUTSIDE)
    )
    return joined.select(
        *selections.columns, F.when(error.isNull(), prompt).alias("prompt"), error.alias("error")
    )
