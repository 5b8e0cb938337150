"""The registered queries: each operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import names, paths
from symloom.functions import specs as sp
from symloom.functions import text as tx
from symloom.operators import chunks as ch
from symloom.operators import config as cf
from symloom.operators import context as cx
from symloom.operators import events as ev
from symloom.operators import folders as fo
from symloom.operators import graph as gr
from symloom.operators import index as ix
from symloom.operators import search as se
from symloom.operators import stats as st
from symloom.operators import symbols as sy
from symloom.operators.name_index import NameIndex
from symloom.operators.vectors import VectorIndex
from symloom.plans import inputs as inp
from symloom.session import checkpointed, discard, scratch_dir, stored
from symloom.sources import files as fl
from symloom.sources import tables as tb
from symloom.sources.manifest import Change, ManifestIndex
from symloom.streaming.completions import CompletionStream
from symloom.streaming.documents import DocumentStateStream
from symloom.streaming.refresh import MANIFEST, IndexRefreshStream

PLACE = ["start_line", "start_col", "end_line", "end_col"]
EXCLUDES = ["src1?/*", "*[!0-8].{de,fr}", "src[0-2]/*7*"]
INCLUDES = ["src1*", "src[2-4]/*[02468].en"]
PREFIXES = ["th", "TH", "t_e", "é", "%ou"]
CODE_LANGUAGES = ("de", "en", "fr")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# --- sources and sinks ---------------------------------------------------------------------------


@query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "tree")
    inp.document_tree(spark, sf_dir, root).count()
    return _scanned(fl.scan_files(spark, root), root)


@query
def scan_include_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "tree")
    inp.document_tree(spark, sf_dir, root).count()
    return _scanned(fl.scan_include_roots(spark, root, INCLUDES, ["*.de"]), root)


def _scanned(contents: DataFrame, root: str) -> DataFrame:
    return contents.select(
        paths.relative_path(F.col("path"), root).alias("path"),
        paths.content_fingerprint(F.col("content")).alias("md5"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


@query
def write_file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_dir(spark, "file-table")
    tb.write_file_table(inp.files(spark, sf_dir), target)
    return spark.read.parquet(target).select("file_id", "workspace", "path", "md5")


def _stored_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol table written out and read back, as an index is: for queries that read it several times."""
    target = scratch_dir(spark, "symbol-table")
    tb.write_symbol_table(inp.symbols(spark, sf_dir), target)
    table = spark.read.parquet(target)
    table.stored_path = target
    return table


def _embedded_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols; the first one of a document has the embedding with that document's number."""
    vectors = inp.files(spark, sf_dir).join(
        inp.table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")
    )
    return inp.symbols(spark, sf_dir).join(
        vectors.select("workspace", "path", F.lit(0).alias("symbol_no"), "embedding"),
        ["workspace", "path", "symbol_no"],
        "left",
    )


@query
def write_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, vectors = scratch_dir(spark, "symbol-table"), scratch_dir(spark, "embedding-table")
    tb.write_symbol_table(_embedded_symbols(spark, sf_dir), target, vectors)
    sizes = spark.read.parquet(vectors).select("symbol_id", F.size("embedding").alias("dimensions"))
    return (
        spark.read.parquet(target)
        .join(sizes, "symbol_id", "left")
        .select("symbol_id", "workspace", "path", "kind", "name", *PLACE, "dimensions")
    )


@query
def read_workspace_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_dir(spark, "symbol-table")
    tb.write_symbol_table(inp.symbols(spark, sf_dir), target)
    return tb.read_workspace_index(spark, target, "en").select("symbol_id", "path", "kind", "name", *PLACE)


@query
def parse_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_event_json(inp.mixed_events(spark, sf_dir))
    first = F.get("changes", F.lit(0))
    return parsed.select(
        "seq",
        "event",
        "uri",
        "language_id",
        "version",
        "text",
        F.size("changes").alias("n_changes"),
        first["sl"].alias("first_line"),
        first["text"].alias("first_text"),
        "query",
        "error",
    ).withColumn("n_changes", F.when(F.col("n_changes") >= 0, F.col("n_changes")))


@query
def index_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = sy.symbol_location_struct(inp.symbols(spark, sf_dir), "/repo")
    return tb.index_report_json(inp.files(spark, sf_dir), located).select("path", "report")


@query
def format_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = tb.format_embedding(F.col("embedding"))
    return inp.table(spark, sf_dir, "embeddings").select("vec_id", formatted.alias("f")).select("vec_id", "f.*")


@query
def open_documents_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _document_stream(spark, sf_dir).documents()
    snapshot = tb.open_documents_snapshot(states).select("document.*")
    return snapshot.withColumn("last_edit", F.unix_micros("last_edit"))


@query
def context_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON read back: a row for each document, and for each definition that a document refers to."""
    files = inp.files(spark, sf_dir)
    requests = files.select("workspace", "path", F.lit(0).alias("line"))
    graph = gr.context_graph_json(_code_context(spark, sf_dir, requests), files, requests)
    read = F.from_json(
        "context",
        "captures map<string,array<struct<content:string>>>, definitions map<string,string>, file string, line int",
    )
    nodes = F.col("g.captures")[F.col("uid")]
    return graph.select("path", "uid", read.alias("g")).select(
        "path",
        "g.line",
        F.md5("g.file").alias("file_md5"),
        "uid",
        F.when(F.col("uid").isNotNull(), F.size(nodes)).alias("n_nodes"),
        F.array_max(F.transform(nodes, lambda n: n["content"])).alias("content"),
        F.col("g.definitions")[F.col("uid")].alias("definition"),
    )


# --- filters, predicates, projections ------------------------------------------------------------


@query
def exclude_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.files(spark, sf_dir).where(~paths.matches_any_glob(F.col("path"), EXCLUDES)).select("path")


@query
def relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    absolute = F.concat(F.lit("/repo/"), F.col("workspace"), F.lit("/"), F.col("path"))
    return inp.files(spark, sf_dir).select(
        absolute.alias("path"),
        paths.relative_path(absolute, "/repo").alias("short_path"),
        paths.relative_path(absolute, "/repo/en/").alias("en_path"),
    )


@query
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.files(spark, sf_dir).select("path", "md5")


@query
def event_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ev.event_fingerprint(inp.document_events(spark, sf_dir))
    return events.select("seq", "method", "request_hash", "request_timestamp")


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = inp.files(spark, sf_dir).select("path")
    linked = inp.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    named = inp.table(spark, sf_dir, "part").select(
        F.concat(F.lit("lib.d/"), F.lower("p_brand"), F.lit("."), F.element_at(F.array(*_known()), _turn())).alias("path")
    )
    language = paths.detect_language(F.col("path"))
    return (
        listed.unionByName(linked)
        .unionByName(named)
        .select("path", language.alias("language"), paths.is_known_language(language).alias("known"))
    )


def _known() -> list[Column]:
    return [F.lit(name) for name in paths.KNOWN_LANGUAGES]


def _turn() -> Column:
    return (F.col("p_partkey") % len(paths.KNOWN_LANGUAGES) + 1).cast("int")


@query
def supported_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rules for Spanish: those files stay and have no symbols."""
    rules = [sy.Rule(CODE_LANGUAGES, rule.kind, rule.pattern) for rule in inp.PROSE_RULES]
    files = inp.files(spark, sf_dir)
    marked = sy.supported_language_filter(files, rules)
    counted = ix.symbols_per_file(files, sy.extract_symbols(files, rules))
    return marked.join(counted, ["workspace", "path"]).select("path", "language", "supported", "n_symbols")


@query
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sy.extract_symbols(inp.files(spark, sf_dir), inp.PROSE_RULES)
    return found.select("workspace", "path", "symbol_no", "kind", "name", *PLACE)


@query
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.references(spark, sf_dir)


@query
def map_symbol_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind words: those of symbols, and other words of the tables."""
    words = inp.symbols(spark, sf_dir).select(F.col("kind_word").alias("word"))
    others = inp.table(spark, sf_dir, "events").select(F.col("event_type").alias("word"))
    types = inp.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") > 5000, "type").otherwise("macro").alias("word")
    )
    return (
        words.unionByName(others)
        .unionByName(types)
        .groupBy("word")
        .count()
        .select("word", names.map_symbol_kind(F.col("word")).alias("kind"), F.col("count").alias("n"))
    )


@query
def symbol_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _stored_symbols(spark, sf_dir)
    found = None
    for corrected in (False, True):
        for prefix in PREFIXES:
            hits = se.symbol_prefix_search(symbols, prefix, corrected=corrected).select(
                F.lit(prefix).alias("prefix"), F.lit(corrected).alias("corrected"), "path", "name", "kind", *PLACE
            )
            found = hits if found is None else found.unionByName(hits)
    return found


@query
def name_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark and their first two letters, looked up in a stored name index of 16 parts."""
    index = NameIndex(spark, scratch_dir(spark, "name-index"))
    index.write(_stored_symbols(spark, sf_dir), parts=16)
    words = _search_queries(spark, sf_dir)
    heads = words.select("workspace", F.concat(F.lit("head "), "query_id").alias("query_id"), F.substring("query", 1, 2).alias("query"))
    found = index.search(words.unionByName(heads), corrected=True)
    return found.select("workspace", "query_id", "rank", "symbol_id", "name")


@query
def symbol_location_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = sy.symbol_location_struct(inp.symbols(spark, sf_dir), "/my repo")
    return located.select(
        "name",
        "kind",
        F.col("location.uri").alias("uri"),
        F.col("location.range.start.line").alias("start_line"),
        F.col("location.range.start.character").alias("start_character"),
        F.col("location.range.end.line").alias("end_line"),
        F.col("location.range.end.character").alias("end_character"),
    )


@query
def notification_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_way, two_way = ev.notification_filter(inp.mixed_events(spark, sf_dir))
    return one_way.select("seq", "method", F.lit(True).alias("one_way")).unionByName(
        two_way.select("seq", "method", F.lit(False).alias("one_way"))
    )


# --- joins ---------------------------------------------------------------------------------------


@query
def detect_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = ix.detect_changed_files(inp.files(spark, sf_dir), inp.prior_index(spark, sf_dir))
    return changed.select("workspace", "path", "md5")


@query
def skip_unchanged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = ix.skip_unchanged_files(inp.files(spark, sf_dir), inp.prior_index(spark, sf_dir))
    return same.select("workspace", "path", "md5")


@query
def folder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders of a hundred documents, against the prior index, whose German folders went by other names."""

    def in_folders(before: str):
        folder = F.concat(F.lit(before), (F.floor(F.col("doc_id") / 100)).cast("string"))
        return F.concat_ws("/", F.substring_index("path", "/", 1), folder, F.substring_index("path", "/", -1))

    # Texts are hashed where they are read; only hashes meet the labels.
    stale = F.md5(F.concat(F.col("text"), F.lit("x")))
    hashed = inp.files(spark, sf_dir).select("doc_id", "workspace", "path", "md5", stale.alias("stale"))
    new = hashed.select("workspace", in_folders("").alias("path"), "md5")
    labelled = hashed.join(inp.table(spark, sf_dir, "labels"), "doc_id")
    renamed = F.when(F.col("workspace") == "de", in_folders("was-")).otherwise(in_folders(""))
    old = labelled.select(
        "workspace", renamed.alias("path"), F.when(F.col("quality") == 0, F.col("stale")).otherwise(F.col("md5")).alias("md5")
    )
    return fo.compare_trees(fo.folder_tree(new), fo.folder_tree(old))


def _rows_of_index(files: DataFrame, symbols: DataFrame) -> DataFrame:
    file_rows = files.select(
        F.lit("file").alias("row"), "workspace", "path", F.lit(None).cast("int").alias("symbol_no"),
        F.col("md5").alias("value"),
    )
    symbol_rows = symbols.select(
        F.lit("symbol").alias("row"), "workspace", "path", "symbol_no", F.col("name").alias("value")
    )
    return file_rows.unionByName(symbol_rows)


@query
def delete_file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index without the toxic documents."""
    gone = inp.labelled(spark, sf_dir).where(F.col("toxic") == 1)
    return _rows_of_index(*ix.delete_files(inp.files(spark, sf_dir), inp.symbols(spark, sf_dir), gone))


@query
def replace_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior index is committed, then the files that changed since, with their symbols."""
    index = ManifestIndex(spark, scratch_dir(spark, "published"))
    prior = inp.prior_index(spark, sf_dir)
    index.commit({"files": Change(prior), "symbols": Change(inp.prior_symbols(spark, sf_dir))}, keys=prior)
    changed = checkpointed(ix.detect_changed_files(inp.files(spark, sf_dir), index.table("files")))
    new_symbols = sy.symbol_table(sy.extract_symbols(changed, inp.PROSE_RULES))
    rows = changed.select("workspace", "path", "md5")
    index.commit({"files": Change(rows, changed), "symbols": Change(new_symbols, changed)}, keys=changed)
    return _rows_of_index(index.table("files"), index.table("symbols"))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, asked in every workspace."""
    means = (
        inp.table(spark, sf_dir, "embeddings")
        .select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("at", "value"))
        .groupBy("query_id", "at")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda m: m["mean"]).alias("embedding"))
    )
    return means.withColumn("workspace", F.explode(F.array(*[F.lit(name) for name in inp.PROSE])))


@query
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of ``semantic_symbol_search``, from a stored index that reads the cells it needs."""
    symbols = checkpointed(_embedded_symbols(spark, sf_dir))
    index = VectorIndex(spark, scratch_dir(spark, "vector-index"))
    index.write(symbols.select("workspace", "symbol_id", "embedding"))
    hits = index.nearest(_asked_vectors(spark, sf_dir)).select("workspace", "query_id", "rank", "symbol_id")
    found = symbols.join(hits, ["workspace", "symbol_id"])
    return found.select("workspace", "query_id", "rank", "symbol_id", "path", "name")


@query
def semantic_symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols nearest to the mean vector of each label, in every workspace."""
    symbols = _embedded_symbols(spark, sf_dir)
    embeddings = symbols.where(F.col("embedding").isNotNull()).select("workspace", "symbol_id", "embedding")
    asked = _asked_vectors(spark, sf_dir)
    found = se.semantic_symbol_search(symbols.drop("embedding"), embeddings, asked)
    return found.select("workspace", "query_id", "rank", "symbol_id", "path", "name")


def _search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts whole, and their first words, asked in every workspace."""
    items = inp.table(spark, sf_dir, "benchmark")
    whole = items.select(F.concat(F.lit("text "), "item_id").alias("query_id"), F.col("text").alias("query"))
    word = items.select(
        F.concat(F.lit("word "), "item_id").alias("query_id"), F.substring_index("text", " ", 1).alias("query")
    )
    workspaces = F.array(*[F.lit(name) for name in inp.PROSE])
    return whole.unionByName(word).withColumn("workspace", F.explode(workspaces))


@query
def hybrid_symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, vectors = scratch_dir(spark, "symbol-table"), scratch_dir(spark, "embedding-table")
    symbols = inp.symbols(spark, sf_dir, with_text=True, corrected=True)
    tb.write_symbol_table(se.embed_symbols(symbols), target, vectors)
    index, embeddings = spark.read.parquet(target), spark.read.parquet(vectors)
    found = se.hybrid_symbol_search(index, embeddings, _search_queries(spark, sf_dir))
    return found.select("workspace", "query_id", "source", "rank", "symbol_id", "name")


@query
def open_document_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cx.open_document_overlay(inp.files(spark, sf_dir), inp.open_documents(spark, sf_dir))
    return texts.select("workspace", "path", "is_open", F.md5("text").alias("text_md5"))


@query
def lookup_symbol_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last symbol name of every file, looked up in that file."""
    symbols = _stored_symbols(spark, sf_dir)
    wanted = symbols.groupBy("workspace", F.col("path").alias("filename")).agg(F.max("name").alias("identifier"))
    texts = cx.open_document_overlay(inp.files(spark, sf_dir), inp.open_documents(spark, sf_dir))
    return cx.lookup_symbol_text(symbols, wanted, texts)


@query
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved(spark, sf_dir)
    return resolved.select("workspace", "path", "line", "start_col", "content", "def_path", "uid")


def _nodes_and_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return stored(inp.references(spark, sf_dir), "references"), _stored_symbols(spark, sf_dir)


def _name_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return gr.name_classes(*_nodes_and_symbols(spark, sf_dir))


@query
def reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with all their definitions: how many, the first and the last, and how many nodes refer to them."""
    classes, definitions, _ = _name_classes(spark, sf_dir)
    ends = definitions.groupBy("class_id").agg(F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"))
    return classes.join(ends, "class_id").drop("class_id")


@query
def reference_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node that has a definition, with the number of its definitions."""
    classes, _, members = _name_classes(spark, sf_dir)
    counted = members.join(classes.select("class_id", "n_definitions"), "class_id")
    return counted.select("workspace", "path", "line", "start_col", "content", "n_definitions")


@query
def linked_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All definitions of the nodes in toxic documents: nodes are chosen first, so that only their names' definitions are read on."""
    references, symbols = _nodes_and_symbols(spark, sf_dir)
    chosen = inp.labelled(spark, sf_dir).where("toxic = 1").select("workspace", "path")
    nodes = stored(references.join(chosen, ["workspace", "path"], "left_semi"), "nodes")
    _, definitions, members = gr.name_classes(nodes, symbols)
    members, definitions = stored(members, "members"), stored(definitions, "definitions")
    discard(references, symbols, nodes)
    links = gr.linked_definitions(members, definitions)
    return links.select("workspace", "path", "line", "start_col", "uid", "in_file")


@query
def enclosing_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition around every capitalised word, with its text."""
    references = inp.references(spark, sf_dir)
    symbols = inp.symbols(spark, sf_dir)
    locations = references.select(
        "workspace",
        "path",
        F.concat_ws(":", "line", "start_col").alias("uid"),
        F.col("line").alias("start_line"),
        "start_col",
    )
    around = checkpointed(gr.enclosing_definition(locations, symbols)).withColumnRenamed("uid", "place")
    uid = tx.definition_uid(F.col("path"), *[F.col(c) for c in PLACE])
    around = around.withColumn("uid", uid)
    texts = gr.definition_texts(
        around.select("workspace", "path", "uid", *PLACE).distinct(), inp.files(spark, sf_dir)
    )
    return around.join(texts, ["workspace", "path", "uid"]).select(
        "workspace", "path", "place", "uid", F.md5("definition").alias("definition_md5")
    )


@query
def resolve_workspace_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration of every language and source folder, from configurations by path and by name."""
    documents = inp.table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("/repo/"), "lang", F.lit("/"), "source")
    toxic = documents.join(inp.table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    none = F.lit(None).cast("string")
    by_path = toxic.select(
        F.concat("lang", F.lit("-"), "doc_id").alias("name"), folder.alias("path"),
        F.array(F.lit("*.md")).alias("include"), F.array(F.concat(F.lit("*."), "lang")).alias("exclude"),
    )
    by_name = documents.where(F.col("lang") == "es").select(
        F.col("source").alias("name"), none.alias("path"),
        F.array(F.concat("source", F.lit("/*"))).alias("include"), F.array().cast("array<string>").alias("exclude"),
    ).distinct()
    resolved = cf.resolve_workspace_config(
        documents.select(folder.alias("directory")).distinct(), by_path.unionByName(by_name)
    )
    return resolved.select(
        "directory",
        "config_name",
        F.array_join("include", ",").alias("include"),
        F.array_join("exclude", ",").alias("exclude"),
        "matched_by",
    )


@query
def model_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = inp.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("default_model"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("embed-"), "c_nationkey")).alias("embedding"),
        F.when(F.col("c_nationkey") > 12, F.col("c_name")).alias("explain_code"),
    )
    return cf.model_defaults(models)


# --- aggregations --------------------------------------------------------------------------------


@query
def symbols_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = ix.symbols_per_file(inp.files(spark, sf_dir), inp.symbols(spark, sf_dir))
    totals = ix.index_totals(per_file).select(
        F.lit("total").alias("workspace"), F.col("n_files").cast("string").alias("path"), "n_symbols"
    )
    return per_file.unionByName(totals)


@query
def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents carry a NUL character here, so they cannot be read as text."""
    broken = inp.labelled(spark, sf_dir).where(F.col("toxic") == 1).select("workspace", "path", F.lit(True).alias("nul"))
    files = inp.files(spark, sf_dir).join(broken, ["workspace", "path"], "left")
    files = files.withColumn("text", F.when(F.col("nul"), F.concat("text", F.lit("\u0000"))).otherwise(F.col("text")))
    return ix.failed_files(sy.add_text_errors(files))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.resolve_references(*_nodes_and_symbols(spark, sf_dir))


def _code_context(spark: SparkSession, sf_dir: str, requests: DataFrame | None = None) -> DataFrame:
    """Captures with their definitions' texts; those of the files asked for, with the line, where there are requests."""
    files, (references, symbols) = inp.files(spark, sf_dir), _nodes_and_symbols(spark, sf_dir)
    resolved = stored(gr.resolve_references(references, symbols), "resolved")
    discard(references, symbols)
    captures = gr.group_captures(resolved)
    if requests is not None:
        captures = captures.join(requests, ["workspace", "path"])
    captures = stored(captures, "captures")
    elsewhere = gr.distinct_locations(resolved.where(F.col("def_path") != F.col("path")))
    definitions = stored(gr.definition_texts(elsewhere, files), "definitions")
    discard(resolved)
    return gr.code_context(captures, definitions, files)


@query
def group_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _code_context(spark, sf_dir)
    places = F.transform("nodes", lambda n: F.concat_ws(":", n["line"], n["start_col"], n["content"]))
    return context.select(
        "workspace",
        "path",
        "uid",
        F.array_join(places, " ").alias("nodes"),
        F.md5("definition").alias("definition_md5"),
    )


@query
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.duration_stats(inp.samples(spark, sf_dir), ["source"])


@query
def duration_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = inp.samples(spark, sf_dir)
    pairs = [("view", "click"), ("click", "view"), ("purchase", "error")]
    result = None
    for subject, base in pairs:
        one = st.duration_ratio(samples, "source", subject, base)
        result = one if result is None else result.unionByName(one)
    return result.withColumn("ratio", F.round("ratio", 9))


@query
def compare_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, labelled = inp.files(spark, sf_dir), inp.labelled(spark, sf_dir)
    return st.compare_listings(files, labelled).unionByName(st.compare_listings(files, files))


def _context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cx.parse_context_specs(inp.specs(spark, sf_dir))
    texts = cx.open_document_overlay(inp.files(spark, sf_dir), inp.open_documents(spark, sf_dir))
    return cx.fetch_context_items(items, _stored_symbols(spark, sf_dir), texts)


@query
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.build_context(_context_items(spark, sf_dir), ["spec_id"])


@query
def stream_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.stream_full_text(inp.chunks(spark, sf_dir))


# --- text scalars and row generators -------------------------------------------------------------


@query
def slice_text_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every symbol."""
    uid = tx.definition_uid(F.col("path"), *[F.col(c) for c in PLACE])
    symbols = inp.symbols(spark, sf_dir, with_text=True)
    return symbols.select(uid.alias("uid"), F.md5("symbol_text").alias("text_md5"))


@query
def slice_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 9, from line 0, and past the end."""
    text = F.col("text")
    return inp.files(spark, sf_dir).select(
        "path",
        tx.slice_line_range(text, 3, 9).alias("lines"),
        tx.slice_line_range(text, 0, 1000).alias("head"),
        tx.slice_line_range(text, 3, 1000, corrected=True).alias("corrected"),
    )


@query
def text_end_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset, in_bytes = tx.text_end_offset(F.col("text")), tx.text_end_offset(F.col("text"), "byte")
    return inp.files(spark, sf_dir).select(
        "path", offset["line"].alias("lines"), offset["character"].alias("chars"), in_bytes["character"].alias("bytes")
    )


def _edit(sl: int, sc: int, el: int, ec: int, text: str) -> Column:
    values = (sl, sc, el, ec, text)
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, schemas.EDIT.names, strict=True)])


@query
def apply_text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the first line, insert two characters into the next, add a line in front."""
    edits = F.array(_edit(0, 0, 1, 0, ""), _edit(0, 2, 0, 2, "<>"), _edit(0, 0, 0, 0, "top\n"))
    edited = tx.apply_text_edits(F.col("text"), edits)
    return inp.files(spark, sf_dir).select("path", edited.alias("e")).select(
        "path", F.col("e.text").alias("text"), F.col("e.error").alias("error")
    )


@query
def tokenize_spec_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a quoted path, an escaped space, a joined quote and, for English, one quote too many."""
    line = F.concat(
        F.lit('"'), "source", F.lit(' "'), "doc_id", F.lit('" "  '), "lang", F.lit("\\ \\\"x  n"), "n_chars",
        F.when(F.col("lang") == "en", ' "').otherwise(""),
    )
    tokens = sp.tokenize_spec_line(line)
    return inp.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).alias("n_tokens")
    ).withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.col("n_tokens")))


@query
def parse_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        "doc_id", F.lit(":"), "n_chars", F.when(F.col("lang") == "fr", ":1").when(F.col("lang") == "de", "x").otherwise("")
    )
    parsed = sp.parse_line_range(text)
    return inp.table(spark, sf_dir, "documents").select(
        "doc_id", parsed["range_start"].alias("range_start"), parsed["range_end"].alias("range_end")
    )


@query
def parse_context_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cx.parse_context_specs(inp.specs(spark, sf_dir))
    return items.select(
        "spec_id", "line_no", "item_no", F.array_join("parts", "|").alias("parts"), "type", "filename",
        "identifier", "range_start", "range_end", "error",
    )


@query
def render_context_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _context_items(spark, sf_dir)
    rendered = cx.render_context_item(*[F.col(c) for c in ("type", "filename", "identifier", "content")])
    return items.where(F.col("error").isNull()).select("spec_id", "line_no", "item_no", rendered.alias("rendered"))


@query
def selection_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document selected from line 1, column 2, to its last line; one small context per workspace."""
    documents = inp.files(spark, sf_dir)
    last = F.size(F.split("text", "\n", -1)) - 1
    selections = documents.select(
        "workspace", "path", F.lit(1).alias("sl"), F.lit(2).alias("sc"), last.alias("el"), F.lit(3).alias("ec")
    )
    spec = F.concat(F.min("path"), F.lit(" 1:2\n"), F.max("path"), F.lit(" 1:1"))
    specs = documents.groupBy("workspace").agg(spec.alias("spec")).withColumn("spec_id", F.col("workspace"))
    items = cx.fetch_context_items(cx.parse_context_specs(specs), _stored_symbols(spark, sf_dir), documents)
    contexts = cx.build_context(items, ["workspace"])
    prompts = cx.selection_prompt(selections, documents, contexts)
    return prompts.select("path", F.md5("prompt").alias("prompt_md5"), "error")


@query
def symbol_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = inp.symbols(spark, sf_dir, with_text=True)
    return symbols.select(
        "path", "symbol_no", F.md5(tx.symbol_embedding_text(F.col("symbol_text"))).alias("text_md5")
    )


@query
def definition_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = tx.definition_uid(F.col("path"), *[F.col(c) for c in PLACE])
    return inp.symbols(spark, sf_dir).select("path", "symbol_no", uid.alias("uid"))


# --- running totals ------------------------------------------------------------------------------


@query
def running_symbol_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = ix.symbols_per_file(inp.files(spark, sf_dir), inp.symbols(spark, sf_dir))
    return ix.running_symbol_totals(per_file)


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream starts at a place of its own."""
    streams = inp.table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id").distinct()
    return streams.select(
        F.col("conv_id").alias("stream_id"),
        F.col("conv_id").alias("line"),
        (F.col("conv_id") + 7).alias("character"),
    )


@query
def stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.stream_cursor(inp.chunks(spark, sf_dir), _starts(spark, sf_dir)).drop("text")


@query
def stream_line_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.stream_line_progress(inp.chunks(spark, sf_dir), prefix="progress: ")


# --- streaming -----------------------------------------------------------------------------------


DROPS = 3


def _drops(rows: DataFrame, order: str) -> list[DataFrame]:
    """The rows in equal ranges of an order column, as they would arrive one after the other."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    drop = F.floor((F.col(order) - low) * DROPS / F.lit(high - low + 1))
    return [rows.where(drop == number) for number in range(DROPS)]


def _run_in_drops(spark: SparkSession, drops: list[DataFrame], run) -> None:
    """Write each drop into a stream folder and run the stream over what is new; ``run(stream, checkpoint)``."""
    source, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "stream-checkpoint")
    for drop in drops:
        drop.write.mode("append").parquet(source)
        run(spark.readStream.schema(drop.schema).parquet(source), checkpoint)


def _document_stream(spark: SparkSession, sf_dir: str) -> DocumentStateStream:
    """All events; those of purchases arrive twice."""
    documents = DocumentStateStream(spark, scratch_dir(spark, "document-state"))
    events = inp.document_events(spark, sf_dir)
    bought = inp.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(F.col("event_id").alias("seq"))
    events = events.unionByName(events.join(bought, "seq", "left_semi"))
    _run_in_drops(spark, _drops(events, "seq"), lambda stream, _: documents.run(stream))
    return documents


@query
def document_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _document_stream(spark, sf_dir).documents()
    return states.select(
        "uri", "is_open", "language_id", "version", "text", F.unix_micros("last_edit").alias("last_edit"), "last_seq"
    )


@query
def document_stream_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_stream(spark, sf_dir).problems()


@query
def index_refresh_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _refreshed(spark, sf_dir)
    return _rows_of_index(index.files(), index.symbols())


@query
def index_refresh_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of toxic documents are also listed with a wrong ending, so no file lies there."""
    return _refreshed(spark, sf_dir).problems().select("workspace", "path", F.col("error").isNotNull().alias("failed"))


@query
def index_refresh_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the largest value of every symbol's vector after the refresh, and its size."""
    found = _refreshed(spark, sf_dir, se.HashedWords()).embeddings()
    largest = F.array_max("embedding")
    return found.select("symbol_id", F.array_position("embedding", largest).alias("place"), F.size("embedding").alias("dimensions"))


def _refreshed(spark: SparkSession, sf_dir: str, model: se.Model | None = None) -> IndexRefreshStream:
    """Every document arrives as a file: half of the manifest, the rest, then all of it again."""
    root = scratch_dir(spark, "tree")
    written = inp.document_tree(spark, sf_dir, root)
    manifest = written.select(F.lit("all").alias("workspace"), F.lit(root).alias("root"), "path")
    listed = scratch_dir(spark, "manifest")
    manifest.write.parquet(listed)
    manifest = spark.read.schema(MANIFEST).parquet(listed)
    gone = inp.labelled(spark, sf_dir).where("toxic = 1").select(
        F.lit("all").alias("workspace"), F.lit(root).alias("root"), F.concat(F.lit(root), F.lit("/"), "path", F.lit("~")).alias("path")
    )
    manifest = manifest.unionByName(gone)
    first = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    index = IndexRefreshStream(spark, scratch_dir(spark, "index"), inp.PROSE_RULES, model=model)
    _run_in_drops(spark, [manifest.where(first), manifest.where(~first), manifest], index.run)
    return index


def _completion_stream(spark: SparkSession, sf_dir: str) -> CompletionStream:
    """The last turn of a conversation is done; the user's turns arrive twice, and each stream goes on after its end."""
    chunks = inp.chunks(spark, sf_dir)
    ends = chunks.groupBy("stream_id").agg(F.max("seq").alias("last"))
    rows = chunks.join(ends, "stream_id").withColumn("done", F.col("seq") == F.col("last")).drop("last")
    asked = inp.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    repeats = rows.join(
        asked.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq")), ["stream_id", "seq"], "left_semi"
    )
    after = ends.select("stream_id", (F.col("last") + 1).alias("seq"), F.lit("too late\n").alias("text"), F.lit(False).alias("done"))
    completions = CompletionStream(spark, scratch_dir(spark, "completion-state"), prefix="progress: ")
    arriving = rows.unionByName(repeats.select(*rows.columns)).unionByName(after)
    _run_in_drops(spark, _drops(arriving, "seq"), lambda stream, _: completions.run(stream))
    return completions


@query
def completion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    completions = _completion_stream(spark, sf_dir)
    return completions.cursors().join(completions.pending(), "stream_id", "left").join(completions.full_text(), "stream_id").select(
        "stream_id", "line", "character", F.coalesce("pending", F.lit("")).alias("pending"), "last_seq", "is_done",
        F.md5("full_text").alias("text_md5"),
    )


@query
def completion_stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completion_stream(spark, sf_dir).reports()


@query
def completion_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completion_stream(spark, sf_dir).late().select("stream_id", "seq", F.md5("text").alias("text_md5"))


# --- embedding -----------------------------------------------------------------------------------


@query
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every document's vector."""
    vectors = inp.files(spark, sf_dir).select("doc_id", se.embed_text(F.col("text")).alias("embedding"))
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


# --- the flagship --------------------------------------------------------------------------------


@query
def symbol_search_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, their symbols, a prefix search, and the located text of each hit."""
    symbols = inp.symbols(spark, sf_dir, with_text=True, corrected=True, keep=["md5"])
    located = sy.symbol_location_struct(se.symbol_prefix_search(symbols, "th"), "/repo")
    uri, definition = F.col("location.uri").alias("uri"), F.col("symbol_text").alias("definition")
    return located.select("name", "kind", uri, *PLACE, definition, "md5")
