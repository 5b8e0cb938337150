"""Symbol search: by name prefix, by embedding, and prefix with embedding as the fallback."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import names
from symloom.functions import text as tx
from symloom.session import checkpointed

PREFIX_LIMIT = 100
NEAREST = 10
# Lengths of the prefixes that join queries to names; a query uses the longest that its literal start fills.
HEADS = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32]
CACHED_WORDS = 1 << 16
# Vectors in a block, about: a task compares one block of queries with one block of embeddings at a time.
QUERIES_PER_BLOCK = 1024
VECTORS_PER_BLOCK = 4096
# Symbols of a workspace are spread over this many tasks for queries that start with a wildcard.
SALTS = 64

SYMBOL_ORDER = ["path", "start_line", "start_col", "name"]

Model = Callable[[pd.Series], np.ndarray]


def symbol_prefix_search(
    symbols: DataFrame, prefix: str, limit: int = PREFIX_LIMIT, corrected: bool = False
) -> DataFrame:
    """The first ``limit`` symbols, by path and position, whose name starts with a prefix."""
    return (
        symbols.where(names.has_prefix(F.col("name_fold"), prefix, corrected))
        .orderBy(*SYMBOL_ORDER)
        .limit(limit)
    )


def prefix_matches(symbols: DataFrame, queries: DataFrame, corrected: bool = False) -> DataFrame:
    """Symbols that match each ``queries(workspace, query_id, query)``, uncut.

    An equi-join on workspace and the literal start of the query finds the candidates, so a symbol meets
    next to no query that it does not match; it is copied for the lengths that the queries use only. A
    query without a literal start must look at every symbol of its workspace: those are spread by salts.
    """
    sizes = F.array(*[F.lit(size) for size in HEADS])
    literal = names.literal_start(F.col("query"), corrected)
    size = F.array_max(F.filter(sizes, lambda size: size <= F.length(literal)))
    asked = queries.withColumn("_size", size).withColumn("_head", F.substring(literal, F.lit(1), F.col("_size")))
    # A dozen numbers at most.
    used = sorted(r[0] for r in asked.select("_size").distinct().collect() if r[0] is not None)
    matches = names.has_prefix(F.col("name_fold"), F.col("query"), corrected)
    found = []
    if any(used):
        lengths = F.array(*[F.lit(size) for size in used if size])
        fitting = F.filter(lengths, lambda size: size <= F.length("name_fold"))
        heads = F.transform(fitting, lambda size: F.substring(F.col("name_fold"), F.lit(1), size))
        by_head = asked.where("_size > 0").drop("_size")
        found.append(
            symbols.withColumn("_head", F.explode(heads)).join(by_head, ["workspace", "_head"]).where(matches).drop("_head")
        )
    if 0 in used or not found:
        salt = F.pmod(F.xxhash64(*SYMBOL_ORDER), F.lit(SALTS)).cast("int")
        copies = asked.where("_size = 0").drop("_size", "_head").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        )
        found.append(symbols.withColumn("_salt", salt).join(copies, ["workspace", "_salt"]).where(matches).drop("_salt"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def first_by_place(matches: Callable[[DataFrame], DataFrame], queries: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` symbols of each query by path and place, with their rank.

    ``matches`` gives the symbols of queries. Each text is looked up once in its workspace, however many queries have it:
    its first symbols are all that any of them can use.
    """
    asked = queries.select("workspace", "query_id", "query")
    texts = asked.select("workspace", F.col("query").alias("query_id"), "query").distinct()
    of_text = Window.partitionBy("workspace", "query").orderBy(*SYMBOL_ORDER)
    first = matches(texts).drop("query_id").withColumn("_place", F.row_number().over(of_text))
    first = first.where(F.col("_place") <= limit).drop("_place")
    by_place = Window.partitionBy("workspace", "query_id").orderBy(*SYMBOL_ORDER)
    ranked = first.join(asked, ["workspace", "query"]).withColumn("rank", F.row_number().over(by_place))
    columns = [c for c in first.columns if c != "query"]
    return ranked.where(F.col("rank") <= limit).select(*columns, "query_id", "query", "rank")


def prefix_search_many(
    symbols: DataFrame, queries: DataFrame, limit: int = PREFIX_LIMIT, corrected: bool = False
) -> DataFrame:
    """The first ``limit`` symbols of each query, with their rank; each task cuts before the shuffle."""
    return first_by_place(lambda texts: prefix_matches(symbols, texts, corrected), queries, limit)


class HashedWords:
    """The offline model: counts of words hashed to a number of places, scaled to length 1."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self._places: dict[str, int] = {}

    def _place(self, word: str) -> int:
        place = self._places.get(word)
        if place is None:
            if len(self._places) >= CACHED_WORDS:
                self._places.clear()
            digest = hashlib.md5(names.fold_text(word).encode()).digest()
            place = self._places[word] = int.from_bytes(digest[:4], "big") % self.dimensions
        return place

    def __call__(self, texts: pd.Series) -> np.ndarray:
        size, shape = self.dimensions, (len(texts), self.dimensions)
        words = [text.split() for text in texts]
        rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
        places = np.fromiter((self._place(w) for text in words for w in text), np.int64, len(rows))
        counts = np.bincount(rows * size + places, minlength=shape[0] * size).reshape(shape).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return counts / np.where(norms == 0, 1, norms)


def embed_text(text: Column, model: Model | None = None) -> Column:
    """Vector of each text by a model that maps a batch of texts to a matrix.

    Marked as not deterministic, so that no optimizer rule copies the call: a text is embedded once.
    """
    chosen = model or HashedWords()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(chosen(texts), dtype=np.float32)))

    return run.asNondeterministic()(text)


def embed_symbols(symbols_with_text: DataFrame, model: Model | None = None) -> DataFrame:
    return symbols_with_text.withColumn(
        "embedding", embed_text(tx.symbol_embedding_text(F.col("symbol_text")), model)
    )


def _vector_blocks(vectors: DataFrame, key: str, size: int, prefix: str) -> DataFrame:
    """Vectors in blocks of about ``size`` per workspace: ``workspace, <prefix>_block, <prefix>_blocks, keys, values``."""
    sized = vectors.where(F.col("embedding").isNotNull()).select(
        "workspace", F.col(key).alias("_key"), F.col("embedding").cast("array<double>").alias("_vector")
    )
    # Only workspaces of more than one block are sent to the tasks: no more of them than there are blocks.
    counted = sized.groupBy("workspace").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > size)
    large = counted.select("workspace", F.ceil(F.col("_rows") / size).cast("int").alias(f"{prefix}_blocks"))
    block = F.pmod(F.xxhash64("_key"), F.col(f"{prefix}_blocks")).cast("int")
    row = F.struct("_key", "_vector")
    return (
        sized.join(F.broadcast(large), "workspace", "left")
        .fillna(1, [f"{prefix}_blocks"])
        .groupBy("workspace", block.alias(f"{prefix}_block"), f"{prefix}_blocks")
        .agg(F.collect_list(row).alias("_rows"))
        .select(
            "workspace",
            f"{prefix}_block",
            f"{prefix}_blocks",
            F.transform("_rows", lambda r: r["_key"]).alias(f"{prefix}_keys"),
            F.flatten(F.transform("_rows", lambda r: r["_vector"])).alias(f"{prefix}_values"),
        )
    )


def nearest_in_block(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """Per query, its row number, the ids of the k nearest vectors, and their distances; ties by id.

    One matrix product tells who can be among the k; their distances are then summed place by place.
    """
    squares = (vectors * vectors).sum(axis=1)
    own = (queries * queries).sum(axis=1)
    rough = own[:, None] + squares[None, :] - 2 * (queries @ vectors.T)
    slack = 1e-9 * (own + squares.max(initial=0.0) + 1)
    if len(ids) > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
    else:
        limit = np.full(len(queries), np.inf)
    for at, query in enumerate(queries):
        near = np.flatnonzero(rough[at] <= limit[at])
        gaps = vectors[near] - query
        distance = np.sqrt(np.cumsum(gaps * gaps, axis=1)[:, -1]) if gaps.shape[1] else np.zeros(len(near))
        order = np.lexsort((ids[near], distance))[:k]
        yield at, ids[near][order], distance[order]


def compared_blocks(pairs: DataFrame, k: int, query_type: str) -> DataFrame:
    """``(workspace, query_id, symbol_id, distance)``: the k nearest of each pair of blocks, for each of its queries."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ids = np.array(list(pair.symbol_keys), dtype=object)
                keys = list(pair.query_keys)
                vectors = np.asarray(pair.symbol_values, np.float64).reshape(len(ids), -1)
                sought = np.asarray(pair.query_values, np.float64).reshape(len(keys), -1)
                frames = [
                    pd.DataFrame({"workspace": pair.workspace, "query_id": keys[at], "symbol_id": found, "distance": distance})
                    for at, found, distance in nearest_in_block(sought, vectors, ids, k)
                ]
                yield pd.concat(frames, ignore_index=True)

    columns = ["workspace", "symbol_keys", "symbol_values", "query_keys", "query_values"]
    return pairs.select(*columns).mapInPandas(
        compare, f"workspace string, query_id {query_type}, symbol_id string, distance double"
    )


def first_by_distance(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each query with the smallest distance, with their rank; ties by id."""
    by_distance = Window.partitionBy("workspace", "query_id").orderBy("distance", "symbol_id")
    return found.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)


def nearest_symbols(embeddings: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """The k nearest of ``embeddings(workspace, symbol_id, embedding)`` per ``queries(workspace, query_id, embedding)``, by L2.

    A query sees its own workspace only. Both sides come in blocks, and every block of a workspace's queries meets
    every block of its embeddings in some task: the queries' blocks are copied to the embeddings' blocks, each of which is a key
    of its own. A pair of blocks gives k rows per query. Ties go to the lower id.
    """
    query_type = queries.schema["query_id"].dataType.simpleString()
    asked = _vector_blocks(queries, "query_id", QUERIES_PER_BLOCK, "query")
    stored = _vector_blocks(embeddings, "symbol_id", VECTORS_PER_BLOCK, "symbol")
    numbers = stored.select("workspace", "symbol_block")
    aimed = asked.join(numbers, "workspace")
    pairs = stored.join(aimed, ["workspace", "symbol_block"])
    return first_by_distance(compared_blocks(pairs, k, query_type), k)


def semantic_symbol_search(
    symbols: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = NEAREST
) -> DataFrame:
    """The symbols of each query's workspace whose embeddings are nearest to its vector, with their rank."""
    hits = nearest_symbols(embeddings, queries, k).select("workspace", "query_id", "rank", "symbol_id")
    return symbols.join(hits, ["workspace", "symbol_id"])


def needs_semantic_search(query: Column) -> Column:
    """At least 10 bytes, and a space."""
    return (F.octet_length(query) >= 10) & query.contains(" ")


def hybrid_symbol_search(
    symbols: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    model: Model | None = None,
    limit: int = PREFIX_LIMIT,
    k: int = NEAREST,
) -> DataFrame:
    """Prefix hits of each query in its workspace; for a long query without any, the nearest symbols there instead.

    The prefix hits and the vectors of the queries left over are stored, so neither is made twice.
    """
    columns = ["workspace", "query_id", "query", "rank", "symbol_id", "name", "path", "start_line", "source"]
    key = ["workspace", "query_id"]
    hits = prefix_search_many(symbols, queries, limit).withColumn("source", F.lit("prefix"))
    prefix = checkpointed(hits.select(*columns))
    unmatched = queries.where(needs_semantic_search(F.col("query"))).join(
        prefix.select(*key).distinct(), key, "left_anti"
    )
    vectors = checkpointed(unmatched.select(*key, "query").withColumn("embedding", embed_text(F.col("query"), model)))
    semantic = (
        semantic_symbol_search(symbols, embeddings, vectors, k)
        .join(vectors.select(*key, "query"), key)
        .withColumn("source", F.lit("semantic"))
    )
    return prefix.unionByName(semantic.select(*columns))
