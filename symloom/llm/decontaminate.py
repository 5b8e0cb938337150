"""Benchmark decontamination: a generalised suffix automaton of the items, streamed over by the documents' words."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from symloom.llm.shared import free_name, placed_in_order, prefix_sums, stored, text_batches

#: Benchmark text in one automaton; a larger benchmark takes several, one pass over the documents for each.
AUTOMATON_BYTES = 512 * 1024

LETTERS_AND_DIGITS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "n_words long, from array<int>, to array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    """Words of letters, digits and all beyond ASCII, with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS_AND_DIGITS).split()


class Automaton:
    """The generalised suffix automaton of the items' words: every run of words in any item is a path from state 0.

    ``items[s]`` are the items that hold the window which ends where state s is reached by a match of a
    window's length or more. ``shorts[s]`` are the items shorter than a window that end there, by length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        holders: dict[int, set[str]] = {}
        short_ends: dict[int, set[tuple[int, str]]] = {}
        for name, codes in coded:
            state = 0
            for place, code in enumerate(codes, 1):
                state = self.next[state][code]
                if place >= window:
                    holders.setdefault(self._holding(state, window), set()).add(name)
            if len(codes) < window:
                short_ends.setdefault(self._holding(state, len(codes)), set()).add((len(codes), name))
        self.items = [holders.get(self._holding(s, window), ()) for s in range(len(self.next))]
        self.shorts: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.shorts[s] = (*self.shorts[self.link[s]], *short_ends.get(s, ()))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, code: int) -> int:
        """The state for the shorter runs of q that p leads to."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, self.next[last][code], code)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][code], code)
        return new

    def _holding(self, state: int, length: int) -> int:
        """The state on the way to the root that holds the last ``length`` words."""
        while state > 0 and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items hit.

        A word that no item has leads back to the root, so only runs of known words are streamed, and of them
        those as long as the shortest window.
        """
        hit = np.zeros(len(words), bool)
        get = self.vocabulary.get
        codes = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        edges = np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        found: set[str] = set()
        for run in np.flatnonzero(ends - starts >= self.shortest):
            state = matched = 0
            start = int(starts[run])
            for i, code in enumerate(codes[start : ends[run]].tolist(), start):
                while state and code not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                following = self.next[state].get(code)
                if following is None:
                    continue
                state, matched = following, matched + 1
                if matched >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    found.update(self.items[state])
                for length, name in self.shorts[state]:
                    if length <= matched:
                        hit[i + 1 - length : i + 1] = True
                        found.add(name)
        return hit, found


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()


def without_runs(text: str, starts: list[int], ends: list[int]) -> str:
    """A text without runs of its words and what stands between the words of a run."""
    if not len(starts):
        return text
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(data.lower())]
    kept, at = [], 0
    for x, y in zip(starts, ends, strict=True):
        kept.append(data[at : places[int(x)][0]])
        at = places[int(y) - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def _hits(sent, rest: bool):
    @F.pandas_udf(f"{HITS}, rest string")
    def hits(texts: pd.Series) -> pd.DataFrame:
        automaton, rows = sent.value, []
        for text in texts:
            words = words_of(text)
            hit, items = automaton.scan(words)
            starts, ends = _runs(hit) if items else ([], [])
            rows.append((len(words), starts, ends, sorted(items), without_runs(text, starts, ends) if rest else None))
        return pd.DataFrame(rows, columns=["n_words", "from", "to", "items", "rest"])

    # Not deterministic for the optimizer: a filter on the result must not run it once more.
    return hits.asNondeterministic()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", result: str = "_hits", rest: bool = False,
) -> DataFrame:
    """Add the struct ``result``: the document's number of words, the runs of hit words ``from`` to ``to`` (end exclusive), the
    items, and if asked for, as ``rest``, the text without those runs.

    A window is ``window`` consecutive words of an item; a shorter item with any word is one window. A word inside any
    occurrence of a window is hit. Null texts have no words; items with equal ids are one item; a null item
    id appears as an empty text. An empty benchmark hits nothing, an empty table gives no rows. All columns of the
    documents are kept.

    The automaton is sent to the tasks. A benchmark beyond ``AUTOMATON_BYTES`` is cut into blocks of that
    size, each its own automaton and pass, and the hits of a document are united.
    """
    spark = text_batches(docs).sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("words"),
    )
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size <= AUTOMATON_BYTES:
        blocks = [items]
    else:
        order = ["item", "words"]
        placed = prefix_sums(placed_in_order(items, order, "items"), order, {"bytes": F.octet_length("words").cast("long")})
        cut = stored(placed.withColumn("block", F.expr(f"before_bytes div {AUTOMATON_BYTES}")), "item-blocks")
        numbers = range(-(-size // AUTOMATON_BYTES))
        blocks = [cut.where(F.col("block") == n).select("item", "words") for n in numbers]
        row, some_hits = free_name(docs, "_row"), free_name(docs, "_some")
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        text = F.coalesce(F.col(text_col), F.lit(""))

    def hits_of(block: DataFrame) -> Column:
        rows = [(r["item"], words_of(r["words"])) for r in block.toLocalIterator()]
        return _hits(spark.sparkContext.broadcast(Automaton(rows, window)), rest and len(blocks) == 1)(text)

    if len(blocks) == 1:
        return docs.withColumn(result, hits_of(blocks[0]))
    passes = [stored(docs.select(row, hits_of(b).alias("h")).where(F.size("h.items") > 0), "hits") for b in blocks]
    united = passes[0]
    for more in passes[1:]:
        united = united.unionByName(more)

    @F.pandas_udf("struct<n_words long, from array<int>, to array<int>, items array<string>>")
    def unite(words: pd.Series, starts: pd.Series, ends: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for n, a, b, items_hit in zip(words, starts, ends, names, strict=True):
            hit = np.zeros(n, bool)
            for x, y in zip(np.concatenate([*a]), np.concatenate([*b]), strict=True):
                hit[int(x) : int(y)] = True
            rows.append((n, *_runs(hit), sorted({i for part in items_hit for i in part})))
        return pd.DataFrame(rows, columns=["n_words", "from", "to", "items"])

    # One row per pass and document at most.
    gathered = united.groupBy(row).agg(
        F.max("h.n_words").alias("n"), *[F.collect_list(f"h.{c}").alias(c) for c in ("from", "to", "items")]
    )
    some = gathered.select(row, unite("n", "from", "to", "items").alias(some_hits))
    clean = F.struct(
        F.pandas_udf(_word_counts, LongType())(text).alias("n_words"), F.expr("array()").cast("array<int>").alias("from"),
        F.expr("array()").cast("array<int>").alias("to"), F.expr("array()").cast("array<string>").alias("items"),
    )
    joined = docs.join(some, row, "left").withColumn(result, F.coalesce(some_hits, clean))
    cut = F.pandas_udf(_without, StringType())(text, f"{result}.from", f"{result}.to") if rest else F.lit(None).cast("string")
    return joined.withColumn(result, F.col(result).withField("rest", cut)).drop(some_hits, row)


def _word_counts(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t)) for t in texts], dtype="int64")


def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([without_runs(t, a, b) for t, a, b in zip(texts, starts, ends, strict=True)], dtype="object")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents without their hit runs of words; those with more than ``max_share`` of their words hit go.

    Columns stay as they are; documents without a hit keep every character, null texts stay null.
    """
    columns, hits = docs.columns, free_name(docs, "_hits")
    found = contamination(docs, benchmark, window, text_col, result=hits, rest=True)
    n_hit = F.aggregate(
        F.zip_with(f"{hits}.from", f"{hits}.to", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    kept = found.where(n_hit <= F.col(f"{hits}.n_words") * F.lit(max_share))
    cut = F.when(F.col(text_col).isNotNull(), F.col(f"{hits}.rest"))
    return kept.withColumn(text_col, cut).select(*columns)
