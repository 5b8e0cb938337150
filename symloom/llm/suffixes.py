"""Repeated passages by suffix order: every byte of a 200-byte string that starts anywhere else, too, is removed.

A text of n bytes has n - 199 suffixes that matter, and 200 bytes of each decide. To sort them all would
move 200 times the input, so suffixes are settled in three rounds, each over what the round before left:

1. *Anchors.* In every window of 200 bytes the 32-gram with the smallest hash is its anchor; equal windows have
   equal anchors at equal places. All windows with one anchor form a stretch of starts. If the anchor's 32-gram
   occurs once in the corpus, no window of the stretch repeats. If the whole stretch occurs twice, all do.
2. *Cells.* What is left is cut into cells of 8 starts, aligned to the anchor. All windows of a cell share
   a core of 193 bytes: again, a core that occurs once settles the cell, and so does a whole cell that occurs twice.
3. *Suffixes.* The windows of the remaining cells, and of the cells they may equal, are sorted as suffixes: sampled
   splitters range-partition them by their leading bytes, each bucket sorts by a multikey sort, and a suffix repeats
   if it equals a neighbour, in the bucket or across its boundary.

Equality of grams, cores and cells is that of 64-bit hashes, that of suffixes of 24 leading bytes and 128 bits of
hash for the rest. A group of any size is only counted, or joined where adaptive execution may split it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.shared import discard, stored, text_batches, worker_state

SPAN = 200
GRAM = 32
CELL = 8
LEAD_WORDS = 3
CHUNK_BYTES = 1 << 18

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
HIGH = 0xFFFFFFFF00000000


def _mix(h):
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of a text from prefix sums: the value of a polynomial in an odd base, mixed."""

    def __init__(self, data: bytes, seed: int = 1):
        n = len(data)
        self.bytes = np.frombuffer(data, np.uint8)
        self.powers, self.inverse = self._powers(n + 1)
        letters = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64((2 * seed + 1) * BASE & MASK))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[self.bytes] * self.powers[:n], out=self.sums[1:])

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        kept = worker_state("powers")
        if len(kept.get("up", ())) < n:
            size, inverse = max(n, 1 << 17), pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                kept[name] = np.multiply.accumulate(factors)
        return kept["up"], kept["down"]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, MASK, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def chunks_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``CHUNK_BYTES`` together; a longer row is a chunk of its own."""
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > CHUNK_BYTES:
            yield start, k
            start, held = k, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def anchors_of(texts: list[bytes], span: int = SPAN) -> dict[str, np.ndarray]:
    """Anchors of all texts: the number ``text`` of their text, their place ``at``, the first and last start ``lo`` and
    ``hi`` of their stretch of windows, and the hashes ``part`` and ``whole`` of 32-gram and stretch.

    The texts are hashed as one; windows over the end of a text are left out, and others never look beyond it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = b"".join(texts)
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return {c: none for c in ("text", "at", "lo", "hi", "part", "whole")}
    hashes = Hashes(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(places, places + GRAM)
    ranked = (grams & np.uint64(HIGH)) | places.astype(np.uint64)
    smallest = _smallest(ranked, span - GRAM + 1)
    inside = np.repeat(ends, sizes)[: len(smallest)] - np.arange(len(smallest)) >= span
    starts = np.flatnonzero(inside)
    anchor = (smallest[starts] & np.uint64(MASK ^ HIGH)).astype(np.int64)
    # Windows with one anchor follow each other; texts share none.
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    lo, hi, at = starts[first], starts[np.append(first[1:], len(starts))[: len(first)] - 1], anchor[first]
    shape = ((at - lo) * 1_000_003 + (hi - lo)).astype(np.uint64)
    whole = _mix(hashes.of(lo, hi + span) ^ _mix(shape))
    text = np.searchsorted(ends, lo, side="right")
    offset = (ends - sizes)[text]
    return {
        "text": text, "at": at - offset, "lo": lo - offset, "hi": hi - offset,
        "part": grams[at].view(np.int64), "whole": whole.view(np.int64),
    }


def cells_of(pieces: pd.DataFrame, span: int = SPAN) -> dict[str, np.ndarray]:
    """Cells of pieces: the number ``piece`` of their piece, the hashes ``part`` of the core and ``whole`` of the cell, and the
    first and last start ``a`` and ``b``.

    A piece holds the ``bytes`` from place ``first`` of a text of ``n`` bytes around the stretch ``lo`` to ``hi`` of the anchor ``at``.
    A cell reaches over the stretch's ends as far as the text does; its core lies in the text all the same.
    """
    at, lo, hi, n, first = (pieces[c].to_numpy(np.int64) for c in ("at", "lo", "hi", "n", "first"))
    sizes = np.array([len(x) for x in pieces["bytes"]], np.int64)
    shift = np.cumsum(sizes) - sizes - first
    hashes = Hashes(b"".join(pieces["bytes"]))
    least = (at - hi) // CELL
    counts = (at - lo) // CELL - least + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    numbers = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + least[piece]
    end = at[piece] - CELL * numbers
    start = end - (CELL - 1)
    a, b = np.maximum(start, 0), np.minimum(end, n[piece] - span)
    move = shift[piece]
    core = hashes.of(end + move, start + span + move)
    whole = hashes.of(a + move, b + span + move)
    shape = (numbers * CELL * CELL + (a - start) * CELL + (end - b)).astype(np.uint64)
    return {
        "piece": piece, "a": a, "b": b,
        "part": _mix(core ^ _mix(numbers.astype(np.uint64) + np.uint64(17))).view(np.int64),
        "whole": _mix(whole ^ _mix(shape + np.uint64(1 << 20))).view(np.int64),
    }


def cut_of(at: int, lo: int, hi: int, n: int, span: int = SPAN) -> tuple[int, int]:
    """Where the bytes of all cells of a stretch begin and end."""
    return max(0, at - CELL * ((at - lo) // CELL) - (CELL - 1)), min(n - span, at - CELL * ((at - hi) // CELL)) + span


def repeated(hashed: DataFrame, name: str) -> DataFrame:
    """``(kind, hash)`` of the parts (0) and wholes (1) that occur twice or more."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("part").alias("hash")), F.struct(F.lit(1).alias("kind"), F.col("whole").alias("hash"))))
    kinds = hashed.select(both.alias("k")).select("k.kind", "k.hash")
    return stored(kinds.groupBy("kind", "hash").count().where("count > 1").select("kind", "hash"), name)


def settle(hashed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose part repeats, with ``settled`` where their whole does, and the rows that the next round needs.

    Those are the unsettled rows, and for parts of unsettled rows with ``own`` set one row of every
    settled whole, as something to be equal to.
    """
    twice = repeated(hashed, f"{name}-twice")
    parts = twice.where("kind = 0").select(F.col("hash").alias("part"))
    wholes = twice.where("kind = 1").select(F.col("hash").alias("whole"), F.lit(True).alias("settled"))
    found = stored(
        hashed.join(parts, "part").join(wholes, "whole", "left").withColumn("settled", F.coalesce("settled", F.lit(False))),
        name,
    )
    open_parts = stored(found.where("own and not settled").select("part").distinct(), f"{name}-open")
    needed = found.join(open_parts, "part", "left_semi")
    rest = [c for c in found.columns if c not in ("whole", "settled")]
    models = needed.where("settled").groupBy("whole").agg(F.min(F.struct(*rest)).alias("m")).select("m.*")
    models = models.withColumn("own", F.lit(False))
    following = needed.where("not settled").select(*rest).unionByName(models.select(*rest))
    discard(twice)
    return found, following


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several words: sort by the first, then by the next only what is still equal."""
    order = np.argsort(words[0], kind="stable")
    tied = np.zeros(len(order), bool)
    if len(order) > 1:
        tied[1:] = words[0][order[1:]] == words[0][order[:-1]]
    for word in words[1:]:
        group = np.cumsum(~tied)
        member = tied.copy()
        member[:-1] |= tied[1:]
        places = np.flatnonzero(member)
        if not len(places):
            break
        rows = order[places]
        rows = rows[np.lexsort((word[rows], group[places]))]
        order[places] = rows
        later = np.flatnonzero(tied)
        tied[later] = word[order[later]] == word[order[later - 1]]
    return order


WORDS = [f"w{k}" for k in range(LEAD_WORDS + 2)]
SUFFIX = ", ".join(["row long", "place int", "own boolean", *[f"{w} long" for w in WORDS]])


def suffixes_of(pieces: pd.DataFrame, span: int = SPAN) -> pd.DataFrame:
    """Suffixes at the starts of the wanted cells: leading bytes as words in byte order, and two hashes of the rest of the span.

    A window belongs to one stretch only: starts outside the piece's own are left out, so no place comes twice.
    """
    first, lo, hi = (pieces[c].to_numpy(np.int64) for c in ("first", "lo", "hi"))
    sizes = np.array([len(x) for x in pieces["bytes"]], np.int64)
    shift = np.cumsum(sizes) - sizes - first
    data = b"".join(pieces["bytes"])
    per_piece = np.array([len(x) for x in pieces["a"]], np.int64)
    piece = np.repeat(np.arange(len(pieces)), per_piece)
    a = np.maximum(np.concatenate(pieces["a"].tolist()).astype(np.int64), lo[piece])
    b = np.minimum(np.concatenate(pieces["b"].tolist()).astype(np.int64), hi[piece])
    counts = np.maximum(b - a + 1, 0)
    cell = np.repeat(np.arange(len(piece)), counts)
    place = np.arange(len(cell)) - np.repeat(np.cumsum(counts) - counts, counts) + a[cell]
    at = place + shift[piece[cell]]
    lead = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(8 * LEAD_WORDS)]
    words = lead.reshape(len(at), 8 * LEAD_WORDS).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    rest = [Hashes(data, seed).of(at + 8 * LEAD_WORDS, at + span) for seed in (1, 2)]
    columns = [*words.view(np.int64).T, *[r.view(np.int64) for r in rest]]
    own = np.concatenate(pieces["cell_own"].tolist()).astype(bool)[cell]
    row = pieces["row"].to_numpy()[piece[cell]]
    return pd.DataFrame({"row": row, "place": place.astype(np.int32), "own": own, **dict(zip(WORDS, columns, strict=True))})


def sorted_repeats(suffixes: DataFrame, name: str) -> DataFrame:
    """``(row, place)`` of the own suffixes that equal another one."""
    placed = suffixes.repartitionByRange(*WORDS, "row", "place")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not any(len(f) for f in frames):
            return
        bucket = pd.concat(frames, ignore_index=True)
        order = multikey_order([bucket[c].to_numpy() for c in (*WORDS, "row", "place")])
        bucket = bucket.iloc[order].reset_index(drop=True)
        values = bucket[WORDS].to_numpy()
        same = (values[1:] == values[:-1]).all(axis=1)
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        edge = np.zeros(len(bucket), np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        bucket = bucket.assign(twice=twice, edge=edge, bucket=TaskContext.get().partitionId())
        yield bucket[(bucket["twice"] & bucket["own"]) | (bucket["edge"] > 0)]

    # A bucket is one partition of the shuffle; what it yields are own repeats and two rows at its ends.
    found = stored(placed.mapInPandas(sort, f"{SUFFIX}, twice boolean, edge int, bucket int"), name)
    ends = found.where("edge > 0")
    value = F.struct(*WORDS)
    buckets = ends.groupBy("bucket").agg(
        F.max(F.when(F.col("edge").bitwiseAND(1) > 0, value)).alias("first"),
        F.max(F.when(F.col("edge").bitwiseAND(2) > 0, value)).alias("last"),
    )
    in_order = Window.orderBy("bucket")
    beside = buckets.select("bucket", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after"))
    across = (
        ends.join(F.broadcast(beside), "bucket")
        .where("own and not twice")
        .where(
            ((F.col("edge").bitwiseAND(1) > 0) & value.eqNullSafe(F.col("before")))
            | ((F.col("edge").bitwiseAND(2) > 0) & value.eqNullSafe(F.col("after")))
        )
    )
    return found.where("own and twice").select("row", "place").unionByName(across.select("row", "place"))


def _lists(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One array per column for each key; the rows of a key are bounded by its own text."""
    gathered = rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return gathered.select(
        *keys, *[F.col(f"_rows.{name}").alias(alias) for name, alias in columns.items()]
    )


def repeated_places(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """``(row, from, to)`` in bytes: stretches that cover exactly what repeated strings of ``span`` bytes cover.

    ``texts`` is a stored table ``(row, text)`` with unique rows. Stretches of a row may overlap.
    """

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["row"].to_numpy()
            data = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for start, end in chunks_of(np.array([len(d) for d in data], np.int64)):
                found = anchors_of(data[start:end], span)
                yield pd.DataFrame({"row": rows[start:end][found.pop("text")], "own": True, **found})

    hashed = texts.select("row", "text").mapInPandas(
        anchors, "row long, own boolean, at int, lo int, hi int, part long, whole long"
    )
    level1, needed = settle(hashed, "anchors")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "at", "lo", "hi", "own", "n", "first", "bytes"]
        for batch in batches:
            rows, held = [], 0
            for row, text, ats, los, his, owns in batch.itertuples(index=False):
                data = text.encode("utf-8", "surrogatepass")
                for at, lo, hi, own in zip(ats.tolist(), los.tolist(), his.tolist(), owns.tolist(), strict=True):
                    a, b = cut_of(at, lo, hi, len(data), span)
                    rows.append((row, at, lo, hi, own, len(data), a, data[a:b]))
                    held += b - a
                if held > 16 * CHUNK_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    wanted = _lists(needed, ["row"], {c: f"_{c}" for c in ("at", "lo", "hi", "own")})
    pieces = stored(
        texts.select("row", "text").join(wanted, "row").mapInPandas(
            cut, "row long, at int, lo int, hi int, own boolean, n int, first int, bytes binary"
        ),
        "pieces",
    )

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in chunks_of(np.array([len(x) for x in batch["bytes"]], np.int64)):
                part = batch.iloc[start:end]
                found = cells_of(part, span)
                of = found.pop("piece")
                yield pd.DataFrame({**{c: part[c].to_numpy()[of] for c in ("row", "at", "own")}, **found})

    cut_cells = pieces.mapInPandas(cells, "row long, at int, own boolean, part long, whole long, a int, b int")
    level2, open_cells = settle(cut_cells, "cells")
    lists = _lists(open_cells, ["row", "at"], {"a": "a", "b": "b", "own": "cell_own"})

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in chunks_of(np.array([len(x) for x in batch["bytes"]], np.int64)):
                yield suffixes_of(batch.iloc[start:end], span)

    level3 = sorted_repeats(pieces.join(lists, ["row", "at"]).mapInPandas(suffixes, SUFFIX), "suffixes")
    spans = (
        level1.where("settled").select("row", F.col("lo").alias("from"), (F.col("hi") + span).alias("to"))
        .unionByName(level2.where("settled and own").select("row", F.col("a").alias("from"), (F.col("b") + span).alias("to")))
        .unionByName(level3.select("row", F.col("place").alias("from"), (F.col("place") + span).alias("to")))
    )
    result = stored(spans, "spans")
    discard(level1, level2, pieces)
    return result


def union_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching intervals made one."""
    order = np.argsort(starts, kind="stable")
    a, b = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return list(zip(a[new].tolist(), b[np.append(new[1:], len(b)) - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, spans, kept)``: the maximal runs of removed bytes of every row, and the bytes that are left.

    A byte goes if a ``span``-byte string over it also starts anywhere else, in any row, the same one
    included; strings never cross rows and are judged on the texts as they are. So of copies none stays. A null text is
    empty; texts shorter than ``span`` stay whole; repeated rows are copies, also with equal or null ids. Bytes are
    cut without regard to characters. An empty table gives no rows. Other columns are ignored.
    """
    texts = stored(
        text_batches(docs).select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ),
        "texts",
    )
    places = repeated_places(texts, span)
    joined = texts.join(_lists(places, ["row"], {"from": "_from", "to": "_to"}), "row", "left")

    @F.pandas_udf("n_bytes long, spans array<struct<from: int, to: int>>, kept binary")
    def keep(rows: pd.Series, starting: pd.Series, ending: pd.Series) -> pd.DataFrame:
        out = []
        for text, first, last in zip(rows, starting, ending, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            runs = [] if first is None else union_of(first, last)
            ends = [0, *[b for _, b in runs]]
            starts = [*[a for a, _ in runs], len(data)]
            out.append((len(data), runs, b"".join([data[a:b] for a, b in zip(ends, starts, strict=True)])))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    return joined.select("id", keep("text", "_from", "_to").alias("k")).select("id", "k.n_bytes", "k.spans", "k.kept")
