"""Token files as wavelet matrices: bit-planes with rank and select, several matrices in each compressed file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.shared import text_batches
from symloom.llm.tokens import encoder, vocabulary_size

#: A matrix takes documents until it holds this many tokens; its last document may go beyond.
MATRIX_TOKENS = 1 << 17
BLOCK_BYTES = 64

SCHEMA = (
    "part int, number int, first long, n_docs int, n_tokens int, doc_ids binary, no_id binary, doc_tokens binary, "
    "zeros array<int>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Plane b holds the bit of weight 2^b of each id, ordered by stable partitions on the planes above it.

    ``ranks`` count the ones before each block of 512 bits, so a rank reads one block and a select searches
    the counts and reads one block.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4").astype(np.int64) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
        row, zeros, planes, ranks = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
        blocks = max(1, -(-len(ids) // (8 * BLOCK_BYTES)))
        for b in range(bits - 1, -1, -1):
            ones = ((row >> row.dtype.type(b)) & row.dtype.type(1)).astype(bool)
            packed = np.zeros(blocks * BLOCK_BYTES, np.uint8)
            packed[: -(-len(ids) // 8)] = np.packbits(ones)
            per_block = np.bitwise_count(packed).reshape(blocks, BLOCK_BYTES).sum(axis=1, dtype=np.int64)
            split = len(ids) - int(per_block.sum())
            following = np.empty_like(row)
            np.compress(~ones, row, out=following[:split])
            np.compress(ones, row, out=following[split:])
            zeros.append(split)
            planes.append(packed.tobytes())
            ranks.append((np.cumsum(per_block) - per_block).astype("<u4").tobytes())
            row = following
        return cls(len(ids), zeros, planes, ranks)

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        block = np.minimum(at // (8 * BLOCK_BYTES), len(self.ranks[level]) - 1)
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK_BYTES)[block], axis=1)
        inside = np.arange(8 * BLOCK_BYTES) < (at - block * 8 * BLOCK_BYTES)[:, None]
        return self.ranks[level][block] + (bits & inside).sum(axis=1, dtype=np.int64)

    def _select(self, level: int, one: bool, nth: np.ndarray) -> np.ndarray:
        starts = np.arange(len(self.ranks[level])) * 8 * BLOCK_BYTES
        counts = self.ranks[level] if one else starts - self.ranks[level]
        block = np.searchsorted(counts, nth, side="right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK_BYTES)[block], axis=1)
        running = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int64)
        return block * 8 * BLOCK_BYTES + (running <= (nth - counts[block])[:, None]).sum(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at positions ``at``."""
        at, value = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            before = self._ones_before(level, at)
            at = np.where(bit == 1, zeros + before, at - before)
            value = (value << 1) | bit
        return value

    def _interval(self, symbol: int, upto: int) -> tuple[int, int]:
        low, high, bits = 0, upto, len(self.zeros)
        if symbol < 0 or symbol >> bits:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones_before(level, np.array([low, high])).tolist()
            low, high = (zeros + a, zeros + b) if symbol >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, upto: int) -> int:
        """How often ``symbol`` occurs before position ``upto``."""
        low, high = self._interval(symbol, upto)
        return high - low

    def locate(self, symbol: int) -> np.ndarray:
        """All positions of ``symbol``, ascending: selects lead from the last plane back to the first."""
        at = np.arange(*self._interval(symbol, self.n), dtype=np.int64)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(symbol >> (len(self.zeros) - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids: the planes' partitions undone from the last to the first."""
        bits = len(self.zeros)
        row = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            before = np.empty_like(row)
            before[~ones], before[ones] = row[: self.zeros[level]], row[self.zeros[level] :]
            row = before | (ones.astype(row.dtype) << row.dtype.type(bits - 1 - level))
        return row


def _rows_of(batches: Iterator[pd.DataFrame], tokenizer: str, end_id: int, bits: int) -> Iterator[pd.DataFrame]:
    part, number, first = TaskContext.get().partitionId(), 0, 0
    ids, lengths, held, size = [], [], [], 0

    def matrix() -> pd.DataFrame:
        flat = np.frombuffer(b"".join(held), "<u4")
        wavelet = WaveletMatrix.build(flat, bits)
        row = {
            "part": part, "number": number, "first": first, "n_docs": len(ids), "n_tokens": wavelet.n,
            "doc_ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
            "no_id": np.packbits([i is None for i in ids]).tobytes(),
            "doc_tokens": np.array(lengths, "<u4").tobytes(),
            "zeros": wavelet.zeros,
            "planes": [p.tobytes() for p in wavelet.planes],
            "ranks": [r.astype("<u4").tobytes() for r in wavelet.ranks],
        }
        return pd.DataFrame([row])

    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        numbers = [None if none else i for i, none in zip(batch["id"].tolist(), batch["no_id"].tolist(), strict=True)]
        for k, data in enumerate(encoder(tokenizer).encode(batch["text"].tolist())):
            ids.append(numbers[k])
            held.append(data + end)
            lengths.append(len(data) // 4 + 1)
            size += lengths[-1]
            if size >= MATRIX_TOKENS:
                yield matrix()
                number, first = number + 1, first + size
                ids, lengths, held, size = [], [], [], 0
    if ids:
        yield matrix()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of whole texts, each followed by ``end_id``, as files of wavelet matrices in ascending id order.

    A file is one range of document ids. Its rows are matrices of about ``MATRIX_TOKENS`` tokens, each with a directory of
    its documents and the number of tokens before it in the file; Parquet compresses them by zstd, and a
    query for one token reads whole matrices only. A null text is empty and gives the end id alone. Null ids
    come first; rows with equal ids are ordered by text hash, equal rows stay in reading order, each a
    document of its own. An empty table gives files without rows. Other columns are ignored. There are as many
    planes as the largest id needs, of ``vocabulary`` ids or of the tokenizer's own; an id beyond stops the job.
    """
    rows = text_batches(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keyed = rows.select("id", "no_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.desc("no_id"), F.asc("id"), F.asc("_hash"), F.asc("_tie")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "no_id", "text")
    bits = max(1, int(max(vocabulary or vocabulary_size(tokenizer), end_id + 1) - 1).bit_length())
    placed.mapInPandas(lambda batches: _rows_of(batches, tokenizer, end_id, bits), SCHEMA).write.option(
        "compression", "zstd"
    ).parquet(path)


def _matrices(batch: pd.DataFrame) -> Iterator[tuple]:
    for row in batch.itertuples(index=False):
        wavelet = WaveletMatrix(row.n_tokens, row.zeros, row.planes, row.ranks)
        lengths = np.frombuffer(row.doc_tokens, "<u4").astype(np.int64)
        missing = np.unpackbits(np.frombuffer(row.no_id, np.uint8), count=row.n_docs).astype(bool)
        numbers = pd.array(np.frombuffer(row.doc_ids, "<i8"), dtype="Int64")
        numbers[missing] = pd.NA
        yield row, wavelet, numbers, lengths


def file_starts(files: DataFrame) -> DataFrame:
    """``(part, before)``: tokens in all files before each file. One row per file."""
    from pyspark.sql.window import Window

    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The matrices of ``write_token_files``, a row each."""
    return spark.read.schema(SCHEMA).parquet(path)


def documents_of(files: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document: its ids as little-endian unsigned 32-bit integers."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, wavelet, numbers, lengths in _matrices(batch):
                ids = wavelet.tokens().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pd.DataFrame({
                    "part": row.part, "id": numbers, "start": starts + row.first, "n_tokens": lengths,
                    "ids": [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                })

    found = files.mapInPandas(decode, "part int, id long, start long, n_tokens long, ids binary")
    located = found.join(F.broadcast(file_starts(files)), "part")
    return located.select("id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_counts(files: DataFrame, symbols: list[int]) -> DataFrame:
    """``(symbol, n)``: how often each of a short list of ids occurs, by rank alone."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, wavelet, _, _ in _matrices(batch):
                yield pd.DataFrame({"symbol": symbols, "n": [wavelet.rank(s, wavelet.n) for s in symbols]})

    return files.mapInPandas(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def occurrences(files: DataFrame, symbols: list[int]) -> DataFrame:
    """``(symbol, id, place)``: every document and place in it where one of a short list of ids stands, by select."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, wavelet, numbers, lengths in _matrices(batch):
                starts = np.cumsum(lengths) - lengths
                for symbol in symbols:
                    at = wavelet.locate(symbol)
                    doc = np.searchsorted(starts, at, side="right") - 1
                    yield pd.DataFrame({"symbol": symbol, "id": numbers[doc], "place": at - starts[doc]})

    return files.mapInPandas(find, "symbol long, id long, place long")
