"""Exact top-k by inner product: vectors in buckets of like length, pruned by length or by coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.shared import stored

BUCKET = 1024
#: Queries that travel to the tasks at once, and the longest vectors that give their first thresholds.
QUERIES_PER_PASS = 16384
SEED_VECTORS = 512
#: A bucket is pruned by coordinates where a query's cosine threshold is this high, by length otherwise.
COORDINATES_FROM = 0.75
FOCUS = 4
NO_ID = (1 << 63) - 1
#: Scores that no long holds count as these, below and above all others; in the result they are an error.
TOO_LOW, TOO_HIGH = 2 - (1 << 63), (1 << 63) - 1
EMPTY = TOO_LOW - 1


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(row, id, v, norm)`` of the rows that take part: ``floor(scale * x)`` of every component x, as double, which is exact."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    # From 2^53 on every double is whole.
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    whole = F.transform(x, lambda e: floor(e * scale))
    rows = vectors.where(F.col(vector_col).isNotNull()).where(sound)
    return (
        rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole.alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))
        .withColumn("row", F.monotonically_increasing_id())
    )


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def products(q: np.ndarray, q_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
    """All exact inner products of whole numbers, as int64.

    The lengths bound every partial sum: it is exact in doubles below 2^52 and in int64 below 2^62. Pairs beyond
    are multiplied in Python's integers; what no long holds is ``TOO_LOW`` or ``TOO_HIGH``.
    """
    if q_norm.max(initial=0) * v_norm.max(initial=0) < 2.0**52:
        return (q @ v.T).astype(np.int64)
    limit = 2.0**62
    scores = np.clip(q, -limit, limit).astype(np.int64) @ np.clip(v, -limit, limit).astype(np.int64).T
    for i, j in zip(*np.nonzero(q_norm[:, None] * v_norm[None, :] >= limit), strict=True):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], v[j], strict=True))
        scores[i, j] = min(max(exact, TOO_LOW), TOO_HIGH)
    return scores


class Best:
    """The k best candidates of each query so far, by score and then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), EMPTY, np.int64)
        self.ids = np.full((queries, k), NO_ID, np.int64)

    def threshold(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[query], scores)), np.concatenate((self.ids[query], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


def search_bucket(
    best: Best, floor: np.ndarray, q: np.ndarray, q_norm: np.ndarray, q_rows: np.ndarray,
    v: np.ndarray, v_norm: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray,
) -> None:
    """One bucket, longest vector first, against all queries. ``floor`` is a proven lower bound of the k-th score.

    With the longest length in the bucket, a query's k-th score so far is a threshold on the cosine. Above 1 nothing in
    the bucket can enter. Where it is high, each vector's coordinates must lie in the ranges that such a cosine allows
    at the query's largest coordinates; where it is low, only vectors long enough are kept. What is
    left is verified by its exact product.
    """
    need = np.maximum(best.threshold(), floor).astype(np.float64)
    reach = q_norm * v_norm[0]
    # A part in 10^9 covers rounding; ties with the threshold stay.
    active = reach * (1 + 1e-9) + 1e-6 >= need
    if not active.any():
        return
    cosine = np.divide(need, reach, out=np.full(len(need), -1.0), where=reach > 0)
    by_coordinates = active & (cosine >= COORDINATES_FROM)
    for i in np.flatnonzero(by_coordinates):
        unit = q[i] / q_norm[i]
        t = min(cosine[i] * (1 - 1e-9), 1.0)
        keep = np.ones(len(v), bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt((1 - t * t) * max(0.0, 1 - unit[f] * unit[f])) + 1e-6
            share = v[:, f] / np.maximum(v_norm, 1e-300)
            # A shorter vector needs a higher cosine, so the bucket's threshold holds for each of its vectors.
            keep &= share >= unit[f] * t - spread if unit[f] >= 0 else share <= unit[f] * t + spread
        kept = np.flatnonzero(keep & (v_rows != q_rows[i]))
        scores = products(q[i : i + 1], q_norm[i : i + 1], v[kept], v_norm[kept])[0]
        entering = scores >= need[i]
        if entering.any():
            best.add(i, scores[entering], v_ids[kept[entering]])
    rest = np.flatnonzero(active & ~by_coordinates)
    for at in range(0, len(rest), 1024):
        block = rest[at : at + 1024]
        least = np.divide(need[block], q_norm[block], out=np.full(len(block), -1.0), where=q_norm[block] > 0).min()
        long_enough = int(np.searchsorted(-v_norm, -(least * (1 - 1e-9) - 1e-6), side="right"))
        if long_enough == 0:
            continue
        scores = products(q[block], q_norm[block], v[:long_enough], v_norm[:long_enough])
        scores[q_rows[block][:, None] == v_rows[None, :long_enough]] = EMPTY
        hit = scores >= np.maximum(need[block], EMPTY + 1)[:, None]
        for k in np.flatnonzero(hit.any(axis=1)):
            best.add(int(block[k]), scores[k, hit[k]], v_ids[:long_enough][hit[k]])


def top_k(
    vectors: DataFrame, every: int, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of every query with all other rows.

    Queries are the rows whose id is divisible by ``every``. Rows whose vector is null or holds a null or
    non-finite component take no part. Components of any size count; a score in the result that no long holds is an
    error, as is a vector whose length no double holds. Of vectors of different lengths the shorter is filled with zeros. Ties go to the smaller id; a null id is never a query
    and comes last among ties. A row is told from others by itself, not by its id, so rows with equal ids find
    each other. Fewer than k candidates give fewer rows, an empty table none. Other columns are ignored.

    Vectors are range-partitioned by length, each partition is cut into buckets. At most ``QUERIES_PER_PASS``
    queries travel to the tasks; more take further passes over the vectors, one after the other.
    """
    spark = vectors.sparkSession
    ready = stored(integer_vectors(vectors, scale, id_col, vector_col), "vectors")
    queries = ready.where((F.col("id") % every == 0) & (F.col("id") != NO_ID))
    facts = ready.agg(F.max(F.size("v")).alias("width"), F.max("norm").alias("norm")).first()
    n_queries = queries.count()
    width = facts["width"] or 0
    if not np.isfinite(facts["norm"] or 0):
        raise ValueError(f"{vector_col} holds a vector too long for inner products")
    longest = ready.orderBy(F.desc("norm"), "row").limit(SEED_VECTORS).collect()
    ranged = ready.repartitionByRange(F.desc("norm"), F.asc("row"))
    passes = -(-n_queries // QUERIES_PER_PASS)
    found = []
    for number in range(passes):
        mine = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == number)
        block = mine.select("row", "id", "v", "norm").toArrow()
        sent = spark.sparkContext.broadcast((
            block["row"].to_numpy(), block["id"].to_numpy(), _matrix(block["v"].to_pylist(), width),
            block["norm"].to_numpy(), np.array([r["row"] for r in longest], np.int64),
            _matrix([r["v"] for r in longest], width), np.array([r["norm"] for r in longest], np.float64),
        ))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            q_rows, q_ids, q, q_norm, top_rows, top, top_norm = sent.value
            floor = np.full(len(q), EMPTY, np.int64)
            if len(top) > k:
                for at in range(0, len(q), 1024):
                    scores = products(q[at : at + 1024], q_norm[at : at + 1024], top, top_norm)
                    scores[q_rows[at : at + 1024, None] == top_rows[None, :]] = EMPTY
                    floor[at : at + 1024] = np.partition(scores, -k, axis=1)[:, -k]
            best = Best(len(q), k)
            for batch in batches:
                batch = batch.sort_values(["norm", "row"], ascending=[False, True])
                for at in range(0, len(batch), BUCKET):
                    part = batch.iloc[at : at + BUCKET]
                    search_bucket(
                        best, floor, q, q_norm, q_rows, _matrix(part["v"].tolist(), width),
                        part["norm"].to_numpy(), part["row"].to_numpy(), part["id"].to_numpy(),
                    )
            i, j = np.nonzero(best.scores > EMPTY)
            yield pd.DataFrame(
                {"query_row": q_rows[i], "query_id": q_ids[i], "vec_id": best.ids[i, j], "score": best.scores[i, j]}
            )

        local = ranged.mapInPandas(search, "query_row long, query_id long, vec_id long, score long")
        by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        ranked = local.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        unfit = F.col("score").isin(TOO_LOW, TOO_HIGH)
        error = F.raise_error(F.concat(F.lit("no long holds a score of query "), F.col("query_id").cast("string"))).cast("long")
        found.append(stored(ranked.withColumn("score", F.when(unfit, error).otherwise(F.col("score"))), "top-k"))
        sent.unpersist()
    if not found:
        found = [ready.limit(0).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("row").alias("score"), F.lit(0).alias("rank"))]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    vec_id = F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id")
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), vec_id, "score")
