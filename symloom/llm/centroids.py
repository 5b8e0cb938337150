"""Centroid clustering of integer vectors: n-simplex projection filters centroids before exact comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.shared import stored

#: A pivot must rise this part of the largest pivot distance above the span of those before it.
LEAST_RISE = 1e-3
ROWS_AT_ONCE = 4096
PAIRS_AT_ONCE = 1 << 16
#: Distances of components up to this size are exact in int64 at any width that a row holds.
SMALL = 1 << 20
LONGEST = (1 << 63) - 1


def integer_vectors(
    vectors: DataFrame, width: int, scale: int, seed: str, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id, v, hash)`` of the rows that take part: ``floor(scale * x)`` of every component x, as double.

    A row takes part when its vector has ``width`` components, none of them null or non-finite. ``hash`` orders the
    first centroids. A component that no long holds stops the job.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return vectors.where(F.size(vector_col) == width).where(sound).select(
        F.col(id_col).alias("id"),
        F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"),
        F.sha2(text, 256).alias("hash"),
    )


def squared_distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the other vector of the same place, as int64.

    Components beyond ``SMALL`` are subtracted and multiplied as Python's integers; a distance that no long holds
    counts as the largest long, which ``clustered`` takes for an error.
    """
    if max(np.abs(rows).max(initial=0), np.abs(others).max(initial=0)) <= SMALL:
        gaps = rows - others
        return np.einsum("ij,ij->i", gaps, gaps)
    gaps = rows.astype(object) - others.astype(object)
    exact = (gaps * gaps).sum(axis=1) if gaps.shape[1] else np.zeros(len(gaps), object)
    return np.array([min(int(d), LONGEST) for d in exact], np.int64)


class Simplex:
    """Apexes over a base simplex of pivots.

    The pivots lie in a space of as many dimensions as they span. A vector's distances to them give its apex:
    ``flat``, its coordinates in that space, and its height above it. Between the apexes of two vectors, the heights
    taken on one side give a lower bound of the vectors' distance, on opposite sides an upper bound.

    Distances enter as doubles, so each apex has an error; bounds are widened by it.
    """

    def __init__(self, pivots: np.ndarray):
        """Takes the pivots that rise clearly above the span of those before them."""
        points = pivots.astype(np.float64)
        apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) if len(points) else np.zeros((0, 0))
        largest = apart.max(initial=0.0)
        used, base = ([0] if len(points) else []), np.zeros((0, 0))
        for number in range(1, len(points)):
            gaps = points[used[1:]] - points[0]
            gram = gaps @ (points[number] - points[0])
            flat = np.linalg.solve(base, gram) if len(base) else np.zeros(0)
            rise = apart[0, number] ** 2 - flat @ flat
            if rise <= (LEAST_RISE * largest) ** 2:
                continue
            grown = np.zeros((len(base) + 1, len(base) + 1))
            grown[: len(base), : len(base)] = base
            grown[-1, :-1], grown[-1, -1] = flat, np.sqrt(rise)
            base = grown
            used.append(number)
        self.used, self.base, self.largest = used, base, largest
        self.solve = np.linalg.inv(base) if len(base) else np.zeros((0, 0))
        # How far an error of the squared distances can grow in ``flat``.
        self.growth = float(np.abs(self.solve).sum())
        self.squares = (base * base).sum(axis=1) if len(base) else np.zeros(0)

    def apexes(self, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(flat, low, high)`` from squared distances to the pivots used: coordinates, and bounds of the height, both
        widened by what rounding may do; ``flat`` is off by no more than the last column of itself."""
        squared = squared.astype(np.float64)
        first = squared[:, 0] if squared.shape[1] else np.zeros(len(squared))
        gram = (first[:, None] + self.squares[None] - squared[:, 1:]) / 2
        flat = gram @ self.solve.T
        scale = squared.max(axis=1, initial=0.0) + self.largest**2
        off = 1e-13 * scale * self.growth
        height = first - (flat * flat).sum(axis=1)
        slack = 1e-12 * scale + 2 * np.sqrt(scale) * off + off * off
        low, high = np.sqrt(np.maximum(height - slack, 0)), np.sqrt(np.maximum(height + slack, 0))
        return np.column_stack((flat, off)), low, high


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between all vectors of two sets of apexes."""
    (a_flat, a_low, a_high), (b_flat, b_low, b_high) = a, b
    gap2 = np.zeros((len(a_flat), len(b_flat)))
    for axis in range(a_flat.shape[1] - 1):
        step = a_flat[:, axis, None] - b_flat[None, :, axis]
        gap2 += step * step
    gap = np.sqrt(gap2)
    off = a_flat[:, -1, None] + b_flat[None, :, -1]
    near = np.maximum(gap - off, 0)
    rise = np.maximum(0, np.maximum(a_low[:, None] - b_high[None], b_low[None] - a_high[:, None]))
    fall = a_high[:, None] + b_high[None]
    return np.sqrt(near * near + rise * rise) * (1 - 1e-12), np.sqrt((gap + off) ** 2 + fall * fall) * (1 + 1e-12)


def nearest(vectors: np.ndarray, apexes: tuple, centroids: np.ndarray, centroid_apexes: tuple) -> tuple:
    """``(number, squared distance, compared)`` of each vector's nearest centroid; ties go to the smaller number.

    Centroids whose lower bound exceeds the smallest upper bound are out. Of the others, the one with the smallest
    lower bound is compared first, exactly; then those whose lower bound does not exceed that distance.
    """
    low, high = bounds(apexes, centroid_apexes)
    every = np.arange(len(vectors))
    first = low.argmin(axis=1)
    exact = np.full(low.shape, LONGEST, np.int64)
    exact[every, first] = squared_distances(vectors, centroids[first])
    reach = np.minimum(high.min(axis=1), np.sqrt(exact[every, first].astype(np.float64)) * (1 + 1e-12))
    open_ = low <= reach[:, None]
    open_[every, first] = False
    rows, numbers = np.nonzero(open_)
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        r, c = rows[at : at + PAIRS_AT_ONCE], numbers[at : at + PAIRS_AT_ONCE]
        exact[r, c] = squared_distances(vectors[r], centroids[c])
    # A centroid that was not compared is farther than the first one.
    best = exact.argmin(axis=1)
    return best, exact[every, best], open_.sum(axis=1) + 1


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


class Clusters:
    """Vectors with their cached pivot distances, and the centroids so far."""

    def __init__(self, vectors: DataFrame, width: int, count: int):
        self.spark, self.width = vectors.sparkSession, width
        ready = stored(vectors, "vectors")
        first = ready.orderBy("hash", "v").limit(count).collect()
        self.centroids = [[int(x) for x in row["v"]] for row in first]
        start = np.array(self.centroids, np.int64).reshape(-1, width)
        self.simplex = Simplex(start)
        self.pivots = start[self.simplex.used]
        self.rows = stored(self._with_distances(ready), "pivot-distances") if first else ready

    def _with_distances(self, ready: DataFrame) -> DataFrame:
        """Each vector's squared distances to the pivots, found once for all rounds."""
        pivots, width = self.pivots, self.width

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                v = _matrix(batch.column("v"), width, np.int64)
                squared = np.stack([squared_distances(v, np.broadcast_to(p, v.shape)) for p in pivots], axis=1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, squared.size + 1, len(pivots)), pa.int32()), pa.array(squared.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], ["id", "v", "pivots"])

        kind = ready.schema["id"].dataType.simpleString()
        return ready.select("id", "v").mapInArrow(measure, f"id {kind}, v array<long>, pivots array<long>")

    def _assigner(self):
        """A function of a batch: its vectors, and their nearest of the centroids as they are now."""
        simplex, pivots, width = self.simplex, self.pivots, self.width
        centroids = np.array(self.centroids, np.int64).reshape(-1, width)
        squared = np.stack([squared_distances(centroids, np.broadcast_to(p, centroids.shape)) for p in pivots], axis=1)
        apexes = simplex.apexes(squared)

        def assign(batch: pa.RecordBatch) -> tuple:
            v = _matrix(batch.column("v"), width, np.int64)
            own = simplex.apexes(_matrix(batch.column("pivots"), len(pivots), np.int64))
            return v, *nearest(v, own, centroids, apexes)

        return assign

    def move(self) -> None:
        """One round: every vector goes to its nearest centroid, then non-empty centroids become their vectors' floored means.

        A task gives one row of sums per centroid; the driver gets as many rows as centroids have components.
        """
        assign, width, count = self._assigner(), self.width, len(self.centroids)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, sizes = np.zeros((count, width), object), np.zeros(count, np.int64)
            for batch in _pieces(batches):
                v, best, _, _ = assign(batch)
                wide = object if np.abs(v).max(initial=0) > 1 << 48 else np.int64
                for number in np.unique(best):
                    mine = v[best == number].astype(wide, copy=False)
                    sums[number] += mine.sum(axis=0).astype(object)
                    sizes[number] += len(mine)
            held = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(held, width), pa.int32()), pa.array(np.tile(np.arange(width), len(held)), pa.int32()),
                    pa.array([str(x) for x in sums[held].ravel()], pa.string()), pa.array(np.repeat(sizes[held], width), pa.int64()),
                ],
                ["number", "axis", "part", "rows"],
            )

        parts = self.rows.select("v", "pivots").mapInArrow(add_up, "number int, axis int, part string, rows long")
        totals = parts.groupBy("number", "axis").agg(
            F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")
        )
        for row in totals.collect():
            self.centroids[row["number"]][row["axis"]] = int(row["total"]) // row["rows"]

    def assigned(self) -> DataFrame:
        """``(id, number, distance, compared)``: every vector's centroid and squared distance, and how many centroids the
        bounds left to compare."""
        assign = self._assigner()

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                _, best, distance, compared = assign(batch)
                columns = [batch.column("id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(compared, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "number", "distance", "compared"])

        kind = self.rows.schema["id"].dataType.simpleString()
        return self.rows.mapInArrow(emit, f"id {kind}, number int, distance long, compared int")


def clustered(
    vectors: DataFrame, count: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(id, cluster, distance, compared, cluster_inertia, inertia, centroid_sha256)``, one row per vector that takes part.

    The first centroids are the vectors whose ids hash lowest (equal ids: the smaller vector first); fewer vectors
    than ``count`` give fewer centroids. Each round assigns all vectors and floors the means; then they are assigned once
    more. The same distance to several centroids goes to the smaller number, also where centroids are equal.

    Vectors that are null, of another width, or hold a null or non-finite component take no part. Rows with
    equal or null ids are vectors of their own; the null id hashes as an empty text. An empty table gives no rows. Components
    of any size up to a long are exact; a distance or inertia that no long holds stops the job. Other columns are ignored.
    """
    state = Clusters(integer_vectors(vectors, width, scale, seed, id_col, vector_col), width, count)
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    if not state.centroids:
        schema = f"id {kind}, cluster int, distance long, compared int, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        state.move()
    error = F.raise_error(F.concat(F.lit("no long holds the distance of vector "), F.col("id").cast("string"))).cast("long")
    found = stored(
        state.assigned().withColumn("distance", F.when(F.col("distance") == LONGEST, error).otherwise(F.col("distance"))),
        "assigned",
    )
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in state.centroids]
    # One row per centroid.
    sums = found.groupBy("number").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    digest = F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("number") + 1)
    return found.join(F.broadcast(sums), "number").select(
        "id", F.col("number").alias("cluster"), "distance", "compared", "cluster_inertia", "inertia", digest.alias("centroid_sha256")
    )
