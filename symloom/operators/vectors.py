"""A stored vector index with proven bounds: vectors lie by centroid, and a search reads the cells that can hold a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.operators.search import NEAREST, QUERIES_PER_BLOCK, VECTORS_PER_BLOCK, compared_blocks, first_by_distance
from symloom.session import checkpointed

#: At most so many cells, about a vector's square root of all; centroids are fitted on this many vectors for each.
MOST_CELLS, SAMPLE_PER_CELL, FIT_ROUNDS = 1024, 32, 5
#: Bounds are widened by this part of the lengths at hand, for rounding.
SLACK = 1e-9


BLOCKS = "workspace string, symbol_keys array<string>, symbol_values array<double>, cell int"


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float64) if len(rows) else np.zeros((0, 1))


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(flat) // max(1, batch.num_rows))


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (vectors * vectors).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None] - 2 * vectors @ centroids.T
    return np.sqrt(np.maximum(square, 0))


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of the sample after a few rounds; empty cells keep their centroid."""
    centroids = sample[:cells].copy()
    for _ in range(FIT_ROUNDS):
        own = _distances(sample, centroids).argmin(axis=1)
        for cell in np.unique(own):
            centroids[cell] = sample[own == cell].mean(axis=0)
    return centroids


class VectorIndex:
    """Folders ``cell=<n>`` of blocks of vectors, and one row per workspace and cell with what bounds its distances.

    The centroids come from a sample of at most ``MOST_CELLS * SAMPLE_PER_CELL`` vectors, those with the lowest hashes of their ids;
    every vector is indexed. By the triangle inequality a vector of a cell is no nearer to a query than the query's
    distance to the centroid less the cell's radius, nor than the cell's inner radius less that distance. So the k nearest are
    exact, whatever the centroids are; these only tell how many cells are read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, embeddings: DataFrame) -> None:
        """Index ``(workspace, symbol_id, embedding)``; rows without an embedding are left out."""
        rows = checkpointed(
            embeddings.where(F.col("embedding").isNotNull()).select("workspace", "symbol_id", F.col("embedding").cast("array<double>").alias("v"))
        )
        cells = int(min(MOST_CELLS, max(1, np.ceil(np.sqrt(rows.count())))))
        drawn = rows.orderBy(F.xxhash64("symbol_id"), "symbol_id").limit(cells * SAMPLE_PER_CELL).select("v").collect()
        sample = _matrix([r["v"] for r in drawn])
        centroids = fit_centroids(sample, cells) if len(drawn) else sample

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                apart = _distances(_vectors(batch, "v"), centroids)
                own = apart.argmin(axis=1)
                near = apart[np.arange(len(own)), own]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(near)], [*batch.schema.names, "cell", "away"])

        placed = checkpointed(rows.mapInArrow(place, "workspace string, symbol_id string, v array<double>, cell int, away double"))
        held = placed.groupBy("workspace", "cell").agg(
            F.count(F.lit(1)).alias("rows"), F.min("away").alias("inner"), F.max("away").alias("radius")
        )
        held.coalesce(1).write.parquet(f"{self.path}/cells")
        kept = [(n, c.tolist()) for n, c in enumerate(centroids)]
        self.spark.createDataFrame(kept, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        blocks = F.ceil(F.col("rows") / VECTORS_PER_BLOCK).cast("int")
        numbered = placed.join(held.select("workspace", "cell", blocks.alias("blocks")), ["workspace", "cell"])
        block = F.pmod(F.xxhash64("symbol_id"), F.col("blocks")).cast("int")
        row = F.struct("symbol_id", "v")
        (
            numbered.groupBy("cell", "workspace", block.alias("block"))
            .agg(F.collect_list(row).alias("_rows"))
            .select(
                "cell", "workspace", F.transform("_rows", lambda r: r["symbol_id"]).alias("symbol_keys"),
                F.flatten(F.transform("_rows", lambda r: r["v"])).alias("symbol_values"),
            )
            .write.partitionBy("cell").parquet(f"{self.path}/blocks")
        )

    def cells(self) -> DataFrame:
        """``(workspace, cell, rows, inner, radius)``."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def bounded(self, queries: DataFrame) -> DataFrame:
        """``(workspace, query_id, embedding, cell, rows, least)``: no vector of the cell is nearer than ``least``. A row per query and
        cell of its workspace, at most ``MOST_CELLS`` for each."""
        centroids = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        points = _matrix([r["centroid"] for r in centroids])
        query_type = queries.schema["query_id"].dataType.simpleString()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _vectors(batch, "embedding")
                apart = _distances(v, points) if len(points) else np.zeros((len(v), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * apart.shape[1], pa.int32()), pa.array(apart.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "apart"])

        asked = queries.where(F.col("embedding").isNotNull()).select("workspace", "query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        schema = f"workspace string, query_id {query_type}, embedding array<double>, apart array<double>"
        joined = asked.mapInArrow(measure, schema).join(self.cells(), "workspace")
        far = F.get("apart", F.col("cell"))
        least = F.greatest(F.lit(0.0), far - F.col("radius"), F.col("inner") - far) - SLACK * (far + F.col("radius") + 1)
        return joined.select("workspace", "query_id", "embedding", "cell", "rows", least.alias("least"))

    def _compared(self, visits: DataFrame, k: int, query_type: str) -> DataFrame:
        """The k nearest of each query in each cell that it visits. Only the folders of visited cells are read."""
        # At most ``MOST_CELLS`` numbers.
        numbers = sorted(r["cell"] for r in visits.select("cell").distinct().collect())
        counts = visits.groupBy("workspace", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).cast("int").alias("blocks"))
        number = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
        asked = visits.join(counts, ["workspace", "cell"]).groupBy("workspace", "cell", number.alias("block")).agg(
            F.collect_list(F.struct("query_id", "embedding")).alias("_rows")
        )
        asked = asked.select(
            "workspace", "cell", F.transform("_rows", lambda r: r["query_id"]).alias("query_keys"),
            F.flatten(F.transform("_rows", lambda r: r["embedding"])).alias("query_values"),
        )
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks").where(F.col("cell").isin(numbers))
        return compared_blocks(blocks.join(asked, ["workspace", "cell"]), k, query_type)

    def visits(self, queries: DataFrame, k: int = NEAREST) -> tuple[DataFrame, DataFrame]:
        """The cells that each query reads ``(workspace, query_id, cell, least)``, and its k nearest of them, before they are ranked.

        First the cells of lowest bounds that hold k vectors together; their k-th distance then proves all cells out whose
        bound is above it, and the others are read as well.
        """
        query_type = queries.schema["query_id"].dataType.simpleString()
        bounded = checkpointed(self.bounded(queries))
        query = ["workspace", "query_id"]
        before = Window.partitionBy(*query).orderBy("least", "cell").rowsBetween(Window.unboundedPreceding, -1)
        near = bounded.withColumn("_held", F.coalesce(F.sum("rows").over(before), F.lit(0))).where(F.col("_held") < k).drop("_held")
        near = checkpointed(near)
        first = checkpointed(first_by_distance(self._compared(near, k, query_type), k))
        worst = first.groupBy(*query).agg(F.max("distance").alias("_worst"), F.count(F.lit(1)).alias("_n"))
        open_ = (F.col("_n") < k) | (F.col("least") <= F.col("_worst"))
        rest = bounded.join(near.select(*query, "cell"), [*query, "cell"], "left_anti").join(worst, query).where(open_)
        rest = checkpointed(rest.drop("_worst", "_n"))
        found = first.drop("rank").unionByName(self._compared(rest, k, query_type))
        read = near.unionByName(rest).select(*query, "cell", "least")
        return read, found

    def nearest(self, queries: DataFrame, k: int = NEAREST) -> DataFrame:
        """The k nearest vectors of each query's workspace, as ``nearest_symbols`` gives them; ties go to the lower id."""
        return first_by_distance(self.visits(queries, k)[1], k)
