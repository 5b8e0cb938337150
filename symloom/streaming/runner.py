"""Run a stream until what is available is done, with Spark's own state store for keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from symloom.session import hadoop_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every available micro-batch to ``process``. A batch that is run again has the same number."""
    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class KeyedStream:
    """Rows through a stateful processor per key; state in RocksDB under the checkpoint, output in a file sink.

    A query that is started again goes on from the last committed batch: Spark restores the state of that batch, and the sink
    ignores files of batches that were not committed. State is spread over ``spark.sql.shuffle.partitions``
    partitions, as set at the first run. All rows of one key in one micro-batch are held by one task, so bound the
    micro-batch at the source (``maxFilesPerTrigger`` and the like).
    """

    def __init__(self, spark: SparkSession, root: str, key: str, output: str):
        self.spark, self.key, self.output = spark, key, output
        self._checkpoint, self._sink = f"{root.rstrip('/')}/checkpoint", f"{root.rstrip('/')}/output"

    def run_rows(self, rows: DataFrame, processor: StatefulProcessor, timers: bool, by: list[str] = ()) -> None:
        made = rows.groupBy(self.key).transformWithState(processor, self.output, "Append", "ProcessingTime" if timers else "None")
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKSDB)
        try:
            # The query works on a copy of the session, made here.
            query = (
                made.writeStream.format("parquet")
                .option("path", self._sink)
                .option("checkpointLocation", self._checkpoint)
                .partitionBy(*by)
                # With timers Spark always has another batch to run, so each call runs one.
                .trigger(**({"once": True} if timers else {"availableNow": True}))
                .start()
            )
        finally:
            self.spark.conf.set(PROVIDER, before)
        query.awaitTermination()

    def _holds(self, path: str) -> bool:
        folder, system = hadoop_path(self.spark, path)
        return system.exists(folder) and len(system.listStatus(folder)) > 0

    def written(self) -> DataFrame:
        """What the processor gave so far."""
        reader = self.spark.read.schema(self.output)
        if not self._holds(f"{self._sink}/_spark_metadata"):
            return self.spark.createDataFrame([], self.output)
        return reader.parquet(self._sink)

    def variable(self, name: str, schema: str) -> DataFrame:
        """The key and the fields of a state variable, as of the last committed batch."""
        if not self._holds(f"{self._checkpoint}/commits"):
            return self.spark.createDataFrame([], schema)
        state = self.spark.read.format("statestore").option("path", self._checkpoint).option("stateVarName", name).load()
        held = "value" if "value" in state.columns else "list_element"
        return state.select(f"key.{self.key}", f"{held}.*")
