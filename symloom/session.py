"""Session helpers: a local session for tests and bench, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_DEFAULT = "67108864b"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FOLDERS: dict[str, str] = {}


def build_session(
    app: str = "symloom", cpus: str = "8", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session, with ``shared`` as its shared folder. On a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hadoop_path(spark: SparkSession, path: str):
    """A path as Spark takes it: without a scheme it lies in the default file system. Gives path and file system."""
    jvm = spark.sparkContext._jvm
    plain = jvm.org.apache.hadoop.fs.Path(path)
    system = plain.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return plain.makeQualified(system.getUri(), system.getWorkingDirectory()), system


def default_filesystem(spark: SparkSession) -> str:
    """The URI of the file system that paths without a scheme lie in."""
    return spark._jsparkSession.sessionState().newHadoopConf().get("fs.defaultFS", "file:///")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: what the cluster names for checkpoints, else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder, removed when the session's process ends."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        path, system = hadoop_path(spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}")
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[application] = path.toString()
    return f"{_FOLDERS[application]}/{name}-{uuid.uuid4().hex}"


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table with at least one split per core.

    A file with one row group is one split. Only a table that gives fewer splits than there are cores is
    shuffled, by ``key``; a large table is read as it lies.
    """
    df = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder, so lost executors do not force a recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors redo nothing above.

    The shuffle files of the write are removed when it is done; only the table is read again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        path, system = hadoop_path(table.sparkSession, table.stored_path)
        system.delete(path, True)


def text_batches(df: DataFrame) -> DataFrame:
    """The table itself; from now on Arrow batches of its session hold 4 MB, where Spark's default of 64 MB was left.

    Workers hold a batch several times over, and texts may be long.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        conf.set(ARROW_BYTES, "4m")
    return df
