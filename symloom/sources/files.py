"""File scans: directory trees listed and read by tasks, level by level.

Spark's ``binaryFile`` source drops empty files and names that start with ``_`` or ``.``, which an index
of source trees must hold; and a recursive listing on the driver would pass every path through it.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import paths
from symloom.session import checkpointed, default_filesystem

READ_BYTES = 4 * 1024 * 1024
ENTRIES_PER_BATCH = 10000
DIRECTORIES_PER_TASK = 200
FILES_PER_TASK = 2000


# Hadoop's names of file systems and the names they go by here.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def open_filesystem(path: str, opened: dict | None = None, default: str = "file:///") -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it; ``opened`` keeps it for the next path.

    A URI is taken as Spark takes it: the part after the authority is a plain path, not percent-encoded, and a path
    without a scheme lies in the ``default`` file system. A scheme that is not known here is an error.
    """
    opened = {} if opened is None else opened
    if ":/" not in path.split("/", 1)[0] + "/":
        path = f"{default.rstrip('/')}{path}" if "://" in default else f"file://{path}"
    scheme, _, rest = path.partition(":")
    rest = rest[2:] if rest.startswith("//") else rest
    if scheme not in SCHEMES:
        raise ValueError(f"no file system for {path!r}")
    authority, _, inner = rest.partition("/")
    top = f"{SCHEMES[scheme]}://{authority}/"
    if top not in opened:
        opened[top] = (fs.LocalFileSystem(), "/") if scheme == "file" else fs.FileSystem.from_uri(top)
    system, base = opened[top]
    return system, f"{base.rstrip('/')}/{inner}"


def _entries(directory: str, system: fs.FileSystem) -> Iterator[tuple[str, bool]]:
    """Path of each folder and regular file of a directory, and whether it is a folder.

    A local directory is read entry by entry, whatever its size. Links to folders are left out; links to nowhere are
    listed, and fail to be read. Other file systems give their listing of a directory as one list.
    """
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(directory, recursive=False)):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield info.path, info.type == fs.FileType.Directory
        return
    with os.scandir(directory) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, True
            elif entry.is_file() or (entry.is_symlink() and not os.path.exists(entry.path)):
                yield entry.path, False


def _lister(default: str):
    def list_children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict = {}
        for batch in batches:
            for directory in batch["path"]:
                system, inner = open_filesystem(directory, opened, default)
                scheme = directory.removesuffix(inner)
                rows = []
                for path, is_dir in _entries(inner, system):
                    rows.append((scheme + path, is_dir))
                    if len(rows) == ENTRIES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["path", "is_dir"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "is_dir"])

    return list_children


def _spread(rows: DataFrame, rows_per_task: int) -> DataFrame:
    """An explicit number of tasks: paths are short, but the work behind each is not."""
    count = rows.count()
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(min(count, slots), count // rows_per_task, 1), F.col("path"))


def _children(directories: DataFrame) -> DataFrame:
    """Entries of each directory; kept, as the next level reads it."""
    spread = _spread(directories.select("path"), DIRECTORIES_PER_TASK)
    lister = _lister(default_filesystem(directories.sparkSession))
    return checkpointed(spread.mapInPandas(lister, schemas.DIR_ENTRY))


def list_tree(directories: DataFrame) -> DataFrame:
    """Paths of all regular files under the directories; one distributed job per depth."""
    files = directories.sparkSession.createDataFrame([], "path string")
    frontier = directories.select("path")
    while not frontier.isEmpty():
        entries = _children(frontier)
        files = files.unionByName(entries.where(~F.col("is_dir")).select("path"))
        frontier = entries.where("is_dir").select("path")
    return files


def read_contents(files: DataFrame) -> DataFrame:
    """Bytes of each path: ``(path, content, error)``. A path that cannot be read has no content and says why."""
    default = default_filesystem(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict = {}
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"]:
                content = error = None
                try:
                    system, inner = open_filesystem(path, opened, default)
                    with system.open_input_stream(inner, compression=None) as stream:
                        content = stream.read()
                except (OSError, ValueError) as failure:
                    error = str(failure)
                rows.append((path, content, error))
                held += len(content or b"")
                if held >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content", "error"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return _spread(files.select("path"), FILES_PER_TASK).mapInPandas(read, schemas.FILE_BYTES)


def _names(pattern: str) -> list[str]:
    inner = posixpath.normpath(pattern)
    if inner.startswith(("/", "..")):
        raise ValueError(f"include pattern {pattern!r} leaves the workspace")
    return [] if inner == "." else inner.split("/")


def expand_glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Entries ``(path, is_dir)`` that match a path glob under root; ``*`` stops at ``/``."""
    matched = spark.createDataFrame([(root.rstrip("/"), True)], schemas.DIR_ENTRY)
    for name in _names(pattern):
        regex = r"(?s)\A" + paths.name_glob_to_regex(name) + r"\z"
        matched = _children(matched.where("is_dir")).where(
            F.substring_index("path", "/", -1).rlike(regex)
        )
    return matched


def _not_excluded(files: DataFrame, root: str, exclude: list[str]) -> DataFrame:
    return files.where(~paths.matches_any_glob(paths.relative_path(F.col("path"), root), exclude))


def scan_files(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """Every regular file under root, hidden and empty ones too, with its bytes."""
    top = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    return read_contents(_not_excluded(list_tree(top), root, list(exclude)))


def scan_include_roots(
    spark: SparkSession, root: str, include: list[str], exclude: list[str] = ()
) -> DataFrame:
    """Files of the include patterns: matched directories are walked, matched files are taken as they are.

    Excludes apply to walked files only. A path matched twice is read once.
    """
    if not include:
        return scan_files(spark, root, exclude)
    wanted = spark.createDataFrame([], "path string")
    for pattern in include:
        matched = expand_glob(spark, root, pattern)
        walked = _not_excluded(list_tree(matched.where("is_dir")), root, list(exclude))
        direct = matched.where(~F.col("is_dir")).select("path")
        wanted = wanted.unionByName(walked).unionByName(direct)
    return read_contents(wanted.distinct())


def workspace_files(contents: DataFrame, workspace: str, root: str) -> DataFrame:
    """Scanned bytes as the file table form ``(workspace, path, text, md5)``, paths relative to root.

    Files that could not be read are left out; ``read_failures`` has them.
    """
    return contents.where(F.col("error").isNull()).select(
        F.lit(workspace).alias("workspace"),
        paths.relative_path(F.col("path"), root).alias("path"),
        F.col("content").cast("string").alias("text"),
        paths.content_fingerprint(F.col("content")).alias("md5"),
    )


def read_failures(contents: DataFrame, workspace: str, root: str) -> DataFrame:
    """The files that could not be read: ``(workspace, path, error)``."""
    path = paths.relative_path(F.col("path"), root).alias("path")
    return contents.where(F.col("error").isNotNull()).select(F.lit(workspace).alias("workspace"), path, "error")
