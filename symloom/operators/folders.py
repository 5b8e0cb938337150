"""Fingerprints of folders, bottom up, and what two trees differ in, top down.

A folder's fingerprint follows from the names and fingerprints of its children, so two folders with equal ones
hold the same files, wherever they lie: a comparison never goes below them, and a folder that was renamed is
one row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.operators.scale import join_unique
from symloom.session import checkpointed, scratch_dir

NODE = ["workspace", "depth", "path", "is_dir"]
CONTENT = ["workspace", "is_dir", "a", "b"]
CHANGES = ["workspace", "path", "is_dir", "change", "old_path", "n_files"]


def _hashes(*columns: str | Column) -> list[Column]:
    """128 bits over any number of rows in any order; they combine before a shuffle, so no folder is too large."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), *columns)).alias(name) for seed, name in ((1, "a"), (2, "b"))]


def _placed(nodes: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    above = F.substr("path", F.lit(1), F.length("path") - F.length(name) - 1)
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == 1, "").otherwise(above)
    return nodes.withColumn("name", name).withColumn("parent", parent)


def folder_tree(files: DataFrame) -> DataFrame:
    """The files ``(workspace, path, md5)`` and all folders above them, each with its fingerprint ``(a, b)``.

    Columns: ``workspace``, ``depth`` (0: the workspace's root, whose path is empty), ``path``, ``parent``, ``name``,
    ``is_dir``, ``a``, ``b``, ``n_files``. One aggregation per depth; the table is stored with a folder per depth. Repeated
    rows count once, a path with several contents has the fingerprint of all of them. Rows without workspace or
    path belong to no tree; an empty table gives an empty one; other columns are ignored.
    """
    spark = files.sparkSession
    known = files.select("workspace", "path", "md5").where("workspace IS NOT NULL AND path IS NOT NULL").distinct()
    leaves = known.groupBy("workspace", "path").agg(*_hashes("md5"), F.lit(1).cast("long").alias("n_files"))
    depth = F.size(F.split("path", "/"))
    columns = ["workspace", "depth", "path", "is_dir", "a", "b", "n_files", "name", "parent"]
    leaves = _placed(leaves.withColumn("depth", depth).withColumn("is_dir", F.lit(False))).select(*columns)
    leaves = checkpointed(leaves)
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    folders, levels = None, [leaves]
    for level in range(deepest, 0, -1):
        children = leaves.where(F.col("depth") == level)
        children = children if folders is None else children.unionByName(folders)
        above = children.groupBy("workspace", F.col("parent").alias("path")).agg(
            *_hashes("name", "is_dir", "a", "b"), F.sum("n_files").alias("n_files")
        )
        above = above.withColumn("depth", F.lit(level - 1)).withColumn("is_dir", F.lit(True))
        folders = checkpointed(_placed(above).select(*columns))
        levels.append(folders)
    path = scratch_dir(spark, "tree")
    tree = functools.reduce(DataFrame.unionByName, levels)
    tree.write.partitionBy("depth").parquet(path)
    return spark.read.schema(tree.schema).parquet(path).select(*columns)


def _inside(tree: DataFrame, depth: int, folders: DataFrame) -> DataFrame:
    """The nodes of a depth whose parent is one of the folders, which lie a depth above."""
    level = tree.where(F.col("depth") == depth)
    return level.join(folders.select("workspace", F.col("path").alias("parent")), ["workspace", "parent"], "left_semi")


def _files_below(tree: DataFrame, tops: DataFrame, deepest: int) -> DataFrame:
    """The files among the nodes ``tops`` and in the folders among them, depth by depth."""
    found, open_folders = tops.where(~F.col("is_dir")), tops.where("is_dir AND depth = 0")
    for depth in range(1, deepest + 1):
        children = checkpointed(_inside(tree, depth, open_folders).select(*tops.columns))
        found = found.unionByName(children.where(~F.col("is_dir")))
        open_folders = children.where("is_dir").unionByName(tops.where(F.col("is_dir") & (F.col("depth") == depth)))
    return checkpointed(found)


def _match(added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moved nodes, and what is left of the added and of the removed ones."""
    origins = removed.groupBy(*CONTENT).agg(F.min("path").alias("old_path"))
    met = checkpointed(join_unique(added, origins, CONTENT, salt_by=["path"]))
    moved = met.where("old_path IS NOT NULL")
    named = moved.select("workspace", "is_dir", F.col("old_path").alias("path")).distinct()
    left = checkpointed(removed.join(named, ["workspace", "is_dir", "path"], "left_anti").select(*removed.columns))
    return moved, met.where("old_path IS NULL").select(*added.columns), left


def compare_trees(new: DataFrame, old: DataFrame) -> DataFrame:
    """What differs between two ``folder_tree`` tables: ``(workspace, path, is_dir, change, old_path, n_files)``.

    From the roots down, only folders that differ are opened; they are the rows ``changed`` with ``is_dir``. Files
    differ (``changed``), or are ``added`` or ``removed``. A folder or file that is only in the new tree is ``moved`` where
    the old tree lost one of equal content in its workspace: ``old_path`` is the smallest such path, which then is
    no ``removed`` row; several copies may name one origin. Folders are matched as a whole first; what no folder explains
    is given and matched file by file. Two empty trees give no row.
    """
    deepest = max(tree.agg(F.max("depth")).first()[0] or 0 for tree in (new, old))
    columns = [*NODE, "a", "b", "n_files"]
    found, opened = [], None
    for depth in range(deepest + 1):
        sides = []
        for tree, prefix in ((new, "n"), (old, "o")):
            level = tree.where(F.col("depth") == 0) if opened is None else _inside(tree, depth, opened)
            sides.append(level.select(*NODE, *[F.col(c).alias(f"{prefix}_{c}") for c in ("a", "b", "n_files")]))
        both = sides[0].join(sides[1], NODE, "full")
        equal = F.col("n_a").eqNullSafe(F.col("o_a")) & F.col("n_b").eqNullSafe(F.col("o_b"))
        found.append(checkpointed(both.where(~equal)))
        opened = found[-1].where("is_dir AND n_a IS NOT NULL AND o_a IS NOT NULL")
        if opened.isEmpty():
            break
    differing = functools.reduce(DataFrame.unionByName, found)

    def only(prefix: str, other: str) -> DataFrame:
        alone = differing.where(F.col(f"{other}_a").isNull())
        return alone.select(*NODE, *[F.col(f"{prefix}_{c}").alias(c) for c in ("a", "b", "n_files")])

    changed = differing.where("n_a IS NOT NULL AND o_a IS NOT NULL").withColumn("n_files", F.col("n_n_files"))
    moved, added, removed = _match(only("n", "o"), only("o", "n"))
    added = _files_below(new.select(*columns, "parent"), added, deepest)
    removed = _files_below(old.select(*columns, "parent"), removed, deepest)
    moved_files, added, removed = _match(added, removed)
    nothing = F.lit(None).cast("string")
    parts = [
        changed.withColumn("change", F.lit("changed")).withColumn("old_path", nothing),
        moved.withColumn("change", F.lit("moved")),
        moved_files.withColumn("change", F.lit("moved")),
        added.withColumn("change", F.lit("added")).withColumn("old_path", nothing),
        removed.withColumn("change", F.lit("removed")).withColumn("old_path", nothing),
    ]
    return functools.reduce(DataFrame.unionByName, [part.select(*CHANGES) for part in parts])
