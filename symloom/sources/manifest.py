"""An index of tables by file, in key ranges, committed by manifests: readers and writers never wait for each other."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.session import hadoop_path

FILE_KEY = ["workspace", "path"]
RANGES = 32
_RANGE = "key_range"


class Conflict(Exception):
    """Another writer committed the version first."""


class Change:
    """What a commit does to one table: rows of the files ``drop(workspace, path)`` go, then ``add`` comes."""

    def __init__(self, add: DataFrame, drop: DataFrame | None = None):
        self.add, self.drop = add, None if drop is None else drop.select(*FILE_KEY)


class ManifestIndex:
    """Tables whose rows belong to files, cut into ranges by the hash of workspace and path.

    A manifest names, for each range of each table, the folder that holds its rows, and the version that wrote it. A commit
    writes the ranges it touches to folders of its own and then creates the next manifest, which either succeeds
    as a whole or finds that another writer was first. It is tried again then: ranges that the other left alone are kept as
    they are written, the others are made anew from what the other wrote. Nothing that a reader
    sees is ever written over. ``vacuum`` removes what no recent manifest names.
    """

    def __init__(self, spark: SparkSession, root: str, ranges: int = RANGES):
        self.spark, self.root, self._ranges = spark, root.rstrip("/"), ranges

    # --- manifests

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}"

    def versions(self) -> list[int]:
        folder, system = hadoop_path(self.spark, f"{self.root}/manifests")
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The given or the last manifest; an index that nothing was committed to has version 0 and no tables."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "ranges": self._ranges, "tables": {}, "batches": {}}
        text = self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0]
        return json.loads(text)

    def _create(self, manifest: dict) -> None:
        """Write the manifest beside its place and rename it there, which fails where a file is already."""
        jvm = self.spark.sparkContext._jvm
        place, system = hadoop_path(self.spark, self._manifest_path(manifest["version"]))
        system.mkdirs(place.getParent())
        made = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
        out = system.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), system.getConf())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(made, place, options)
        except Exception as failure:
            system.delete(made, False)
            if system.exists(place):
                raise Conflict(manifest["version"]) from failure
            raise

    # --- reading

    def ranges_of(self, rows: DataFrame, manifest: dict | None = None) -> list[int]:
        """The ranges that the files of some rows lie in: no more numbers than there are ranges."""
        count = (manifest or self.manifest())["ranges"]
        number = F.pmod(F.xxhash64(*FILE_KEY), F.lit(count)).cast("int")
        return sorted(r[0] for r in rows.select(number.alias("r")).distinct().collect())

    def table(self, name: str, manifest: dict | None = None, ranges: list[int] | None = None) -> DataFrame | None:
        """The rows of a table as of a manifest, of all or of some ranges; None before anything was committed."""
        manifest = self.manifest() if manifest is None else manifest
        held = manifest["tables"].get(name)
        if held is None:
            return None
        schema = T.StructType.fromJson(held["schema"])
        wanted = held["ranges"].items() if ranges is None else [(str(r), held["ranges"].get(str(r))) for r in ranges]
        paths = [f"{self.root}/{entry['path']}" for _, entry in wanted if entry is not None and entry["path"] is not None]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- committing

    def _write(self, changes: dict[str, Change], base: dict, ranges: list[int]) -> dict[str, dict[int, str | None]]:
        """New folders for the given ranges of the changed tables: what ``base`` holds, less ``drop``, with ``add``."""
        count = base["ranges"]
        number = F.pmod(F.xxhash64(*FILE_KEY), F.lit(count)).cast("int")
        written: dict[str, dict[int, str | None]] = {}
        for name, change in changes.items():
            rows = change.add
            old = self.table(name, base, ranges)
            if old is not None:
                kept = old if change.drop is None else old.join(change.drop.distinct(), FILE_KEY, "left_anti")
                rows = kept.unionByName(rows)
            folder = f"data/{uuid.uuid4().hex}"
            # One range goes to one task, or to some by the salt of its paths, but never to all of them.
            numbered = rows.withColumn(_RANGE, number).where(F.col(_RANGE).isin(ranges))
            salt = F.pmod(F.xxhash64("path"), F.lit(self._salts(len(ranges))))
            numbered.repartition(_RANGE, salt).write.partitionBy(_RANGE).parquet(f"{self.root}/{folder}")
            place, system = hadoop_path(self.spark, f"{self.root}/{folder}")
            made = {s.getPath().getName() for s in system.listStatus(place)}
            written[name] = {r: f"{folder}/{_RANGE}={r}" if f"{_RANGE}={r}" in made else None for r in ranges}
        return written

    def _salts(self, ranges: int) -> int:
        """Tasks for one range, so that a commit of few ranges uses the cores as well."""
        return max(1, self.spark.sparkContext.defaultParallelism // max(1, ranges))

    def commit(
        self, changes: dict[str, Change], keys: DataFrame | None = None, batch: tuple[str, int] | None = None,
        base: dict | None = None,
    ) -> int:
        """Commit the changes of some tables as one version; gives its number.

        ``keys`` holds all files of the changes, where a frame tells them cheaper than the changes do. ``batch`` is the name of a
        stream and the number of its batch: a batch that was committed before is not committed again.
        Give stored or checkpointed frames: a retry reads them again. The driver sees range numbers and folder names.
        """
        base = self.manifest() if base is None else base
        named = [rows for c in changes.values() for rows in (c.add, c.drop) if rows is not None] if keys is None else [keys]
        if base["version"] == 0:
            touched = list(range(base["ranges"]))
        else:
            touched = sorted({r for rows in named for r in self.ranges_of(rows, base)})
        pending = touched
        written: dict[str, dict[int, str | None]] = {name: {} for name in changes}
        while True:
            if batch is not None and base["batches"].get(batch[0], -1) >= batch[1]:
                return base["version"]
            for name, places in self._write(changes, base, pending).items() if pending else ():
                written[name].update(places)
            version = base["version"] + 1
            tables = {name: {"schema": held["schema"], "ranges": dict(held["ranges"])} for name, held in base["tables"].items()}
            for name, places in written.items():
                held = tables.setdefault(name, {"schema": json.loads(changes[name].add.schema.json()), "ranges": {}})
                held["ranges"].update({str(r): {"path": path, "version": version} for r, path in places.items()})
            batches = {**base["batches"], **({batch[0]: batch[1]} if batch is not None else {})}
            try:
                self._create({"version": version, "ranges": base["ranges"], "tables": tables, "batches": batches})
                return version
            except Conflict:
                newer = self.manifest()
                pending = [r for r in touched if self._rewritten(r, changes, newer, base["version"])]
                base = newer

    @staticmethod
    def _rewritten(number: int, changes: dict[str, Change], newer: dict, since: int) -> bool:
        entries = [newer["tables"].get(name, {"ranges": {}})["ranges"].get(str(number)) for name in changes]
        return any(entry is not None and entry["version"] > since for entry in entries)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last manifests, and the folders that only the removed ones name."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        named = lambda numbers: {
            entry["path"].split("/")[1]
            for number in numbers
            for held in self.manifest(number)["tables"].values()
            for entry in held["ranges"].values()
            if entry["path"] is not None
        }
        unused = named(old) - named(kept)
        for path in [*[self._manifest_path(v) for v in old], *[f"{self.root}/data/{folder}" for folder in unused]]:
            place, system = hadoop_path(self.spark, path)
            system.delete(place, True)
