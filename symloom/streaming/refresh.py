"""Re-index arriving files. The content hash makes it idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import paths
from symloom.operators.index import FILE_KEY, detect_changed_files
from symloom.operators.search import Model, embed_symbols
from symloom.operators.symbols import DEFINITION_RULES, Rule, add_text_errors, extract_symbols, symbol_table
from symloom.session import checkpointed
from symloom.sources.files import read_contents
from symloom.sources.manifest import RANGES, Change, ManifestIndex
from symloom.streaming.runner import run_available

MANIFEST = "workspace string, root string, path string"


class IndexRefreshStream:
    """The index under manifests: each batch is one commit, which rewrites the key ranges of its changed files only.

    A file and its symbols change together, and several streams may refresh one index. A batch that is run again finds
    its number in the manifest and does nothing. With a ``model`` the symbols are embedded in the same pass.
    A file that cannot be read, or is no text, is a row of ``problems``; one that cannot be read keeps its
    earlier index. Every ``vacuum_every`` batches, folders that no recent manifest names are removed.
    """

    def __init__(
        self, spark: SparkSession, root: str, rules: list[Rule] = DEFINITION_RULES, vacuum_every: int = 20,
        model: Model | None = None, name: str = "refresh", ranges: int = RANGES,
    ):
        self.spark, self.rules, self.vacuum_every, self.model, self.name = spark, rules, vacuum_every, model, name
        self.index = ManifestIndex(spark, root, ranges)

    def _read(self, manifest: DataFrame) -> DataFrame:
        named = manifest.distinct()
        prefix = F.length(F.rtrim(F.col("root"), F.lit("/"))) + 2
        return (
            read_contents(named.select("path").distinct())
            .join(named, "path")
            .select(
                "workspace",
                F.substring(F.col("path"), prefix, F.length("path")).alias("path"),
                F.col("content").cast("string").alias("text"),
                paths.content_fingerprint(F.col("content")).alias("md5"),
                "error",
            )
        )

    def process(self, manifest: DataFrame, batch_id: int) -> None:
        """Read the files of a batch of ``(workspace, root, path)`` and index those that changed."""
        base = self.index.manifest()
        if base["batches"].get(self.name, -1) >= batch_id:
            return
        # Written out once, so that the hash, the symbols and the problems come from the same read.
        scan = checkpointed(self._read(manifest))
        indexed = self.index.table("files", base, self.index.ranges_of(scan, base))
        readable = scan.where(F.col("error").isNull()).drop("error")
        changed = readable if indexed is None else detect_changed_files(readable, indexed)
        changed = checkpointed(add_text_errors(changed))
        version = F.lit(batch_id).alias("indexed_at")
        with_text = self.model is not None
        symbols = symbol_table(extract_symbols(changed, self.rules, with_text=with_text, corrected=with_text))
        if self.model is not None:
            symbols = checkpointed(embed_symbols(symbols, self.model).drop("symbol_text"))
        failed = scan.unionByName(changed, allowMissingColumns=True).where(F.col("error").isNotNull())
        failed = checkpointed(failed.select(*FILE_KEY, "error", version))
        seen = changed.select(*FILE_KEY).unionByName(failed.select(*FILE_KEY))
        changes = {
            "files": Change(changed.select(*FILE_KEY, "md5", version), changed),
            "symbols": Change(symbols.select("*", version), changed),
            "problems": Change(failed, seen),
        }
        self.index.commit(changes, seen, (self.name, batch_id), base)
        if (batch_id + 1) % self.vacuum_every == 0:
            self.index.vacuum()

    def run(self, manifests: DataFrame, checkpoint: str) -> None:
        run_available(manifests, self.process, checkpoint)

    def files(self) -> DataFrame:
        return self.index.table("files")

    def symbols(self) -> DataFrame:
        """Symbols of the current version of each file."""
        return self.index.table("symbols")

    def embeddings(self) -> DataFrame:
        """``(workspace, symbol_id, embedding)`` of the current symbols; needs a model."""
        return self.symbols().select("workspace", "symbol_id", "embedding")

    def problems(self) -> DataFrame:
        """The last failure of each file that has not been indexed since: ``(workspace, path, error, indexed_at)``."""
        return self.index.table("problems")
