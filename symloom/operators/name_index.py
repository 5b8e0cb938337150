"""A stored name index: symbols lie in the order of their names, and a prefix query reads the interval that it covers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions import names
from symloom.operators.search import PREFIX_LIMIT, SYMBOL_ORDER, first_by_place
from symloom.session import hadoop_path

#: Rows of a part, about, and no more parts than this: the driver and each plan hold the first and last key of every part.
ROWS_PER_PART, MOST_PARTS = 1_000_000, 4096
#: Rows of a page, about: what a query meets beyond its hits is the rest of its first and its last page.
ROWS_PER_PAGE = 512

_ROW_BITS = 33  # monotonically_increasing_id counts the rows of a partition in its lower bits
_KEY, _PART, _PAGE = "_name_key", "_part", "_page"


def name_key(workspace: Column, name: Column) -> Column:
    """Workspace and folded name as one text that sorts like the pair; null where one of them is."""
    return F.concat(workspace, F.lit("\0"), name)


def _reaches(first: Column, low: Column) -> Column:
    """Whether a run of keys that starts with ``first`` starts before the end of what begins with ``low``."""
    return F.substring(first, F.lit(1), F.length(low)) <= low


class NameIndex:
    """Folders ``_part=<n>`` of symbols in the order of workspace and folded name, and the first and last key of each page and part.

    All names that begin with a text lie together. A query finds the parts of its interval by the parts' first and last
    keys, opens no other part, and meets the pages of its interval by an equi-join on part and page. No symbol is
    copied. Names that many symbols have are split among parts by the symbols' places. Rows without a workspace or a
    folded name match no query and are left out. ``write`` wants a new folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, symbols: DataFrame, parts: int | None = None, rows_per_page: int = ROWS_PER_PAGE) -> None:
        """Index stored symbols, which are read more than once."""
        key = name_key(F.col("workspace"), F.col("name_fold"))
        keyed = symbols.withColumn(_KEY, key).where(F.col(_KEY).isNotNull())
        if parts is None:
            parts = max(1, min(MOST_PARTS, -(-keyed.count() // ROWS_PER_PART)))
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        order = [_KEY, *SYMBOL_ORDER]
        (
            keyed.repartitionByRange(parts, *order)
            .withColumn(_PART, F.spark_partition_id())
            .sortWithinPartitions(_PART, *order)
            .withColumn(_PAGE, (row / F.lit(rows_per_page)).cast("int"))
            .write.partitionBy(_PART)
            .parquet(f"{self.path}/symbols")
        )
        schema = T.StructType([*symbols.schema.fields, *[T.StructField(n, t) for n, t in _PLACES]])
        self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/schema")
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/symbols")
        ends = [F.min(_KEY).alias("first"), F.max(_KEY).alias("last"), F.count(F.lit(1)).alias("n_rows")]
        stored.groupBy(_PART, _PAGE).agg(*ends).write.parquet(f"{self.path}/pages")
        pages = self.spark.read.parquet(f"{self.path}/pages")
        pages.groupBy(_PART).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_rows").alias("n_rows")
        ).coalesce(1).write.parquet(f"{self.path}/parts")

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    def _part_bytes(self, number: int) -> int:
        place, system = hadoop_path(self.spark, f"{self.path}/symbols/{_PART}={number}")
        return system.getContentSummary(place).getLength()

    def routed(self, queries: DataFrame, corrected: bool = False) -> DataFrame:
        """``queries(workspace, query_id, query)`` with the part and page numbers of their intervals, a row for each page."""
        parts = sorted(self.spark.read.parquet(f"{self.path}/parts").collect(), key=lambda r: r[_PART])
        low = name_key(F.col("workspace"), names.literal_start(F.col("query"), corrected))
        asked = queries.select("workspace", "query_id", "query", low.alias("_low"))
        listed = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
        firsts, lasts = (listed([r[end] for r in parts], "string") for end in ("first", "last"))
        start = F.size(F.filter(lasts, lambda last: last < F.col("_low")))
        size = F.size(F.filter(firsts, lambda first: _reaches(first, F.col("_low")))) - start
        numbers = F.slice(listed([r[_PART] for r in parts], "int"), start + 1, F.greatest(size, F.lit(0)))
        aimed = asked.where(F.col("_low").isNotNull()).withColumn(_PART, F.explode(numbers))
        pages = self.spark.read.parquet(f"{self.path}/pages")
        inside = (F.col("last") >= F.col("_low")) & _reaches(F.col("first"), F.col("_low"))
        return aimed.join(pages, _PART).where(inside).drop("_low", "first", "last")

    def matches(self, queries: DataFrame, corrected: bool = False) -> DataFrame:
        """Symbols that match each query, uncut, with its ``query_id`` and ``query``."""
        schema, routed = self._schema(), self.routed(queries, corrected)
        # Numbers of parts: no more than there are parts.
        wanted = sorted(r[0] for r in routed.select(_PART).distinct().collect())
        symbols = self.spark.read.schema(schema).parquet(f"{self.path}/symbols").where(F.col(_PART).isin(wanted))
        found = symbols.join(routed.drop("n_rows"), ["workspace", _PART, _PAGE])
        hits = found.where(names.has_prefix(F.col("name_fold"), F.col("query"), corrected))
        return hits.select(*[f.name for f in schema if f.name not in (_KEY, _PART, _PAGE)], "query_id", "query")

    def search(self, queries: DataFrame, limit: int = PREFIX_LIMIT, corrected: bool = False) -> DataFrame:
        """The first ``limit`` symbols of each query by path and place, with their rank."""
        return first_by_place(lambda texts: self.matches(texts, corrected), queries, limit)

    def reads(self, queries: DataFrame, corrected: bool = False) -> DataFrame:
        """What each query opens: ``(workspace, query_id, n_parts, n_pages, n_rows, n_bytes)``, zeros where nothing fits.

        ``n_rows`` are the rows of the pages that it is compared with, ``n_bytes`` the sizes of the parts' files.
        """
        routed = self.routed(queries, corrected)
        wanted = sorted(r[0] for r in routed.select(_PART).distinct().collect())
        sizes = F.from_json(F.lit(json.dumps({str(n): self._part_bytes(n) for n in wanted})), "map<string, bigint>")
        key = ["workspace", "query_id"]
        per_part = routed.groupBy(*key, _PART).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_rows").alias("n_rows"))
        sums = per_part.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n_parts"), F.sum("n_pages").alias("n_pages"), F.sum("n_rows").alias("n_rows"),
            F.sum(F.element_at(sizes, F.col(_PART).cast("string"))).alias("n_bytes"),
        )
        return queries.select(*key).join(sums, key, "left").fillna(0, ["n_parts", "n_pages", "n_rows", "n_bytes"])


_PLACES = [(_KEY, T.StringType()), (_PAGE, T.IntegerType()), (_PART, T.IntegerType())]
