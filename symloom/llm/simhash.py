"""SimHash near-duplicates: tiled exact comparison, tile pairs skipped by their population counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.shared import components, stored, text_batches

SEED = 42
#: Fingerprints in a tile, about; a population-count group with more is split by hash.
TILE = 1024
#: A fingerprint's population is counted in this many equal parts; the sum of the parts' differences bounds
#: the distance from below.
PARTS = 4
BITS = 64 // PARTS


def fingerprint(text: str, shingle: int) -> int:
    """The majority fingerprint of a text's word shingles, as a signed 64-bit integer; 0 without a word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(t), SEED) for t in zip(*[words[k:] for k in range(shingle)])]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over_half = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over_half).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row; a null text has no words and the fingerprint 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return text_batches(docs).select(F.col(id_col).alias("id"), of(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def _population(fp) -> list:
    masks = [((1 << BITS) - 1) << (BITS * k) for k in range(PARTS)]
    return [F.bit_count(fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for m in masks]


def _neighbours(radius: int) -> list[int]:
    """Differences of group keys that may hold fingerprints within the radius, each unordered pair once."""
    base = BITS + 1
    steps = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    return [sum(d * base**k for k, d in enumerate(s)) for s in steps if s[::-1] >= (0,) * PARTS]


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links within the radius between two tiles (or inside one), as few as keep linked fingerprints linked.

    Every pair is compared. Of the pairs found, one that joins what is joined already is left out, so a
    tile pair gives fewer links than it has fingerprints.
    """
    inside = right is None
    nodes = left if inside else np.concatenate((left, right))
    offset = 0 if inside else len(left)
    # Of a negative number numpy would count the bits of its absolute value.
    bits = nodes.view(np.uint64)
    root = np.arange(len(nodes))
    links = []
    for at in range(0, len(left), 256):
        near = np.bitwise_count(bits[at : min(at + 256, len(left)), None] ^ bits[None, offset:]) <= radius
        for k in np.flatnonzero(near.any(axis=1)):
            i, hits = at + k, np.flatnonzero(near[k]) + offset
            roots, where = np.unique(root[hits], return_index=True)
            for q, j in zip(roots.tolist(), hits[where].tolist(), strict=True):
                if q != root[i]:
                    links.append((int(nodes[i]), int(nodes[j])))
                    root[root == q] = root[i]
    return links


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)`` links between different fingerprints ``fp`` at most ``radius`` bits apart; they connect what all such pairs do.

    Fingerprints are grouped by the population counts of their parts (at most 17^4 groups) and a group is
    split into tiles. Two tiles meet only if the differences of their counts sum up to no more than the
    radius, since a differing bit changes one count by one. A tile goes to each tile it must meet; the
    pairs of a large group are spread over tasks by the second tile.
    """
    keys = _population(F.col("fp"))
    key = sum((c * (BITS + 1) ** k for k, c in enumerate(keys)), F.lit(0)).cast("int")
    keyed = distinct.select("fp", key.alias("key"))
    groups = stored(
        keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "simhash-groups"
    )
    # At most 17^4 rows of 24 bytes.
    sizes = F.broadcast(groups.select("key", "tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = stored(
        keyed.join(sizes, "key").groupBy("key", tile.alias("tile")).agg(F.collect_list("fp").alias("fps")),
        "simhash-tiles",
    )
    steps = F.array(*[F.lit(d) for d in _neighbours(radius)])
    # Where a step carries from one count into the next, it leads to a group that is compared for nothing.
    reach = tiles.select("key", "tile", F.col("fps").alias("left"), F.explode(steps).alias("step"))
    aim = reach.withColumn("to", F.col("key") + F.col("step")).select("key", "tile", "left", F.col("to"))
    other = F.broadcast(groups.select(F.col("key").alias("to"), F.col("tiles").alias("to_tiles")))
    first = F.when(F.col("to") == F.col("key"), F.col("tile")).otherwise(F.lit(0))
    aimed = aim.join(other, "to").select(
        "key", "tile", "left", "to", F.explode(F.sequence(first, F.col("to_tiles") - 1)).alias("to_tile")
    )
    right = tiles.select(F.col("key").alias("to"), F.col("tile").alias("to_tile"), F.col("fps").alias("right"))
    pairs = aimed.join(right, ["to", "to_tile"]).select(
        "left", F.when((F.col("to") != F.col("key")) | (F.col("to_tile") != F.col("tile")), F.col("right")).alias("right")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for left, other_tile in zip(batch["left"], batch["right"], strict=True):
                b = None if other_tile is None else np.asarray(other_tile, np.int64)
                links += spanning_links(np.asarray(left, np.int64), b, radius)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return pairs.mapInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fp, component_id)``: the smallest id that a row reaches over fingerprints at most ``radius`` bits apart.

    Texts have A-Z lowered and are split at ASCII white space; shingles keep repeats and are hashed by XXH64 with seed 42. A
    text with fewer words is one shingle; without words, or null, it has the fingerprint 0, which links
    like any other. Rows with equal fingerprints are merged before anything is compared, and null ids never win
    over others. Rows with equal ids each count. No rows give no rows. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = components(fingerprint_links(distinct, radius), "simhash")
    member = labels.select(F.col("node").alias("fp"), "component")
    smallest = member.join(distinct, "fp").groupBy("component").agg(F.min("first").alias("reached"))
    reached = stored(member.join(smallest, "component").select("fp", "reached"), "simhash-reached")
    named = stored(
        distinct.join(reached, "fp", "left").select("fp", F.coalesce("reached", "first").alias("component_id")),
        "simhash-components",
    )
    return prints.join(named, "fp").select("id", "fp", "component_id")
