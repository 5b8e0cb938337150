"""The registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import centroids, decontaminate, langid, licenses, packing, secrets, sharding, simhash, suffixes, tokens, topk, tries, urls, wavelet
from symloom.llm.shared import stored
from symloom.session import scratch_dir

CAPACITY = 2048

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(table(spark, sf_dir, "documents"), 24)
    return shards.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer() -> str:
    import public_tokenizers

    return tokens.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def packed(docs: DataFrame) -> DataFrame:
    """Every document in sequences of at most 2048 tokens: where each piece lies, and the checksum of its ids."""
    pieces = packing.token_pieces(docs, tokenizer(), 1, CAPACITY, with_ids=False)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return packing.pack(stored(pieces, "pieces"), CAPACITY).select(*columns, "sequence_id", "offset")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op2_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "wavelet")
    wavelet.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer(), 2)
    files = wavelet.read_token_files(spark, path)
    return wavelet.documents_of(files).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    lengths = F.zip_with("_hits.from", "_hits.to", lambda a, b: (b - a).cast("long"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select("doc_id", F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_hits.items").alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_norm_bucketed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op3_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predicted(docs, langid.learn_profiles(docs))
    return found.select(
        "doc_id", langid.held_out("doc_id").alias("held_out"),
        F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"),
    )


URL_RULES = {
    "com/": urls.ALLOW,
    "example.com/en/": urls.BLOCK,
    "www.example.com/en/": urls.ALLOW,
    "net/es/": urls.BLOCK,
    "net/fr/": urls.BLOCK,
}


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judged(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", *[F.col(f"_judged.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def joined_spans(spans: str):
    """Findings as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = stored(secrets.scanned(table(spark, sf_dir, "documents")), "scans")
    found = secrets.findings(scans, secrets.learn(scans))

    def number_of(kind: str):
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number_of(kind) for kind in secrets.KINDS[:3]]
    base = F.sha2(joined_spans("base"), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *count, base, joined_spans("spans").alias("spans"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), span=200)
    lengths = F.transform("spans", lambda s: (s["to"] - s["from"]).cast("long"))
    n_removed = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


@query
def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"), count=16, rounds=3, width=64, scale=64)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tries.ordered_turns(table(spark, sf_dir, "conversations"))
    return tries.prefix_trie(*tries.rebuilt(turns, every=100, most=6))
