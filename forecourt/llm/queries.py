"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, mixing, quality, sharding, simhash, token_counts, topk, warc
from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
Query = Callable[[SparkSession, str], DataFrame]

#: Words of a vocabulary file's name; where it lies is asked of the installed package.
VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all `pages`, written and read back: one row a page. Null html is an empty payload; see `warc.write_archives` for nulls and repeats."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of `documents`; `und` and 0 for texts that are null or without letters. See `language.identify`."""
    return language.identify(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of `documents`; null and wordless texts have fingerprint zero. See `simhash.near_duplicates`."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=4, k=4)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of `documents` by the law `bytes`; a null text has size 1. See `sharding.shard`."""
    # Texts are measured where they are read; only ids and measures go through the sort.
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8, carry=["doc_id"])
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of `documents`; a null source is a source, the last. See `mixing.mix`."""
    out = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of `embeddings` for every hundredth; vectors that are null or not finite take no part. See `topk.top_k`."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of `documents` and item of `benchmark` found in it; null and wordless texts have none. See `decontaminate.contamination`."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "words", F.size("tiles").alias("n_tiles"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every row of `documents`; null texts have none. See `token_counts.count_tokens`."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), TOKEN_LIMIT)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every row of `documents`, learnt from `labels`; empty texts get the bias alone. See `quality.classify`."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licenses of every row of `documents`; null texts are empty. See `licenses.scan`."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline; its stages say what they do with odd rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "pipeline": _pipeline,
}
