"""Contiguous shards of near equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, utf8, written
from .prefix import running_sums

ADDED = ("_size", "_crc", "_shard", "_slot")


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """docs with _size, _crc, _shard and _slot added; other columns as they are, or only those of `carry`, the key among them.

    The order is by (crc32 of the text, another hash of it, key): equal texts are next to each other. A
    row's place is the middle of its bytes (UTF-8 length plus 1; null text: 1) in the
    running sum, and the shards are cut at equal shares of the total; so shards differ
    by one row's size at most from equal. _slot counts rows from 0 within the shard,
    without gaps. Added names get further underscores where docs has them already. Rows with equal order (repeated rows) may stand in either order. Few
    rows may leave shards empty; an empty table gives an empty result.
    """
    kept = carry or docs.columns
    names = fresh(docs, *(f"_c{i}" for i in range(len(kept))))
    own = docs.select(
        *(docs[f"`{c}`"].alias(n) for c, n in zip(kept, names, strict=True)),
        (F.coalesce(F.octet_length(utf8(docs[text])), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(utf8(docs[text]), F.lit(b""))).alias("_crc"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("_text"),
    )
    key_at = names[kept.index(key)]
    sums = running_sums(own, [F.col("_crc"), F.col("_text"), F.col(key_at)], "_size")
    total = sums.agg(F.sum("_size")).first()[0] or 1
    middle = (F.col("_start") * 2 + F.col("_size")).cast("decimal(38,0)") * shards
    placed = sums.withColumn("_shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int"))
    # One row per shard.
    firsts = placed.groupBy(F.col("_shard").alias("_of_shard")).agg(F.min("_rank").alias("_first"))
    placed = placed.join(F.broadcast(firsts), F.col("_shard") == F.col("_of_shard"))
    added = zip(fresh(docs, *ADDED), ("_size", "_crc", "_shard", F.col("_rank") - F.col("_first")), strict=True)
    return placed.select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=True)), *((F.col(x) if isinstance(x, str) else x).alias(n) for n, x in added))
