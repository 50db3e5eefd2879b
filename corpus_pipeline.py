"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes the rows that the stage before kept, written as Parquet and read
again. All but the last return the columns of documents; the last adds the shard and
the slot in it. The mixing stage repeats or drops documents as the mix takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import decontaminate, mixing, quality, sharding, simhash
from forecourt.llm.common import fresh, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on them and on `labels`, predicts as 1.

    Null and empty texts get the classifier's bias alone. Repeated rows and ties are judged
    each; without labels every score is 0.5, and all stay. Columns stay as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Near-duplicates are about 0.8 similar in five-word shingles. At 0.8, fingerprints differ
    in 19 or 20 of 128 bits on average and in 22 or fewer in most cases: all within 22
    bits are linked, and groups are what links connect. Null, empty and blank texts are
    one group; rows with a null doc_id stay; of rows that share an id that stays, one stays.
    Columns stay as they are.
    """
    return simhash.one_of_each(docs, threshold=22, k=5, words=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of `benchmark` is found, in whatever order its passages stand.

    Null and wordless texts stay, as does everything if the benchmark is empty. Repeated rows
    are judged each. Columns stay as they are.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as the mix of sources takes them: each once for every slot in which its first word is scheduled.

    A null source is a source, the last; documents without words go with the words around
    them. Ties in the shuffled order go by doc_id and text. Columns stay as they are.
    """
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with `shard` (0 to 7, of near equal bytes) and `slot` (from 0 without gaps); the names get underscores where docs has them.

    Equal texts stand together, null texts as empty ones; repeated rows get a slot each.
    """
    out = sharding.shard(docs, shards=8)
    found = fresh(docs, *sharding.ADDED)[2:]
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f).alias(n) for f, n in zip(found, fresh(docs, "shard", "slot"), strict=True)))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", shards),
]

#: Trained models, fingerprints by XXH64 and tilings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: columns of `documents`, shard and slot. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
