"""Bronze: immutable gzip batches by source and date, and their manifests.

Layout below a root: bronze/source=<s>/date=<d>/<file>.gz and
bronze/_manifest/source=<s>/date=<d>.json.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FIELDS, FRENCH, SOURCE_A, SOURCE_B, SOURCES
from .files import names, read_json, write_bytes, write_json
from .staging import spread

SUFFIX = {SOURCE_A: ".ndjson", SOURCE_B: ".csv"}


def count_rows(content: bytes, csv: bool) -> int:
    """Lines that are not blank, without a CSV header."""
    lines = sum(1 for line in content.split(b"\n") if line.strip())
    return max(0, lines - 1) if csv else lines


def _land(target: str, csv: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at, compression=None) as f:
                    content = f.read()
                packed, key = gzip.compress(content, mtime=0), f"{target}/{path.rpartition('/')[2]}.gz"
                write_bytes(key, packed)
                rows.append((key, count_rows(content, csv), len(packed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "rows", "compressedBytes"])

    return run


def _store(path: str):
    from .files import store_of

    return store_of(path)


def land(spark: SparkSession, files_dir: str, root: str, source: str, date: str) -> dict:
    """Copies a source's files, one task each, to their keys, and writes the manifest; a repeated landing overwrites."""
    files = names(files_dir, SUFFIX[source])
    target = f"{root}/bronze/source={source}/date={date}"
    found = []
    if files:
        paths = spark.createDataFrame([(f"{files_dir}/{f}",) for f in files], "path string").repartition(len(files))
        found = paths.mapInArrow(_land(target, source == SOURCE_B), "key string, rows long, compressedBytes long").orderBy("key").collect()
    batches = [{"key": r.key[len(root) + 1 :], "rows": r.rows, "compressedBytes": r.compressedBytes} for r in found]
    manifest = {"source": source, "date": date, "batches": batches, "totalRows": sum(b["rows"] for b in batches), "totalObjects": len(batches), "landedAt": datetime.now(timezone.utc).isoformat()}
    write_json(f"{root}/bronze/_manifest/source={source}/date={date}.json", manifest)
    return manifest


def manifests(root: str, source: str, date: str | None = None) -> list[dict]:
    """A source's manifests, by date."""
    at = f"{root}/bronze/_manifest/source={source}"
    found = [read_json(f"{at}/{name}") for name in names(at, ".json")]
    return [m for m in found if date is None or m["date"] == date]


def list_bronze(root: str) -> list[tuple[str, int, int, int]]:
    """Per source: objects, dates, rows."""
    return [(s, sum(m["totalObjects"] for m in ms), len(ms), sum(m["totalRows"] for m in ms)) for s in SOURCES for ms in [manifests(root, s)]]


def _ordinal(source: int) -> Column:
    return F.struct(F.lit(source).alias("source"), F.col("date"), F.col("batch_id"), F.monotonically_increasing_id().alias("row")).alias("ordinal")


def _batch_id() -> Column:
    return F.regexp_extract(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"(bronze/source=.*)$", 1).alias("batch_id")


def typed_fields(variant: Column) -> Column:
    """Struct of every field's text and JSON kind."""
    out = []
    for name in FIELDS:
        value = F.try_variant_get(variant, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
        kinds = F.when(value.isNull(), "missing").when(kind == "STRING", "string").when(kind == "VOID", "null").when(number, "number").when(kind == "BOOLEAN", "boolean").otherwise("other")
        text = F.when(kinds.isin("string", "number"), F.try_variant_get(variant, f"$.{name}", "string")).when(kinds == "boolean", F.try_variant_get(variant, f"$.{name}", "int").cast("string"))
        out.append(F.struct(text.alias("text"), kinds.alias("kind")).alias(name))
    return F.struct(*out).alias("f")


def raw_a(lines: DataFrame) -> DataFrame:
    """Raw records of NDJSON lines (value, batch_id, ordinal); a malformed line fails the run."""
    rows = lines.where(F.trim("value") != "").withColumn("_v", F.parse_json("value"))
    return rows.select(F.lit(SOURCE_A).alias("source"), "batch_id", "ordinal", F.col("value").alias("raw_record"), typed_fields(F.col("_v")))


def raw_b(rows: DataFrame) -> DataFrame:
    """Raw records of CSV rows with French headers (and batch_id, ordinal)."""
    known = {FRENCH[c]: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns if c in FRENCH}
    missing = F.struct(F.lit(None).cast("string").alias("text"), F.lit("missing").alias("kind"))
    fields = [(F.struct(known[c].alias("text"), F.lit("string").alias("kind")) if c in known else missing).alias(c) for c in FIELDS]
    record = F.to_json(F.struct(*(v.alias(c) for c, v in known.items())), {"ignoreNullFields": "false"})
    return rows.select(F.lit(SOURCE_B).alias("source"), "batch_id", "ordinal", record.alias("raw_record"), F.struct(*fields).alias("f"))


def read(spark: SparkSession, root: str, date: str | None = None) -> DataFrame | None:
    """Raw records of the batches that the manifests of all dates, or of one, name with any rows. None if there are none.

    Files that no manifest names, as an earlier landing may have left, are not read.
    """
    found = []
    for number, source in enumerate(SOURCES):
        paths = [f"{root}/{b['key']}" for m in manifests(root, source, date) for b in m["batches"] if b["rows"]]
        if not paths:
            continue
        reader = spark.read.option("basePath", f"{root}/bronze")
        # Rows are numbered where they are read, and then dealt over the cluster: a gzip file is one task.
        if source == SOURCE_A:
            lines = reader.text(paths).select("value", F.col("date").cast("string").alias("date"), _batch_id()).select("value", "batch_id", _ordinal(number))
            found.append(raw_a(spread(lines)))
        else:
            table = reader.options(header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", emptyValue="", nullValue="\u0000").csv(paths)
            rows = table.select("*", _batch_id()).withColumn("date", F.col("date").cast("string")).select(*(c for c in table.columns if c not in ("source", "date")), "batch_id", _ordinal(number))
            found.append(raw_b(spread(rows)))
    return both(found) if found else None


def both(feeds: list[DataFrame]) -> DataFrame:
    """All rows of raw feeds, repeats included."""
    return reduce(DataFrame.unionByName, feeds)


def date_label(at: Column) -> Column:
    """The day of a time, as partitions are labelled: 2026-01-31."""
    return F.date_format(at, "yyyy-MM-dd")
