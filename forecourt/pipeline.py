"""The batch pipeline: bronze to silver and gold, with its measures."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import enrich as E
from .operators import normalize as N
from .operators import quality as Q
from .operators import survivorship as S
from .operators import upsert as U
from .operators import validate as V
from .plans import gold
from .schemas import SILVER
from .sources import bronze, generator
from .sources.store import Store


class Log:
    """Rows of pipeline_runs and quality_metrics, committed together."""

    def __init__(self, store: Store, run_id: str):
        self.store, self.run_id, self.runs, self.metrics, self.started = store, run_id, [], [], time.time()

    def add(self, stage: str, source: str, batch_id: str, rows_in: int, rows_out: int, rejects: int = 0, started: float | None = None, **metrics: float) -> None:
        begun, ended, own = started or self.started, time.time(), uuid.uuid4().hex
        at = lambda t: datetime.fromtimestamp(t, timezone.utc)
        self.runs.append((own, self.run_id, stage, source, batch_id, rows_in, rows_out, rejects, at(begun), at(ended), int(1000 * (ended - begun)), "success"))
        self.metrics += [(own, source, k, float(v), at(ended)) for k, v in metrics.items()]

    def commit(self) -> None:
        spark = self.store.spark
        rows = {"pipeline_runs": spark.createDataFrame(self.runs, SILVER["pipeline_runs"][0]), "quality_metrics": spark.createDataFrame(self.metrics, SILVER["quality_metrics"][0])}
        self.store.append(**rows)
        self.runs, self.metrics = [], []


def run(spark: SparkSession, root: str, date: str | None = None, reference_year: int | None = None, observed_at: str | None = None, decoder: E.Decoder | None = None) -> str | None:
    """One run over all batches below root, or one date's; gives its id, or None if there is nothing to do.

    The quarantine, the decode cache and the log commit by themselves and outlive a
    failed load; vehicles, listings and price history commit together.
    """
    store = Store(spark, f"{root}/silver")
    try:
        return _run(store, root, date, reference_year, observed_at, decoder)
    finally:
        store.drop_stages()


def _run(store: Store, root: str, date: str | None, reference_year: int | None, observed_at: str | None, decoder: E.Decoder | None) -> str | None:
    spark, run_id = store.spark, uuid.uuid4().hex
    year = reference_year or datetime.now(timezone.utc).year
    now = F.lit(observed_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    raw = bronze.read(spark, root, date)
    if raw is None:
        return None
    log, label = Log(store, run_id), date or "all"

    checked = store.stage("checked", V.checked(raw, year))
    rejects = V.rejected(checked, now)
    held = store.table("quarantine")
    store.append(quarantine=V.new_rows(rejects, held, SILVER["quarantine"][1]))
    normal = store.stage("normal", N.normalize(V.valid(checked), year, N.trim_dictionary(spark, generator.trims())))
    for b in Q.rejection_rate(checked).collect():  # one row a batch file
        log.add("validate", b.source, b.batch_id, b.rows_in, b.rows_in - b.rejects, b.rejects, rejection_rate=b.rejection_rate)
        log.add("normalize", b.source, b.batch_id, b.rows_in - b.rejects, b.rows_in - b.rejects)
    if normal.isEmpty():
        log.commit()
        return run_id

    begun = time.time()
    d, o = Q.duplicate_conflict(normal).first(), Q.price_outliers(normal).first()
    survivors = store.stage("survivors", S.survivors(normal))
    n = normal.count()
    log.add(
        "dedupe", "all", label, n, d.unique_vins, started=begun, unique_vins=d.unique_vins, vins_within_source_duplicate=d.within_source_duplicate, vins_cross_source_duplicate=d.cross_source_duplicate,
        vins_with_year_conflict=d.year_conflict, within_source_duplicate_rate=d.within_source_duplicate_rate, cross_source_duplicate_rate=d.cross_source_duplicate_rate, conflict_rate=d.year_conflict_rate,
        price_outlier_rate=o.outliers / o.scored if o.scored else 0,
    )

    begun = time.time()
    decode = decoder or E.seed_decoder(spark, generator.decoder_rows())
    cache = store.table("decode_cache")
    missing = store.stage("missing", E.missing_prefixes(survivors.select("vin", "first_ordinal"), cache))
    calls = missing.count()
    if calls:
        store.append(decode_cache=decode(missing).withColumn("decoded_at", now).select(*cache.columns))
        cache = store.table("decode_cache")
    vehicles = store.stage("vehicles", E.enrich(survivors, cache))
    listings = E.enrich_listings(normal, vehicles)
    staged = store.stage("batch", U.staged_listings(listings))
    m = E.enrich_metrics(vehicles, listings).first()
    log.add(
        "enrich", "all", label, m.unique_vins, m.unique_vins, started=begun, unique_prefixes=m.unique_prefixes, cache_hits=m.unique_prefixes - calls, decode_calls_made=calls, decode_success_rate=m.decode_success / m.unique_vins,
        make_model_agreement_rate=m.agreement / m.agreement_checked if m.agreement_checked else 0, year_conflict_listings=m.year_conflict_listings,
    )

    begun = time.time()
    versions = {"vehicles": store.write("vehicles", U.upsert_vehicles(store.table("vehicles"), U.staged_vehicles(vehicles), now)), "listings": store.write("listings", U.upsert_listings(store.table("listings"), staged, now))}
    merged = store.read("listings", versions["listings"])
    changes = store.stage("changes", U.price_changes(staged, merged, store.table("price_history"), now))
    versions["price_history"] = store.added("price_history", changes)
    store.point(versions)
    upserted = staged.count()
    log.add("load", "all", label, m.unique_vins, m.unique_vins, started=begun, vehicles_upserted=m.unique_vins, listings_upserted=upserted, price_history_rows_written=changes.count())

    for c in Q.completeness(checked, normal).collect():
        log.add("summary", c.source, label, c.rows_in, c.valid, c.quarantined, field_completeness_price_pct=c.price_completeness, field_completeness_odometer_pct=c.odometer_completeness, trim_normalization_coverage=c.trim_coverage)
    log.commit()
    return run_id


def refresh_gold(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Rewrites the gold snapshots from silver, and gives them."""
    store = Store(spark, f"{root}/silver")
    store.refresh({"gold_market_stats": gold.market_stats(store.table("listings")), "gold_price_drops": gold.price_drops(store.table("price_history"))})
    return {name: store.table(name) for name in ("gold_market_stats", "gold_price_drops")}


def report(spark: SparkSession, root: str, run_id: str | None = None) -> str:
    """The quality report of a run, by default the last one."""
    store = Store(spark, f"{root}/silver")
    runs = store.table("pipeline_runs")
    run_id = run_id or Q.latest_run(runs).first().run_id
    if run_id is None:
        return "No pipeline runs found."
    lines = [f"Run {run_id}", "", f"{'stage':<16}{'source':<18}{'in':>10}{'out':>10}{'rejects':>10}{'batches':>10}{'ms':>10}"]
    for r in Q.stage_rollup(runs.where(F.col("run_id") == run_id)).orderBy("stage", "source").collect():
        lines.append(f"{r.stage:<16}{r.source:<18}{r.rows_in:>10}{r.rows_out:>10}{r.rejects:>10}{r.batches:>10}{r.total_ms:>10}")
    lines += ["", "Measures"]
    for r in Q.run_metrics(store.table("quality_metrics"), runs, run_id).orderBy("source", "metric_name").collect():
        lines.append(f"  [{r.source}] {r.metric_name}: {Q.formatted(r.metric_value)}")
    lines += ["", "Quarantine by reason"]
    for r in Q.reason_counts(store.table("quarantine")).orderBy(F.desc("n"), "reason", "source").collect():
        lines.append(f"  {r.source:<18}{r.reason:<24}{r.n}")
    lines += ["", "Rows"]
    for r in Q.table_counts({t: store.table(t) for t in ("vehicles", "listings", "price_history", "quarantine", "decode_cache")}).collect():
        lines.append(f"  {r.table_name:<16}{r.n}")
    return "\n".join(lines)
