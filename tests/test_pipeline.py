import gzip
import json
from pathlib import Path

import pytest

from forecourt import pipeline
from forecourt.plans import load
from forecourt.sources import bronze, generator
from forecourt.sources.store import Store
from forecourt.streaming.ingest import ingest

TABLES = ("vehicles", "listings", "price_history", "quarantine", "decode_cache")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    generator.write(spark, f"{root}/data", count_a=1200, count_b=800, rows_per_file=700, overlap=0.1)
    for s in ("dealer-feed-a", "marketplace-b"):
        bronze.land(spark, f"{root}/data/{s}", root, s, "2026-01-01")
    return root


def test_generated_files_repeat(spark, lake, tmp_path):
    generator.write(spark, str(tmp_path), count_a=1200, count_b=800, rows_per_file=700, overlap=0.1)
    for a in sorted(Path(f"{lake}/data").rglob("*.*")):
        assert a.read_bytes() == (tmp_path / a.relative_to(f"{lake}/data")).read_bytes()


def test_landing_repeats_and_counts(spark, lake):
    before = sorted(p.name for p in Path(f"{lake}/bronze").rglob("*.gz"))
    m = bronze.land(spark, f"{lake}/data/marketplace-b", lake, "marketplace-b", "2026-01-01")
    assert sorted(p.name for p in Path(f"{lake}/bronze").rglob("*.gz")) == before and m["totalRows"] == 800
    assert bronze.list_bronze(lake) == [("dealer-feed-a", 2, 1, 1200), ("marketplace-b", 2, 1, 800)]
    assert bronze.read(spark, lake).count() == 2000 and bronze.read(spark, lake, "1999-01-01") is None


def test_only_what_manifests_name_is_read(spark, tmp_path):
    root, feed = str(tmp_path), tmp_path / "data"
    feed.mkdir()
    for i, n in enumerate((2, 3, 0)):
        (feed / f"batch-{i}.ndjson").write_text('{"vin":"v"}\n' * n)
    assert bronze.land(spark, str(feed), root, "dealer-feed-a", "d1")["totalRows"] == 5
    (feed / "batch-1.ndjson").unlink()
    assert bronze.land(spark, str(feed), root, "dealer-feed-a", "d1")["totalRows"] == 2
    assert bronze.read(spark, root).count() == 2 and len(list(tmp_path.glob("bronze/source=*/date=d1/*.gz"))) == 3


def test_appends_leave_what_is_there(spark, tmp_path, monkeypatch):
    from forecourt.sources import store as S

    monkeypatch.setattr(S, "MOST_FOLDERS", 3)
    store = S.Store(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([("v", str(i), i, None)], "vin string, listing_id string, price_cents long, observed_at timestamp")
    folders = []
    for i in range(5):
        store.append(price_history=row(i))
        folders.append(store.current()["price_history"])
        assert sorted(r.price_cents for r in store.table("price_history").collect()) == list(range(i + 1))
    assert [len(f) for f in folders] == [1, 2, 3, 1, 2] and folders[1][:1] == folders[0] and folders[2][:2] == folders[1]
    store.write("price_history", row(9))
    assert len(store.vacuum()) == 4 and store.vacuum() == []
    assert store.table("price_history").count() == 5


def test_shared_folder_is_asked_for_on_clusters():
    from types import SimpleNamespace as N

    from forecourt.sources import staging

    conf = N(get=lambda *_: None)
    with pytest.raises(ValueError):
        staging.shared_dir(N(conf=conf, sparkContext=N(getConf=lambda: conf, master="spark://host:7077", applicationId="a")))


def test_replay_changes_nothing(spark, lake):
    assert pipeline.run(spark, lake, reference_year=2026, observed_at="2026-01-02 00:00:00")
    store = Store(spark, f"{lake}/silver")
    key = lambda: {t: sorted(map(str, store.table(t).drop("updated_at", "last_seen_at").collect())) for t in TABLES}
    before = key()
    pipeline.run(spark, lake, "2026-01-01", reference_year=2026, observed_at="2026-01-03 00:00:00")
    assert key() == before
    assert store.table("listings").count() > 1500 and "dedupe" in pipeline.report(spark, lake)
    assert not list(Path(f"{lake}/silver/staging").glob("*"))
    g = pipeline.refresh_gold(spark, lake)
    assert g["gold_market_stats"].count() > 100 and g["gold_price_drops"].count() == 0


def test_failed_load_leaves_the_tables(spark, lake):
    store = Store(spark, f"{lake}/silver")
    current = store.current()
    store.write("vehicles", store.table("vehicles").limit(1))
    assert store.current() == current


def test_stream_gives_the_batch_rows(spark, lake, tmp_path):
    q = ingest(spark, lake, str(tmp_path / "out"), 2026, str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/normal")).count() + spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1200


def test_typed_json_and_quoted_csv(spark, tmp_path):
    root = str(tmp_path)
    a = Path(root, "bronze/source=dealer-feed-a/date=d1")
    b = Path(root, "bronze/source=marketplace-b/date=d1")
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    a.joinpath("x.ndjson.gz").write_bytes(gzip.compress(b'{"vin":"v","price":1500,"model":"1500","year":null,"status":true}\n\n{"vin":5,"price":"1500"}\n'))
    b.joinpath("x.csv.gz").write_bytes(gzip.compress('vin,prix,version,champ\nv,"1,5","x ""q"" y",z\n,,"",z\n'.encode()))
    for s, n in (("dealer-feed-a", 2), ("marketplace-b", 2)):
        m = Path(root, f"bronze/_manifest/source={s}")
        m.mkdir(parents=True)
        m.joinpath("date=d1.json").write_text(json.dumps({"source": s, "date": "d1", "batches": [{"key": f"bronze/source={s}/date=d1/x.{'ndjson' if s == 'dealer-feed-a' else 'csv'}.gz", "rows": n}], "totalRows": n, "totalObjects": 1}))
    rows = bronze.read(spark, root).orderBy("ordinal").collect()
    f = [r.f for r in rows]
    assert [tuple(x.price) for x in f] == [("1500", "number"), ("1500", "string"), ("1,5", "string"), ("", "string")]
    assert (tuple(f[0].model), tuple(f[0].year), tuple(f[0].trim), tuple(f[0].status)) == (("1500", "string"), (None, "null"), (None, "missing"), ("1", "boolean"))
    assert tuple(f[1].vin) == ("5", "number") and tuple(f[2].trim) == ('x "q" y', "string") and tuple(f[2].make) == (None, "missing")
    assert rows[0].batch_id == "bronze/source=dealer-feed-a/date=d1/x.ndjson.gz"


def test_load_benchmark_leaves_no_tables(spark, tmp_path):
    rows = load.generated(spark, 3, "2026-01-01")
    store = Store(spark, f"file://{tmp_path}/silver")
    took = load.loaded(store, store.stage("rows", rows))
    assert all(seconds > 0 for seconds in took.values())
    bulk, single = (sorted(map(tuple, store.table(name).collect())) for name in (load.BULK, load.SINGLE))
    assert bulk == single and len(bulk) == 3
    store.drop(load.BULK, load.SINGLE)
    assert store.current() == {} and not (tmp_path / "silver" / load.SINGLE).exists()
    assert [line.split(":")[0] for line in load.benchmark(spark, 2, "2026-01-01").splitlines()] == ["Bulk load", "Row by row", "Speedup"]
