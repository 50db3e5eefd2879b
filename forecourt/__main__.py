"""python -m forecourt COMMAND: schema, generate, extract, pipeline (or replay), gold, report, bench-queries, bench-load, vacuum."""

from __future__ import annotations

import argparse
import time
from datetime import datetime, timezone

from . import pipeline
from .plans import gold, load
from .schemas import SOURCES
from .session import session
from .sources import bronze, generator
from .sources.store import Store


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="forecourt")
    p.add_argument("--master")
    p.add_argument("--root", default="lake", help="folder or URI of bronze and silver")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    for flag, default in (("--seed", 42), ("--countA", 650_000), ("--countB", 350_000)):
        g.add_argument(flag, type=int, default=default)
    g.add_argument("--chaos", action="store_true")
    g.add_argument("--outDir", default="data")
    g.add_argument("--overlapRate", type=float, default=0.02)
    g.add_argument("--asOf", default=datetime.now(timezone.utc).strftime("%Y-%m-%d"))
    e = sub.add_parser("extract")
    e.add_argument("--list", action="store_true")
    e.add_argument("--partition", default=datetime.now(timezone.utc).strftime("%Y-%m-%d"))
    e.add_argument("--dir", default="data")
    for name in ("pipeline", "replay"):
        r = sub.add_parser(name)
        r.add_argument("--date")
        r.add_argument("--referenceYear", type=int)
    for name in ("schema", "gold", "vacuum"):
        sub.add_parser(name)
    m = sub.add_parser("report")
    m.add_argument("--run")
    b = sub.add_parser("bench-queries")
    b.add_argument("--label", default="run")
    o = sub.add_parser("bench-load")
    o.add_argument("--n", type=int, default=200)
    o.add_argument("--asOf", default=datetime.now(timezone.utc).strftime("%Y-%m-%d"))
    a = p.parse_args(argv)
    from os.path import abspath

    at = lambda path: path if ":" in path else abspath(path)
    root = at(a.root)
    spark = session(master=a.master)
    if a.command == "generate":
        generator.write(spark, at(a.outDir), a.chaos, seed=a.seed, count_a=a.countA, count_b=a.countB, overlap=a.overlapRate, as_of=a.asOf)
    elif a.command == "extract" and a.list:
        for source, objects, dates, rows in bronze.list_bronze(root):
            print(f"{source}: {objects} objects, {dates} dates, {rows} rows")
    elif a.command == "extract":
        for source in SOURCES:
            m = bronze.land(spark, f"{at(a.dir)}/{source}", root, source, a.partition)
            print(f"{source}: {m['totalObjects']} objects, {m['totalRows']} rows")
    elif a.command in ("pipeline", "replay"):
        print(pipeline.run(spark, root, a.date, a.referenceYear) or "Nothing to process.")
    elif a.command == "schema":
        print("Made:", ", ".join(Store(spark, f"{root}/silver").ensure_tables()) or "nothing")
    elif a.command == "vacuum":
        print("Deleted:", len(Store(spark, f"{root}/silver").vacuum()))
    elif a.command == "gold":
        for name, df in pipeline.refresh_gold(spark, root).items():
            print(name, df.count())
    elif a.command == "bench-load":
        print(load.benchmark(spark, a.n, a.asOf))
    elif a.command == "report":
        print(pipeline.report(spark, root, a.run))
    else:
        store = Store(spark, f"{root}/silver")
        listings, history = store.table("listings"), store.table("price_history")
        plans = {
            "browse": gold.browse(listings, "Honda", "Civic", (2018, 2022), "ON"), "make_stats": gold.make_stats(listings, "Toyota"), "vin_history": gold.vin_history(listings, history),
            "recent": gold.recent(listings, "QC"), "price_drops": gold.largest_drops(history),
        }
        for name, df in plans.items():
            begun = time.time()
            df.collect()
            print(f"{a.label} {name}: {1000 * (time.time() - begun):.1f} ms")


if __name__ == "__main__":
    main()
