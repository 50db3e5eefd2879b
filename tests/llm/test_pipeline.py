"""Each stage of the corpus pipeline against brute force over what the stage before kept."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def test_stages_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and stages[-1].columns == [*columns, "shard", "slot"]


def test_quality_rejects_bad_and_keeps_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0].collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.99 * len(good) and sum(d in kept for d in bad) <= 0.05 * len(bad)


def test_one_of_each_component_stays(stages):
    from forecourt.llm import simhash
    from tests.llm.test_ops import brute_components

    prints = {r.doc_id: (r.w0 & 2**64 - 1) | (r.w1 & 2**64 - 1) << 64 for r in simhash.fingerprints(stages[0], 5, 2).collect()}
    ids, kept = sorted(prints), {r.doc_id for r in stages[1].collect()}
    low = {}
    for i, t in zip(ids, brute_components([prints[i] for i in ids], 22), strict=True):
        low.setdefault(t, i)
    assert set(low.values()) == kept  # all within 22 bits are linked, and none beyond


def test_pairs_spread_over_all_blocks_are_linked(spark, monkeypatch):
    from forecourt.llm import simhash

    rng, prints = np.random.default_rng(5), []
    for _ in range(100):  # each pair is 22 bits apart, three or four in every block
        pair = np.stack([rng.integers(0, 2**63, 2).astype(np.uint64)] * 2)
        for (word, (at, width)), n in zip(itertools.product((0, 1), simhash.BLOCKS), rng.permutation([3, 3, 4, 4, 4, 4]).tolist(), strict=True):
            pair[1, word] ^= np.uint64(sum(1 << at + int(i) for i in rng.choice(width, n, replace=False)))
        prints += list(pair)
    prints = np.array(prints)
    rows = [(i, *map(int, r)) for i, r in enumerate(np.column_stack((simhash.node_numbers(prints), prints)).view(np.int64))]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, fp long, w0 long, w1 long"))
    kept = P.without_near_duplicates(spark, spark.range(len(rows)).withColumnRenamed("id", "doc_id"), SF)
    assert {r.doc_id for r in kept.collect()} == set(range(0, len(rows), 2))


def test_similar_documents_do_not_both_stay(stages):
    def shingles(text):
        w = text.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    docs = {r.doc_id: shingles(r.text) for r in stages[0].collect()}
    kept, by = {r.doc_id for r in stages[1].collect()}, {}
    for i, s in docs.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() if len(v) < 50 for a in v for b in v if a < b}
    near = [(a, b) for a, b in pairs if len(docs[a] & docs[b]) >= 0.8 * len(docs[a] | docs[b])]
    assert near and sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
    least = min(docs)
    assert least in kept and all(any(len(docs[i] & docs[k]) >= 0.3 * len(docs[i] | docs[k]) for k in docs if k < i) for i in set(docs) - kept)


def test_no_benchmark_passage_stays(spark, stages):
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in stages[1].collect() if any(i in flat(r.text) for i in items)}
    gone = {r.doc_id for r in stages[1].collect()} - {r.doc_id for r in stages[2].collect()}
    assert leaked and leaked <= gone and len(gone) <= len(leaked) + 2


def test_mix_takes_whole_documents_up_to_twice(stages):
    before, n = {r.doc_id for r in stages[2].collect()}, Counter(r.doc_id for r in stages[3].collect())
    assert set(n) <= before and max(n.values()) <= 2 and len(n) > 0.5 * len(before)


def test_shards_are_equal(stages):
    size = Counter()
    for r in stages[4].collect():
        size[r.shard] += len(r.text.encode()) + 1
    longest = max(len(r.text.encode()) for r in stages[4].collect())
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * longest


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.shard) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages[-1]) and P.ORACLE_SQL is None


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, name, stage):
    from pyspark.sql import functions as F

    rows = [(1, None, None, None), (2, "", "en", ""), (None, "a b c", "en", "s"), (3, "a b c", "de", "s"), (3, "a b c", "de", "s"), (4, "word " * 40_000, None, "s"), (5, " \t ", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "shard": F.lit("x"), "slot": F.lit(1), "label": F.lit(2), "_slots": F.lit(3), "fp": F.lit(4), "score": F.lit(None).cast("double")})
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 2 * len(rows)
    assert {r.doc_id for r in out.collect()} <= {None, 1, 2, 3, 4, 5}
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    if name == "sharding":
        assert out.columns[-2:] == ["_shard", "_slot"] and out.count() == len(rows)
