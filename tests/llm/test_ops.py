"""The operators against brute force, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forecourt.llm import decontaminate, ftrl, language, licenses, mixing, prefix, quality, sharding, simhash, token_counts, topk, warc
from forecourt.llm.queries import QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def docs(spark, *texts, ids=None, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), None) for i, t in zip(ids or range(len(texts)), texts, strict=False)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = ["", None, " \t\n", "a", "a b c", "x " * 30_000, "Ünïcode   text é", "<|endoftext|> end", "\U0001f600\U0001f600", "a b c", "a\x00b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and columns whose names the operators use inside."""
    d = docs(spark, *ODD, ids=[*range(len(ODD) - 1), None]).union(docs(spark, "a b c", ids=[4]))
    return d.withColumns({"fp": F.lit(1), "_size": F.lit("x"), "shard": F.lit(9), "label": F.lit(0), "words": F.lit("w"), "component_id": F.lit(3), "_slots": F.lit(2), "_c0": F.lit(1), "held_out": F.lit(True)})


def empty(spark):
    return spark.createDataFrame([], DOC)


# 1. Archives


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u\r\nx", "z" * 3_000_000), (None, "u", big), (2, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("keeper", F.lit(1))
    index = warc.write_archives(pages, str(tmp_path), frame=4096, bundle=1 << 16)
    got = warc.read_archives(index, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert by[i, len(data)].payload_digest == hashlib.sha1(data).hexdigest()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), *((i, "response", None) for i in range(3, 8))]
    (fields, payload), = warc.fetch(index, str(tmp_path), 7)
    assert payload == b"z" * 3_000_000 and fields["WARC-Type"] == "response" and warc.fetch(index, str(tmp_path), 99) == []


def test_archives_of_pages_with_other_ids(spark):
    big = "x" * 1000
    rows = [("a b\r\n", big), ("é>", big), ("", "s"), (None, "s")]
    got = warc.round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string")).collect()
    assert sorted((r.page_id or "", r.record_type, r.refers_to) for r in got) == [("", "response", None), ("", "response", None), ("a b\r\n", "revisit", "é>"), ("é>", "response", None)]


def test_archives_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, str(tmp_path)), str(tmp_path)).count() == 0


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(pages, str(tmp_path), frame=2000)
    (file,) = tmp_path.glob("*.zst")
    content = zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True).read()
    assert content.count(b"WARC/1.1\r\n") == 40
    with file.open("rb") as f:
        frames = warc.read_seek_table(f, file.stat().st_size)
    assert sum(x[2] for x in frames) == len(content) and len(frames) == index.agg(F.max("frame")).first()[0] + 1 > 5


# 2. Language


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(spark, odd):
    train = docs(spark, *(["the cat and the dog "] * 20 + ["der hund und die katze "] * 20), langs={i: "de" for i in range(20, 40)})
    out = language.identify(odd, language.fit(train)).collect()
    assert len(out) == len(ODD) + 1
    assert Counter(r.lang_pred for r in out if r.doc_id in (0, 1, 2, 8)) == {"und": 4} and all(0 <= r.score <= 1 for r in out)
    assert language.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_lang_and_source_of_what_it_predicts(spark, real):
    m = language.fit(real)
    a = language.identify(real, m).orderBy("doc_id").collect()
    b = language.identify(real.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")}), m).orderBy("doc_id").collect()
    assert a == b


def brute_grams(text):
    """Bucket of every character 1- to 3-gram of the folded text, one by one."""
    low = lambda c: (c.lower() if len(c.lower()) == 1 else c) if ord(c) < 1 << 16 and c.isalpha() else c if ord(c) >= 1 << 16 else " "
    t = " " + re.sub(" +", " ", "".join(map(low, text)) + " ").lstrip(" ")
    for i in range(len(t)):
        h = 0
        for n in range(1, 4):
            if i + n <= len(t):
                h = (h * 0x100000001B3 + ord(t[i + n - 1]) + n) % 2**64
                yield (h * 0x9E3779B97F4A7C15 % 2**64) >> 49


def test_language_scores_are_dot_products(spark, real, odd):
    m = language.fit(real)
    some = real.limit(40).union(odd.select(real.columns).withColumn("doc_id", F.col("doc_id") + 10**6)).union(docs(spark, "𐐀 😀x", "ÄÖ ü", "İ", ids=[-1, -2, -3]))
    got = {(r.doc_id, r.text): r for r in language.identify(some, m).join(some.select("doc_id", "text"), "doc_id").collect()}
    assert len(got) > 40
    for (_, text), r in got.items():
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        b = list(brute_grams(text))
        logits = sum(n * m.weights[k].astype(float) for k, n in Counter(b).items()) / len(b) + m.bias
        p = np.exp((logits - logits.max()) / m.heat)
        assert r.lang_pred == m.names[int(p.argmax())], (r, text[:50])
        assert r.score == pytest.approx(p.max() / p.sum(), abs=1e-6)


def test_language_never_learns_from_held_out_rows(spark, real):
    spoiled = real.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    a, b = language.fit(real), language.fit(spoiled)
    assert a.names == b.names and np.array_equal(a.weights, b.weights) and a.heat == b.heat


def test_ngrams_are_whole_in_pieces(monkeypatch):
    g = language.Grams()
    text = "Ärger, über 12 das Öl!  " * 50
    whole = np.bincount(np.concatenate(list(g.buckets(text))), minlength=language.SIZE)
    monkeypatch.setattr(language, "PIECE", 37)
    assert np.array_equal(whole, np.bincount(np.concatenate(list(g.buckets(text))), minlength=language.SIZE))


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        y = int(rng.integers(3))
        idx = np.unique(np.append(rng.integers(10, 200, 8), y))
        rows.append((idx, np.ones(len(idx)), y))
    m = ftrl.Ftrl(200, 3, l1=1.0).fit(rows, 3)
    w = m.weights()
    assert np.mean([np.argmax(v @ w[i] + w[-1]) == y for i, v, y in rows]) > 0.97 and (w[10:200] == 0).mean() > 0.5


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 4000)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(ftrl.temperature(np.log(p) * 4, y) - 4) < 0.6 and ftrl.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1


# 3. SimHash


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, threshold):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def test_simhash_is_brute_force(spark, real):
    rows = real.select("doc_id", "text").collect()
    want = [brute_print(r.text) for r in rows]
    top = brute_components(want, 4)
    low = {}
    for r, t in zip(rows, top, strict=True):
        low[t] = min(low.get(t, r.doc_id), r.doc_id)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(real).collect()}
    assert got == {r.doc_id: (w, low[t]) for r, w, t in zip(rows, want, top, strict=True)}


def schemes(threshold, words=1):
    """Anchors of single blocks, and of two at once."""
    return [simhash.scheme(words, threshold, 0), simhash.scheme(words, threshold, 1 << 60)]


@pytest.mark.parametrize("double", [False, True])
@pytest.mark.parametrize("threshold", [0, 2, 4, 5])
def test_links_connect_all_that_are_near(spark, monkeypatch, threshold, double):
    monkeypatch.setattr(simhash, "CELL", 16)  # many tiles for each crowded anchor
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "MOST_COPIES", 1000)
    way = schemes(threshold)[double]
    assert len(way.groups[0]) == 1 + double
    rng = np.random.default_rng(threshold)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = {0, (1 << 64) - 1} | set(base)
    for b in base[:6]:  # crowds, and chains that wander off
        for _ in range(60):
            b ^= sum(1 << int(i) for i in rng.choice(64, rng.integers(1, threshold + 2), replace=False))
            prints.add(b)
    prints = sorted(prints)
    signed = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(signed, threshold, way)).collect()}
    mine = [roots.get(v := int(np.uint64(p).astype(np.int64)), v) for p in prints]
    want = brute_components(prints, threshold)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


@pytest.mark.parametrize("cell", [1, 4, 16, 2048])
def test_lone_pairs_in_crowded_anchors_are_linked(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng, prints = np.random.default_rng(cell), set()
    for _ in range(100 if cell > 1 else 20):  # three bits in each block: at home at the zero anchor of all three
        p = sum(1 << at + int(i) for at, width in simhash.BLOCKS for i in rng.choice(width, 3, replace=False))
        on, off = ([i for i in range(21) if p >> i & 1 == b] for b in (1, 0))
        prints |= {p, p ^ 1 << int(rng.choice(on)) ^ 1 << int(rng.choice(off))}
    prints = sorted(prints)
    want = brute_components(prints, 4)
    assert len(set(want)) >= 0.4 * len(prints)  # mostly pairs
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    roots = {r.node: r.root for r in simhash.connected(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    mine = [roots.get(p, p) for p in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


@pytest.mark.parametrize("words, threshold", [(1, 4), (1, 5), (2, 22)])
def test_pairs_within_the_threshold_share_a_cell(monkeypatch, words, threshold):
    """Also with the copies of one side only within half the slack: one of each pair is a near copy."""
    monkeypatch.setattr(simhash, "MOST_COPIES", 1 << 20)
    rng = np.random.default_rng(words)
    for way in schemes(threshold, words)[: 1 + (words == 1)]:
        for _ in range(20 if words > 1 else 150):
            a = rng.integers(0, 2**63, words).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            b = a.copy()
            for bit in rng.choice(64 * words, threshold, replace=False):
                b[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            cells = {}
            for row, cell, near in simhash.anchors(np.stack((a, b)), way):
                for r, c, n in zip(row.tolist(), cell.tolist(), near.tolist(), strict=True):
                    cells.setdefault(c, []).append((r, n))
            assert any({0, 1} == {r for r, _ in v} and any(n for _, n in v) for v in cells.values())


def test_copies_are_as_many_as_reckoned():
    prints = np.random.default_rng(0).integers(0, 2**63, (500, 1)).astype(np.uint64)
    for way in schemes(4):
        assert sum(len(row) for row, _, _ in simhash.anchors(prints, way)) / 500 == pytest.approx(way.copies(), rel=0.05)


def test_cells_over_many_batches(spark, monkeypatch):
    """Cells of a few and of many rows, cut by the batches that reach Python."""
    monkeypatch.setattr(simhash, "SHORT", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = np.random.default_rng(3)
        base = [int(x) for x in rng.integers(0, 2**62, 30)]
        prints = sorted({b ^ (1 << int(i)) for b in base for i in rng.integers(0, 64, 6)})
        signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
        roots = {r.node: r.root for r in simhash.connected(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
        mine, want = [roots.get(p, p) for p in signed], brute_components(prints, 4)
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(simhash, "written", lambda df, name, files=None, f=simhash.written: tables.append(name) or f(df, name, files))
    chain = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")
    assert {r.root for r in simhash.connected(chain).collect()} == {0}
    assert len(tables) < 15


def test_all_bits_of_further_words_are_used(spark):
    prints = simhash.fingerprints(docs(spark, *(f"word{i}" for i in range(200))), words=2).collect()
    for w in ("w0", "w1"):
        assert {b for r in prints for b in range(64) if r[w] >> b & 1} == set(range(64))


def test_golay_code_covers():
    cover = simhash.Covering(0)
    assert np.array_equal(np.diff(cover.first[:2049]), np.ones(2048)) and not cover.over.any()  # one pattern of at most 3 bits for each syndrome


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=5, deadline=None)
def test_components(spark_links, edges):
    spark_links(edges)


@pytest.fixture(scope="module")
def spark_links(spark):
    def run(edges):
        got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        parent = {x: x for e in edges for x in e}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
        assert {x: got.get(x, x) for x in parent} == {x: top(x) for x in parent}

    return run


def test_simhash_of_odd_texts(spark, odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) + 1
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {0, 1, 2} and {r.component_id for r in zero} == {0}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 9").count() == 0 and kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


# 4. Shards


def check_shards(rows, n=8):
    total = sum(r._size for r in rows)
    by = Counter()
    for r in rows:
        by[r._shard] += r._size
    for s in range(n):
        slots = sorted(r._slot for r in rows if r._shard == s)
        assert slots == list(range(len(slots)))
        assert abs(by[s] - total / n) <= max(r._size for r in rows)


def test_shards_are_contiguous_and_equal(spark, real):
    rows = sharding.shard(real.repartition(5)).collect()
    assert len(rows) == real.count()
    check_shards(rows)
    for r in rows:
        data = (r.text or "").encode()
        assert (r._size, r._crc) == (len(data) + 1, zlib.crc32(data))
    assert len({r._crc for r in rows}) == len({r.text or "" for r in rows})  # so the second hash decides nothing here
    order = sorted(rows, key=lambda r: (r._crc, r.doc_id))
    start, total = 0, sum(r._size for r in rows)
    for r in order:
        assert r._shard == min(7, math.floor(8 * (2 * start + r._size) / (2 * total)))
        start += r._size


def test_one_text_may_fill_many_shards(spark):
    rows = sharding.shard(docs(spark, *["same text"] * 500)).collect()
    check_shards(rows)


def test_shards_of_odd_texts(spark, odd):
    out = sharding.shard(odd)
    rows = out.collect()
    assert len(rows) == len(ODD) + 1 and out.columns[: len(odd.columns)] == odd.columns
    assert sharding.shard(empty(spark)).count() == 0
    assert [r["_shard"] for r in sharding.shard(docs(spark, None), carry=["doc_id"]).collect()] == [4]


# 5. Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Shares by weight; what a source cannot take is shared again by those that can."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    weigh = lambda i: weights[i % len(weights)]
    while open_:
        each = left / sum(map(weigh, open_))
        over = [i for i in open_ if each * weigh(i) > cap * sizes[i]]
        for i in over or open_:
            out[i] = cap * sizes[i] if over else each * weigh(i)
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000], [0, 0], [5], [0, 7, 3, 1, 10**9, 12, 4000], []])
def test_targets(spark, sizes):
    found = spark.createDataFrame([(f"s{i}" if i + 1 < len(sizes) else None, n) for i, n in enumerate(sizes)], "_name string, _n long")
    got = sorted((r._id, r._target, r._words) for r in mixing.source_goals(found, (3, 1, 2), 1.5, 2.0).collect())
    want = brute_targets(sizes)
    assert [g[1] for g in got] == pytest.approx(want) and all(abs(w - t) <= 0.5 for _, t, w in got)


def test_taken_words_are_brute_force(spark, real):
    """Each source's documents in their shuffled order, from the first again, until the target is reached to the word."""
    d = real.union(docs(spark, None, "", "one two", "x " * 5000, ids=[900_000, 900_001, None, 900_003], sources={900_000: "tiny", 900_001: "none", None: None, 900_003: None}))
    rows = {(r.doc_id, r.source): r for r in mixing.mix(d).collect()}
    order = d.select("doc_id", "source", F.xxhash64("doc_id", F.lit(17)).alias("place"), "text").collect()
    names = sorted({r.source for r in order if r.source is not None}) + [None]
    words = {k: len(WORD.findall(r.text or "")) for r in order for k in [(r.doc_id, r.source)]}
    sizes = [sum(n for (_, s), n in words.items() if s == name) for name in names]
    for name, size, target in zip(names, sizes, brute_targets(sizes), strict=True):
        own = sorted((r for r in order if r.source == name), key=lambda r: (r.place, r.doc_id))
        left, taken = min(round(target), 2 * size), Counter()
        while left and size:
            for r in own:
                n = min(left, words[r.doc_id, name])
                taken[r.doc_id] += n
                left -= n
        for r in own:
            got = rows[r.doc_id, name]
            assert (got._size, got._source_size, got._taken) == (words[r.doc_id, name], size, taken[r.doc_id]) and got._target == pytest.approx(target)


def test_thousands_of_sources_meet_their_targets(spark):
    n = lambda i: 1 + int(20_000 / (i + 1) ** 0.8)
    d = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN NULL ELSE concat('s', lpad(id, 5, '0')) END AS source", "repeat('w ', int(1 + 20000 / pow(id + 1, 0.8))) AS text")
    rows = {r.doc_id: r for r in mixing.mix(d, carry=["doc_id", "source"]).collect()}
    ids = [i for i in range(5000) if i != 7] + [7]
    want = dict(zip(ids, brute_targets([rows[i]._size for i in ids]), strict=True))
    assert len(rows) == 5000 and rows[3]._size == n(3)
    for i, r in rows.items():
        assert r._target == pytest.approx(want[i]) and abs(r._taken - r._target) <= 0.5 and r._taken <= 2 * r._size
        assert bool(r._slots) == (r._taken > 0)


def test_mix_meets_targets(spark, real):
    rows = mixing.mix(real).collect()
    again = {(r.doc_id, r._taken, tuple(r._slots)) for r in mixing.mix(real.repartition(7)).collect()}
    assert again == {(r.doc_id, r._taken, tuple(r._slots)) for r in rows}
    names = sorted({r.source for r in rows})
    sizes = {s: sum(r._size for r in rows if r.source == s) for s in names}
    want = dict(zip(names, brute_targets([sizes[s] for s in names]), strict=True))
    for s in names:
        own = [r for r in rows if r.source == s]
        assert {r._source_size for r in own} == {sizes[s]} and own[0]._target == pytest.approx(want[s])
        assert sum(r._taken for r in own) == pytest.approx(want[s], rel=0.01, abs=20)
    for r in rows:
        assert r._size == len(WORD.findall(r.text or "")) and 0 <= r._taken <= 2 * r._size and len(r._slots) <= 2


def test_every_stretch_of_the_schedule_is_balanced(spark):
    d = docs(spark, *["w " * 10] * 300, sources={i: "abc"[i % 3] for i in range(300)})
    rows = mixing.mix(d, slots=600).collect()
    slots = sorted((s, r.source) for r in rows for s in r._slots)
    for a in range(0, len(slots) - 100, 100):
        n = Counter(x for _, x in slots[a : a + 100])
        assert abs(n["a"] - 100 * 200 / 450) < 12 and abs(n["b"] - 100 * 83 / 450) < 12


def test_small_sources_meet_their_targets(spark):
    texts = ["w " * 40_000] * 300 + ["v " * 5] * 12 + ["u", None]
    d = docs(spark, *texts, sources={i: "big" if i < 300 else f"s{i % 3}" if i < 312 else "tz"[i - 312] for i in range(len(texts))})
    rows = mixing.mix(d).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert sum(r._target for r in rows if r.source == "s0") > 0 and len(by) == 6
    for own in by.values():
        assert abs(sum(r._taken for r in own) - own[0]._target) <= 0.5
        assert sum(r._size * len(r._slots) for r in own) == pytest.approx(own[0]._target, abs=max(r._size for r in own))
    last = max(s for r in by["big"] for s in r._slots)
    slots = sorted(s for r in by["s0"] + by["s1"] + by["s2"] for s in r._slots)
    assert len(slots) == 24 and slots[0] < last / 4 and slots[-1] > 3 * last / 4
    assert Counter(r.source for r in mixing.mixed_rows(d).collect() if r.source != "big") == {"s0": 8, "s1": 8, "s2": 8, "t": 2}


def test_mix_of_odd_texts(spark, odd):
    out = mixing.mix(odd.withColumn("source", F.when(F.col("doc_id") > 3, "z")))
    assert out.count() == len(ODD) + 1 and mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(docs(spark, None, "")).agg(F.sum("_taken")).first()[0] == 0


# 6. Search


def brute_top(rows, k=10, every=100):
    out = []
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in whole:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_is_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_top([(r.vec_id, r.embedding) for r in e.collect()])
    assert sorted(map(tuple, topk.top_k(e).collect())) == want
    assert sorted(map(tuple, topk.top_k(e, block=2, step=7).collect())) == want


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(100, [1.0] * 5), (200, [1.0] * 5), (300, [1.0, 2.0]), (400, []), (500, None), (600, [None, 1.0]), (700, [float("nan")]), (800, [float("inf")]), (None, [1.0]), (61, [1.0] * 5), (62, [1.0] * 5)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    assert sorted(map(tuple, topk.top_k(e).collect())) == brute_top([(r.vec_id, r.embedding) for r in e.collect()])
    assert topk.top_k(e.limit(0)).count() == 0


def test_scores_beyond_a_long_are_clamped(spark):
    rows = [(0, [1e16, 1.0]), (100, [-3.0, 1e300]), (1, [1e16, 0.5]), (2, [-1e16, 3.0]), (3, [1.0, 1.0]), (4, [1e15, -1e300]), (5, [1.7e308, 0.0]), (6, [0.0, 0.0]), (7, [2e6, 2e6])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x)
    want = []
    for q, a in rows:
        if q % 100 == 0:
            scored = [(min(max(sum(whole(x) * whole(y) for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1), i) for i, b in rows if i != q]
            want += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:10])]
    assert sorted(map(tuple, topk.top_k(e).collect())) == sorted(want)


def test_first_bounds_lose_nothing(spark, monkeypatch):
    """Many queries, so that the sample gives bounds; ties at the bound stay."""
    monkeypatch.setattr(topk, "SAMPLE", 12)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(e, every=5, k=4, step=2).collect()))
    assert got == brute_top(rows, 4, 5)


# 7. Decontamination


def brute_tiles(doc, item, least):
    """Greedy string tiling as it is defined: the longest unmarked common run first."""
    used_d, used_i, found = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return found
        found.append((a, b, n))
        used_d |= set(range(a, a + n))
        used_i |= set(range(b, b + n))


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_tiles_are_greedy(doc, item):
    d, i = (np.array(x, np.uint64) for x in (doc, item))
    assert decontaminate.tiles(d, i, 3) == brute_tiles(doc, item, 3)


def test_repetitive_texts_take_little_memory():
    import time
    import tracemalloc

    words = decontaminate.Words()
    items = decontaminate.Items([(1, b"a " * 200), (2, b"a b " * 100), (3, b"c " * 50)])
    doc = words.hashes(b"a " * 500_000)
    begun = time.time()
    tracemalloc.start()
    got = items.find(doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x[0], x[1], x[3]) for x in got] == [(1, 200, [(0, 0, 200)])] and peak < 200e6 and time.time() - begun < 20


def brute_found(text, item, least=5, coverage=0.8):
    flat = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    d, i = flat(text), flat(item)
    got = brute_tiles(d, i, min(least, len(i)))
    n = sum(t[2] for t in got)
    return (n, len(i), sorted(got)) if i and n >= coverage * len(i) else None


def test_contamination_is_brute_force(spark):
    """Whole rows of the operator, over documents of few words, so that passages repeat, overlap and are reordered."""
    rng = np.random.default_rng(4)
    vocabulary = ["ab", "cd", "ef", "GH", "é", "12"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(f"i{k}", text(n)) for k, n in enumerate((3, 4, 6, 8, 8, 10, 12, 20))]
    texts = [text(n) for n in rng.integers(1, 60, 30)]
    for _, x in items:
        w = x.split()
        texts += [f"{text(4)} {x} {text(3)}", " ".join(w[len(w) // 2 :] + ["zz"] + w[: len(w) // 2]), f"{x}, {x}! {x}"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {(i, k): f for i, t in enumerate(texts) for k, x in items if (f := brute_found(t, x))}
    got = {(r.doc_id, r.item_id): (r.covered, r.words, sorted(map(tuple, r.tiles))) for r in decontaminate.contamination(docs(spark, *texts), bench).collect()}
    assert got == want and len(want) > 20
    for block_words in (decontaminate.BLOCK_WORDS, 20):  # in one block, and in several with a filter before them
        kept = decontaminate.without_contaminated(docs(spark, *texts), bench, block_words=block_words)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})
    some = decontaminate.contamination(docs(spark, *texts), bench, block_words=20)
    assert {(r.doc_id, r.item_id): (r.covered, r.words, sorted(map(tuple, r.tiles))) for r in some.collect()} == want


def test_filter_of_seeds_misses_none():
    rng, bloom = np.random.default_rng(6), decontaminate.Bloom(1 << 14)
    seeds = rng.integers(0, 2**63, 500).astype(np.uint64)
    items = [rng.integers(0, 2**63, 9).astype(np.uint64) for _ in range(60)]
    for x in items:
        bloom.add(decontaminate.rolling(x, 5), 5)
    assert all(bloom.any(np.concatenate((seeds[:7], x[2:7], seeds[7:9]))) for x in items) and not bloom.any(seeds[:4])
    assert sum(bloom.any(seeds[i : i + 5]) for i in range(495)) < 25


def test_leaks_are_found_in_any_order(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    texts = [
        f"before {item.upper()} after", "x " + " ".join(w[8:]) + " y z " + " ".join(w[:8]), " ".join(w[:9]), "nothing of it here at all", None, "", "pre, " + ", ".join(w) + "!", ("filler " * 50_000) + item,
        " ".join(x for i, x in enumerate(w) if i != 7), " ".join(x for i, x in enumerate(w) if i % 3), "only three words",
    ]
    bench = spark.createDataFrame([(1, item), (2, "only three words"), (3, None), (4, "..."), (1, item)], "item_id long, text string").withColumn("words", F.lit(1))
    got = decontaminate.contamination(docs(spark, *texts), bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 1), (1, 1), (6, 1), (7, 1), (8, 1), (10, 2)]
    assert got.where("doc_id = 1").first().tiles[0].words == 8
    some = decontaminate.contamination(docs(spark, *texts), bench, block_words=2)  # a block for each few items
    assert sorted((r.doc_id, r.item_id) for r in some.collect()) == sorted((r.doc_id, r.item_id) for r in got.collect())
    clean = decontaminate.without_contaminated(docs(spark, *texts), bench)
    assert {r.doc_id for r in clean.collect()} == {2, 3, 4, 5, 9}


def test_decontamination_of_odd_tables(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(odd, bench).count() == 0 and decontaminate.without_contaminated(odd, bench).count() == len(ODD) + 1
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0 and decontaminate.contamination(empty(spark), bench).count() == 0


def test_real_leaks_hold_their_item(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r.item_id: flat(r.text) for r in bench.collect()}
    texts = {r.doc_id: flat(r.text) for r in real.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(real, bench).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got


# 8. Tokens


def test_the_sample_decides_no_count(spark, real, monkeypatch):
    counts = lambda: sorted(map(tuple, token_counts.count_tokens(real, vocabulary_path(), 2048).collect()))
    want, some = counts(), token_counts.head_of(real, vocabulary_path(), 1 << 18, 20)
    assert 0 < len(some[0]) < 10_000
    monkeypatch.setattr(token_counts, "head_of", lambda *_: some)
    assert counts() == want


def test_counts_are_the_library_s(spark, real, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    want = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    strange = ["İstanbul ΣΑΣ ς ﬁ", "é Å Å", "<|startoftext|>a<|endoftext|><|ENDOFTEXT|>", "it's I'VE x''s '", "1234 ٣٤ Ⅷ ½", "\x1c\x1d\u0085   a​b", "日本語 한국어 ไทย", "a" * 20_000, "!?" * 5_000, "ªº­–—‘’"]
    for d in (real, odd, docs(spark, *strange)):
        for head in (0, 3, token_counts.HEAD):
            texts = sorted(((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), want(r.text)) for r in d.collect()), key=repr)
            got = token_counts.count_tokens(d, vocabulary_path(), 2048, head).collect()
            assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got), key=repr) == texts
            assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(empty(spark), vocabulary_path(), 5).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_pre_tokens_are_the_library_s(text):
    from tokenizers import Tokenizer

    global TOK, CUT
    if "TOK" not in globals():
        TOK, CUT = Tokenizer.from_file(vocabulary_path()), token_counts.PreTokenizer(vocabulary_path())
    parts, special = CUT.cut(text)
    assert sum(map(CUT.pieces, parts)) + special == len(TOK.encode(text, add_special_tokens=False).ids), unicodedata.normalize("NFC", text)


# 9. Quality


def test_quality_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, labels).join(labels, "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("quality") == F.col("predicted"))).first()
    assert right / n > 0.95
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and kept.count() == quality.classify(d, labels).where("predicted = 1").count()


def test_quality_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 0), (0, 0, 0), (None, 1, 0), (6, 0, 1), (6, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    out = quality.classify(odd, labels).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0 and quality.keep_good(odd, labels).columns == odd.columns


def brute_features(text):
    """Buckets of the word and shape n-grams, one word after the other."""
    size, odd, mask = 64 - quality.BITS, 0x9E3779B97F4A7C15, 2**64 - 1
    words, shapes, before = [1], [1 << 20, 1 << 20], 1
    mark = lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
    for w in re.findall(rb"[^\x20\x09-\x0d]+", text):
        h = sum((b + 32 if 65 <= b <= 90 else b) * pow(odd, j, 2**64) + pow(odd, j, 2**64) for j, b in enumerate(w)) & mask
        m, u = sum(map(mark, w)), sum(65 <= b <= 90 for b in w)
        case = 0 if u == 0 else 1 if u == 1 else 2 if u + m >= len(w) else 3
        shape = ((case * 256 + (w[-1] if mark(w[-1]) else 0)) * 4 + min(m, 3)) * 4 + min(max(len(w) - m, 0) // 4, 3)
        words.append(h)
        shapes.append(shape + (h == before) * (1 << 16))
        before = h
    for i in range(1, len(words)):
        two = (shapes[i] * (1 << 21) + shapes[i + 1]) & mask
        for salt, key in enumerate((words[i], words[i - 1] * 3 & mask ^ words[i], shapes[i + 1], two, (shapes[i - 1] * (1 << 42) + two) & mask)):
            yield ((((key + salt + 1) * odd & mask) ^ (key >> 29)) * 0xD6E8FEB86659FD93 & mask) >> size


def test_quality_scores_are_dot_products(spark, real, odd):
    m = quality.fit(real, spark.read.parquet(f"{SF}/labels.parquet"))
    some = real.limit(40).union(odd.select(real.columns).withColumn("doc_id", F.col("doc_id") + 10**6).where("length(text) < 1000 or text is null")).union(docs(spark, "THE cat!! the the THE, é-é ...", ids=[-1]))
    got = quality.classify(some, real.limit(0), m).join(some.select("doc_id", "text"), "doc_id").collect()
    assert len(got) > 45
    for r in got:
        b = list(brute_features((r.text or "").encode()))
        logit = quality.GAIN * sum(float(m.weights[k]) for k in b) / max(1, len(b)) + m.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6) and r.predicted == int(r.score >= 0.5)


def test_quality_never_learns_from_held_out_rows(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(real, labels), quality.fit(real, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    f = quality.Features()
    words = [h for h, _ in f.words(b"Same same  other same")]
    h = np.concatenate(words)
    assert h[0] == h[1] == h[3] != h[2]
    whole = sorted(np.concatenate(list(f.buckets(b"The cat!! sat *** on  the the mat. " * 40))))
    monkeypatch.setattr(quality, "PIECE", 256)
    assert sorted(np.concatenate(list(quality.Features().buckets(b"The cat!! sat *** on  the the mat. " * 40)))) == whole


# 10. Licenses


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = {}
    for p, label in licenses.PHRASES:
        q = p.split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                at.setdefault(label, []).append(i)
    places = [i for v in at.values() for i in v]
    labels, share = set(at), 0.0
    for t, label in licenses.TEMPLATES:
        s = set(t.split())
        block = licenses.block_length(t)
        assert block >= 2 * len(t.split())
        for i in range(0, max(1, len(words)), block // 2):
            got = len(s & set(words[i : i + block]))
            if got >= (len(s) if len(s) < licenses.WHOLE else math.ceil(licenses.THRESHOLD * len(s) - 1e-9)):
                labels.add(label)
                share = max(share, got / len(s))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(at)), ",".join(sorted(labels)), 1.0 if places else share


def test_scans_are_brute_force(spark, real, odd):
    made = docs(spark, "Released under the MIT License.", "UNDER\tthe (mit) license under the mit license", "cc-by-nc", "cc by", "Apache License, Version 2.0", "x " * 100 + "GNU General Public, License version 3 this work is licensed under the", "all rights reserved", "all the rights are reserved", "under the mit", "K" * 5, "K mit", "redistribution use in source and binary forms or without modification are permitted", *(["y"] * 3))
    texts = [t for t, _ in licenses.TEMPLATES]
    # Whole texts: as they are, within others, with words changed up to the threshold and beyond, in reverse, cut short.
    worn = lambda t, n: " ".join("zz" if i % n == 0 else w for i, w in enumerate(t.split()))
    long_ = docs(spark, *texts, *(f"{'x ' * 77}{t.title()}.{' y' * 99}" for t in texts), *(worn(t, n) for t in texts for n in (4, 9)), *(" ".join(reversed(t.split())) for t in texts), *(t[: len(t) * 2 // 3] for t in texts), " ".join(texts))
    for d in (real, odd, made, long_):
        want = sorted((brute_scan(r.text) for r in d.collect()), key=repr)
        got = licenses.scan(d).collect()
        assert sorted((tuple(r)[1:] for r in got), key=repr) == want
    assert licenses.scan(empty(spark)).count() == 0


def test_license_texts_are_told_apart(spark):
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, *(t for t, _ in licenses.TEMPLATES))).collect()}
    assert all(label in got[i].split(",") for i, (_, label) in enumerate(licenses.TEMPLATES))
    near = ["licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0", "released under the BSD license", "subject to the terms of the GNU General Public License, version 2.0"]
    assert [r.labels for r in sorted(licenses.scan(docs(spark, *near)).collect())] == ["cc-by", "", "", ""]


def test_scan_runs_no_python(spark, real):
    plan = licenses.scan(real)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# All


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n != "pipeline"])
def test_queries_cover_their_tables(spark, name):
    out = QUERIES[name](spark, SF)
    n = out.count()
    if name not in ("op1_warc", "op6_topk", "op7_decontamination"):
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
    elif name == "op1_warc":
        assert n == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("name", sorted(__import__("forecourt.llm.queries", fromlist=["ORACLES"]).ORACLES))
def test_queries_are_their_sql(spark, name):
    import duckdb

    from forecourt.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    df = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, got.fetchall()))


def test_staged_tables_can_be_dropped(spark):
    from pathlib import Path

    from forecourt.llm import common

    common.written(spark.range(3), "x").count()
    at = Path(common.shared_dir(spark).removeprefix("file://"), "forecourt", spark.sparkContext.applicationId)
    assert any(at.iterdir())
    common.drop_scratch(spark)
    assert not at.exists()


def test_many_partitions_in_few_files(spark, real):
    """Neighbouring partitions share a file; row keys and ranges must stay those of the partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        d = real.repartition(90)
        check_shards(sharding.shard(d).collect())
        want = {r.doc_id: (r._taken, tuple(r._slots)) for r in mixing.mix(real).collect()}
        assert {r.doc_id: (r._taken, tuple(r._slots)) for r in mixing.mix(d).collect()} == want
        tokens = lambda x: sorted(map(tuple, token_counts.count_tokens(x, vocabulary_path(), 2048, 50).collect()))
        assert tokens(d) == tokens(real)
        scans = lambda x: sorted(map(repr, licenses.scan(x).collect()))
        assert scans(d) == scans(real)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_grow_with_the_table(spark, real, monkeypatch):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert prefix.ranges_for(real) == most > 1
    monkeypatch.setattr(prefix, "RANGE_BYTES", 1 << 40)
    assert prefix.ranges_for(real) == prefix.ranges_for(real.limit(0)) == 1
