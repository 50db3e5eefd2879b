"""Benchmark decontamination by greedy string tiling.

Words of benchmark items and documents are hashed; every run of `MATCH` words that a
document shares with an item is a seed (a broadcast hash join: the items are handled
in blocks of at most `BLOCK_WORDS` words, so what is broadcast is bounded; if there are
several, a Bloom filter of all seeds first sets apart the documents that may hold any). Where the seeds
could reach the threshold, the item is tiled: the longest common run of words that no
tile covers yet becomes a tile, again and again (running Karp-Rabin: the longest length at
which equal rolling hashes are left is searched by halving, and all of that length are tiled
before a shorter one is tried). An item counts as found if tiles cover enough of it, in
whatever order its passages stand. Memory is in proportion to the text and the item,
however often their words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, utf8, written

#: Shortest run of words that counts as a match.
MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Benchmark words that are broadcast at once.
BLOCK_WORDS = 1 << 20
#: Bits of the filter of seeds at most.
MOST_BITS = 1 << 30
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> np.ndarray:
    """Per byte: 0 for all but letters, digits and bytes of other scripts; A-Z as a-z."""
    table = np.zeros(256, np.uint64)
    for b in (*range(48, 58), *range(97, 123), *range(128, 256)):
        table[b] = b
    table[65:91] = table[97:123]
    return table


class Words:
    """64-bit hashes of the words of a text: runs of letters and digits, A-Z as a-z."""

    def __init__(self):
        self.fold = _fold()
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def hashes(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        while len(self.power) < len(text):
            n = max(len(text), 1 << 16)
            self.power = np.cumprod(np.full(n, _ODD, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(int(_ODD), -1, 1 << 64), np.uint64))
        low = self.fold[np.frombuffer(text, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], low > 0, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * self.power[: len(low)])))
        word = (sums[end] - sums[start]) * self.inverse[start]
        return (word ^ (word >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class Runs:
    """Karp-Rabin hashes of the runs of words of a text, of any length, by prefix sums."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), _ODD, np.uint64))))
            inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), pow(int(_ODD), -1, 1 << 64), np.uint64))))
            # The prefixes' hashes, divided by a power for their length, so that they are plain sums.
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * inverse[1:])))

    def of(self, n: int) -> np.ndarray:
        """Hashes of all runs of n words, by their starts."""
        at = np.arange(max(0, len(self.sums) - n))
        return (self.sums[at + n] - self.sums[at]) * self.power[at] * self.power[n] if len(at) else np.zeros(0, np.uint64)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * _ODD + words[i : i + len(out)]
    return out


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n words of which none is used."""
    sums = np.concatenate(([0], np.cumsum(used)))
    return np.flatnonzero(sums[n:] == sums[: len(sums) - n])


def tiles(doc: np.ndarray, item: np.ndarray, least: int, barred: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in doc, start in item, length), longest first, none overlapping, none shorter than `least` or over a barred word of doc.

    Ties go to the smaller start in the document, then in the item.
    """
    in_doc, in_item, found = np.zeros(len(doc), bool) if barred is None else barred.copy(), np.zeros(len(item), bool), []
    runs_doc, runs_item = Runs(doc), Runs(item)

    def common(n: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Free starts in doc whose run is free in item too, all hashes in doc, and free starts in item with their hashes, sorted."""
        hashes, at = runs_doc.of(n), _free(in_item, n)
        own = runs_item.of(n)[at]
        order = np.argsort(own, kind="stable")
        own, at, some = own[order], at[order], _free(in_doc, n)
        if not len(own):
            return [], hashes, own, at
        place = np.minimum(np.searchsorted(own, hashes[some]), len(own) - 1)
        return some[own[place] == hashes[some]].tolist(), hashes, own, at

    top = min(len(doc), len(item))
    while top >= least:
        low, high = least - 1, top  # a common run of low words is left, or low is too short; none of more than high
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if common(n)[0] else (low, n - 1)
        if (top := low) < least:
            break
        some, hashes, own, at = common(top)
        left = {}
        for h, b in zip(own.tolist(), at.tolist(), strict=True):
            left.setdefault(h, []).append(b)
        for a in some:
            if not (starts := left.get(int(hashes[a]))) or in_doc[a : a + top].any():
                continue
            starts[:] = [b for b in starts if not in_item[b : b + top].any()]
            b = next((b for b in starts if np.array_equal(doc[a : a + top], item[b : b + top])), None)
            if b is not None:
                in_doc[a : a + top] = True
                in_item[b : b + top] = True
                found.append((a, b, top))
                if in_item.all():
                    return found
        top -= 1  # what is left of this length has been tried: no run of it is free in both
    return found


class Items:
    """Benchmark items and the sorted seeds in them. An item of fewer words than `least` is matched by its whole run."""

    def __init__(self, rows: list[tuple], least: int = MATCH, coverage: float = COVERAGE):
        self.ids, self.least, self.coverage = [r[0] for r in rows], least, coverage
        words = Words()
        self.words = [words.hashes(r[1]) for r in rows]
        self.sizes = sorted({min(least, len(w)) for w in self.words} - {0})
        self.seeds = {}
        for n in self.sizes:
            own = [(k, rolling(w, n)) for k, w in enumerate(self.words) if min(least, len(w)) == n]
            h = np.concatenate([x for _, x in own])
            item = np.concatenate([np.full(len(x), k) for k, x in own])
            at = np.concatenate([np.arange(len(x)) for _, x in own])
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            marks = np.zeros(1 << 20, bool)
            marks[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[n] = (h, item, at, marks)

    def find(self, doc: np.ndarray) -> list[tuple]:
        """(id, covered words, words, tiles) of each item found in the words of a document."""
        out = []
        for n in self.sizes:
            h, item, at, marks = self.seeds[n]
            runs = rolling(doc, n)
            some = np.flatnonzero(marks[(runs >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(h, runs[some])
            met = low < len(h)
            met[met] = h[low[met]] == runs[some][met]
            some = some[met]
            if not len(some):
                continue
            # Every seed of the items counts once, however often the document has it.
            own = np.unique(runs[some])
            low, high = np.searchsorted(h, own), np.searchsorted(h, own, side="right")
            seed = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            for k in np.unique(item[seed]):
                mine = seed[item[seed] == k]
                b, size = at[mine], len(self.words[k])
                reach = np.zeros(size + 1, np.int64)
                reach[b] += 1
                reach[b + n] -= 1
                if (np.cumsum(reach)[:size] > 0).sum() < self.coverage * size:
                    continue
                # Only the stretches of the document that hold the item's seeds, each with a barred word after it.
                starts = some[np.isin(runs[some], h[mine])]
                inside = np.zeros(len(doc) + 1, np.int64)
                inside[starts] += 1
                inside[starts + n] -= 1
                words = np.flatnonzero(np.cumsum(inside)[: len(doc)] > 0)
                gaps = np.flatnonzero(np.diff(words) > 1) + 1
                places = np.insert(words, gaps, -1)
                got = [(int(places[x]), y, m) for x, y, m in tiles(np.where(places < 0, np.uint64(0), doc[places]), self.words[k], n, places < 0)]
                covered = sum(t[2] for t in got)
                if covered >= self.coverage * size:
                    out.append((self.ids[k], covered, size, got))
        return out


class Bloom:
    """A set of seeds that may say yes wrongly, never no; at most `MOST_BITS`, whatever the number of seeds."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << max(10, min(MOST_BITS, bits).bit_length() - 1)) - 1)
        self.bytes, self.sizes = np.zeros((int(self.mask) + 1) // 8, np.uint8), set()

    def _places(self, seeds: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Byte and bit of each of the four probes."""
        at = (seeds ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        step = (at >> np.uint64(32)) | np.uint64(1)
        for _ in range(4):
            at = at + step
            spot = (at >> np.uint64(20)) & self.mask
            yield (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8)

    def add(self, seeds: np.ndarray, n: int) -> None:
        self.sizes.add(n)
        for byte, bit in self._places(seeds, n):
            np.bitwise_or.at(self.bytes, byte, bit)

    def any(self, doc: np.ndarray) -> bool:
        """Whether any run of the document's words may be a seed."""
        for n in self.sizes:
            maybe = np.ones(max(0, len(doc) - n + 1), bool)
            for byte, bit in self._places(rolling(doc, n), n):
                maybe &= self.bytes[byte] & bit > 0
            if maybe.any():
                return True
        return False


def seeds_of(items: DataFrame, blocks: int, least: int, n_bytes: int) -> Bloom:
    """The seeds of all items (item_id, text, block), gathered block by block."""
    bloom = Bloom(4 * n_bytes)
    for k in range(blocks):
        for n, (seeds, *_) in Items(_rows(items, k), least).seeds.items():
            bloom.add(np.unique(seeds), n)
    return bloom


def _rows(items: DataFrame, block: int) -> list[tuple]:
    return sorted((tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r))


def _in_blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int, int]:
    """The items, dealt to blocks by hash, with the number of blocks and of bytes. A block's words, and so its bytes, are bounded by the longest text besides."""
    own = benchmark.select("item_id", utf8("text").alias("text")).where("text is not null").distinct()
    n = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n // (6 * block_words)))
    return written(own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items"), blocks, n


def _may_hold(shared, wanted: bool):
    """The rows whose text may hold a seed, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bloom = Words(), shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            yield batch.filter(pa.array([bloom.any(words.hashes(t.as_py())) == wanted for t in texts], pa.bool_()))

    return run


def _find(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items = Words(), Items(*shared.value)
        for batch in batches:
            rows = [(k, *hit) for k, text in enumerate(batch.column(1)) for hit in items.find(words.hashes(text.as_py()))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], kind),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([[{"doc_at": a, "item_at": b, "words": n} for a, b, n in r[4]] for r in rows], pa.list_(pa.struct({"doc_at": pa.int64(), "item_at": pa.int64(), "words": pa.int64()}))),
                ],
                ["doc_id", "item_id", "covered", "words", "tiles"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, covered, words, tiles) for each row of docs and item of which tiles cover at least `coverage` of its words.

    docs: doc_id, text; benchmark: item_id, text; others are ignored. Null, empty and
    wordless texts match nothing, and an item without words is never found. Items of
    fewer than `least` words must occur as a whole. Repeated documents give a row each;
    repeated items (same id and text) count once. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own, blocks, n = _in_blocks(benchmark, block_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item_type.simpleString()}, covered long, words long, tiles array<struct<doc_at long, item_at long, words long>>"
    source, found = docs.select("doc_id", utf8("text").alias("text")), None
    if blocks > 1:
        bloom = spark.sparkContext.broadcast(seeds_of(own, blocks, least, n))
        source = written(source.mapInArrow(_may_hold(bloom, True), source.schema), "candidates")
    for k in range(blocks):
        part = source.mapInArrow(_find(spark.sparkContext.broadcast((_rows(own, k), least, coverage)), to_arrow_type(item_type)), schema)
        part = part if blocks == 1 else written(part, "found")
        found = part if found is None else found.union(part)
    return found


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items = Words(), Items(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [not items.find(words.hashes(t.encode() if (t := v.as_py()) else None)) for v in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item is found (see `contamination`); null texts stay."""
    spark = docs.sparkSession
    small_batches(spark)
    own, blocks, n = _in_blocks(benchmark, block_words)
    some = docs
    if blocks > 1:
        bloom = spark.sparkContext.broadcast(seeds_of(own, blocks, least, n))
        some = written(docs.mapInArrow(_may_hold(bloom, True), docs.schema), "candidates")
    for k in range(blocks):
        some = some.mapInArrow(_keep(spark.sparkContext.broadcast((_rows(own, k), least, coverage))), docs.schema)
    return some if blocks == 1 else docs.mapInArrow(_may_hold(bloom, False), docs.schema).union(some)
