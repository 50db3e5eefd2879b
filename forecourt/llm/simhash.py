"""SimHash near-duplicates by anchor-point covering.

The 64 fingerprint bits are cut into three coordinate blocks of 21, 22 and 21
bits; wider fingerprints are several such words. In each block the anchors are the
words of the perfect binary Golay code of length 23 (blocks are padded with zeros):
every point lies within the covering radius, 3, of exactly one anchor. Two points that
differ in s bits have a point between them, s // 2 bits from the one and the rest from
the other, whose anchor is within 3 + s // 2 of the one and 3 + s - s // 2 of the other.
So with copies at every anchor within the radius and half the slack, any pair that
differs in at most `slack` bits of a block meets at an anchor. The same holds for
groups of blocks, whose anchors are tuples. Slacks are chosen so that no pair
within the threshold can exceed all of them.

Crowded cells are cut into tiles, each compared by itself, and a cell gives a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8, written

#: First bit and width of each coordinate block.
BLOCKS = [(0, 21), (21, 22), (43, 21)]
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
RADIUS = 3
ANCHORS = 1 << 12
#: Rows of a cell's side, about, above which it is cut into tiles: a bound on a task's work, not on results.
CELL = 1 << 15
#: One fingerprint in so many is counted to find crowded cells.
SAMPLE = 16
#: Nanoseconds that a copy and a comparison of a word take, about; they only choose between equal results.
COPY_NS, COMPARE_NS = 2000.0, 4.0
#: Copies of a fingerprint that anchors of two blocks may make.
MOST_COPIES = 64


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text, as uint64; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()  # on bytes: A-Z, and exactly the six white-space bytes
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= k:
        return np.array([xxh(line, 42)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    return np.fromiter((xxh(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # each bit becomes a byte: in pieces, so that long texts need little memory
        some = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def word_names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def node_numbers(prints: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of words: a single word is its own number, several are hashed together."""
    out = prints[:, 0]
    for i in range(1, prints.shape[1]):
        out = _mix64(out, i) ^ (prints[:, i] * np.uint64(0x9E3779B97F4A7C15))
    return out


def _fingerprints(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros((batch.num_rows, words), np.uint64)
            for row, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py() or b"", k)
                for i in range(words):
                    # Further words are of hashes of the hashes.
                    prints[row, i] = majority_bits(hashes if i == 0 else _mix64(hashes, i))
            columns = [pa.array(prints[:, i].view(np.int64)) for i in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node_numbers(prints).view(np.int64)), *columns], ["doc_id", "fp", *word_names(words)])

    return run


def fingerprints(docs: DataFrame, k: int = 4, words: int = 1) -> DataFrame:
    """doc_id, the fingerprint's words w0, w1, ... (64 bits each, as signed longs), and fp, its number, per row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{c} long" for c in ("fp", *word_names(words)))
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(_fingerprints(k, words), f"doc_id {kind}, {schema}")


def _golay_syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


class Covering:
    """For each syndrome the error patterns of at most RADIUS + extra bits, nearest first, and how many bits over RADIUS each has."""

    def __init__(self, extra: int):
        sizes = range(RADIUS + extra + 1)
        shapes = [np.array([sum(1 << i for i in c) for c in itertools.combinations(range(23), w)], np.int64) for w in sizes]
        errors, over = np.concatenate(shapes), np.concatenate([np.full(len(x), max(0, w - RADIUS), np.int8) for w, x in zip(sizes, shapes, strict=True)])
        syndromes = _golay_syndromes(errors)
        order = np.argsort(syndromes, kind="stable")
        self.errors, self.over, self.first = errors[order], over[order], np.searchsorted(syndromes[order], np.arange(2049))


@functools.cache
def _covering(extra: int) -> Covering:
    """The covering, made once in each Python worker."""
    return Covering(extra)


def _around(points: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the point, anchor (12 bits) and bits over RADIUS, for all anchors within RADIUS + extra of points of 23 bits."""
    cover = _covering(extra)
    syndrome = _golay_syndromes(points)
    first, n = cover.first[syndrome], cover.first[syndrome + 1] - cover.first[syndrome]
    row = np.repeat(np.arange(len(points)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    return row, (points[row] ^ cover.errors[at]) >> 11, cover.over[at]


@dataclass(frozen=True)
class Scheme:
    """Groups of coordinate blocks, and for each group the bits in which a pair may differ there and be found."""

    groups: tuple[tuple[int, ...], ...]
    slacks: tuple[int, ...]

    def copies(self) -> float:
        """Copies of a fingerprint, on average."""
        return sum(_volume(len(g), s - s // 2) for g, s in zip(self.groups, self.slacks, strict=True))

    def pairs(self) -> float:
        """Comparisons for each pair of random fingerprints."""
        out = 0.0
        for g, s in zip(self.groups, self.slacks, strict=True):
            near, all_ = _volume(len(g), s // 2), _volume(len(g), s - s // 2)
            out += (near * all_ - near * near / 2) / ANCHORS ** len(g)
        return out


def _volume(blocks: int, extra: int) -> float:
    """Anchors, on average, whose distances from a point's blocks exceed RADIUS by `extra` bits in all at most."""
    shells = np.array([math.comb(23, RADIUS + e) if e else sum(math.comb(23, w) for w in range(RADIUS + 1)) for e in range(extra + 1)]) / 2048
    sums = np.ones(1)
    for _ in range(blocks):
        sums = np.convolve(sums, shells)[: extra + 1]
    return float(sums.sum())


def _shares(total: int, groups: int) -> tuple[int, ...]:
    """Slacks whose sum, with one more for each group, exceeds the total: no pair can exceed all of them."""
    each, more = divmod(total + 1, groups)
    return tuple(max(0, each - (i >= more)) for i in range(groups))


def scheme(words: int, threshold: int, n: int) -> Scheme:
    """The cheaper of two ways to find all pairs within the threshold among n fingerprints.

    Anchors of single blocks make few copies but long comparisons; anchors of two blocks at
    once (all pairs of the three blocks of a word, so that each block is in two groups) make more
    copies, of which 4,096 times fewer meet. Both find every pair; only n decides. The second is
    for small thresholds: beyond `MOST_COPIES` copies it is not taken.
    """
    single = tuple((b,) for b in range(3 * words))
    double = tuple((3 * w + i, 3 * w + j) for w in range(words) for i, j in ((0, 1), (0, 2), (1, 2)))
    ways = [Scheme(single, _shares(threshold, len(single))), Scheme(double, _shares(2 * threshold, len(double)))]
    return min((w for w in ways if w is ways[0] or w.copies() <= MOST_COPIES), key=lambda s: n * s.copies() * COPY_NS + float(n) * n * s.pairs() * words * COMPARE_NS)


def anchors(prints: np.ndarray, way: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the print, cell (group and anchors) and whether it is a near copy, for all copies, group by group."""
    blocks = list(itertools.product(range(prints.shape[1]), BLOCKS))
    for number, (group, slack) in enumerate(zip(way.groups, way.slacks, strict=True)):
        low, high = slack // 2, slack - slack // 2
        row, cell, over = np.arange(len(prints)), np.full(len(prints), number, np.int64), np.zeros(len(prints), np.int8)
        for b in group:
            word, (at, width) = blocks[b]
            points = ((prints[:, word] >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
            own, code, more = _around(points, high)
            n, firsts = np.bincount(own, minlength=len(prints)), np.searchsorted(own, np.arange(len(prints)))
            times = n[row]
            old = np.repeat(np.arange(len(row)), times)
            new = np.arange(len(old)) - np.repeat(np.cumsum(times) - times, times) + firsts[row[old]]
            total = over[old] + more[new]
            keep = total <= high
            row, cell, over = row[old[keep]], cell[old[keep]] << 12 | code[new[keep]], total[keep]
        yield row, cell, over <= low


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def _mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """All 64 bits, unlike _mix, which gives 31."""
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _uint64(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in columns], 1)


def _copies(way: Scheme, one_in: int = 1):
    """Rows (key, words) for all copies of the prints, or of one print in so many: the key is the cell, a bit for a tile's side, and one for near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything = _uint64(batch.columns)
            if one_in > 1:
                everything = everything[_mix(node_numbers(everything), 2) % np.uint64(one_in) == 0]
            for at in range(0, len(everything), 1024):
                prints = everything[at : at + 1024]
                for row, cell, near in anchors(prints, way):
                    words = prints[row].view(np.int64)
                    yield pa.RecordBatch.from_pydict({"key": cell << 2 | near} | {f"w{n}": np.ascontiguousarray(words[:, n]) for n in range(words.shape[1])})

    return run


class Joined:
    """Labels of points that are joined by links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i] for all i: the larger root goes below the smaller, until no pair is apart."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (up := label[label])).any():
                label[:] = up


def forest(prints: np.ndarray, near: np.ndarray, side: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to), as node numbers, that join the same points of a cell as all its pairs within the threshold do.

    Of a pair, one at least is a near copy; in a tile of two sides, one is of either.
    """
    numbers, joined = node_numbers(prints), Joined(len(prints))
    first = np.flatnonzero(near)
    step = max(1, (1 << 20) // len(prints))
    two = side.any() and not side.all()
    for at in range(0, len(first), step):
        some = first[at : at + step]
        apart = sum(np.bitwise_count(prints[some, None, i] ^ prints[None, :, i]) for i in range(prints.shape[1]))
        met = apart <= threshold
        if two:
            met &= side[some, None] != side[None, :]
        met &= joined.label[some, None] != joined.label[None, :]
        a, b = np.nonzero(met)
        joined.join(some[a], b)
    linked = np.flatnonzero(joined.label != np.arange(len(prints)))
    return numbers[linked], numbers[joined.label[linked]]


#: Cells of at most so many rows are compared together, by distance in the sorted rows.
SHORT = 32


def cell_links(cell: np.ndarray, prints: np.ndarray, near: np.ndarray, side: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many whole cells; `cell` is sorted."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
    length = np.diff(cuts)
    found = []
    for a, b in zip(cuts[:-1][length > SHORT].tolist(), cuts[1:][length > SHORT].tolist(), strict=True):
        found.append(forest(prints[a:b], near[a:b], side[a:b], threshold))
    short = np.flatnonzero(np.repeat((length > 1) & (length <= SHORT), length))
    cell, prints, near, side = cell[short], prints[short], near[short], side[short]
    numbers = node_numbers(prints)
    for lag in range(1, SHORT):
        same = np.flatnonzero(cell[lag:] == cell[:-lag])
        if not len(same):
            break
        apart = sum(np.bitwise_count(prints[same, i] ^ prints[same + lag, i]) for i in range(prints.shape[1]))
        met = same[(apart <= threshold) & (near[same] | near[same + lag])]
        found.append((numbers[met], numbers[met + lag]))
    return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.uint64)]) for i in range(2))


def _links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def joined(parts):
            x, y = cell_links(*(np.concatenate([p[i] for p in parts]) for i in range(4)), threshold)
            return pa.RecordBatch.from_pydict({"a": x.view(np.int64), "b": y.view(np.int64)})

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Rows are sorted by cell and tile; they are numbered by the changes of either, on from the batch before.
            place = np.stack((key >> 2, tile), 1)
            cell = np.concatenate(([0], np.cumsum((np.diff(place, axis=0) != 0).any(1))))
            if rest and (rest[-1][4] != place[0]).any():
                yield joined(rest)
                rest = []
            rows = (cell, _uint64(batch.columns[2:]), key & 1 > 0, key & 2 > 0)
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut:
                head = tuple(x[:cut] for x in rows)
                yield joined([*((np.zeros_like(r[0]), *r[1:4]) for r in rest), head])
                rest = []
            rest.append((np.zeros(len(cell) - cut, np.int64), *(x[cut:] for x in rows[1:]), place[-1]))
        if rest:
            yield joined(rest)

    return run


def links(prints: DataFrame, threshold: int = 4, way: Scheme | None = None) -> DataFrame:
    """Links (a, b), as fingerprints' numbers, that connect all distinct ones (the columns are their words) that differ in at most `threshold` bits.

    `way` is chosen by the number of fingerprints, if it is not given. Cells with many
    copies, by a count of one fingerprint in `SAMPLE`, are cut into tiles of about `CELL`
    rows a side, each compared with each; a cell that the count misses is compared as a whole.
    """
    words = word_names(len(prints.columns))
    prints = prints.toDF(*words)
    way = way or scheme(len(words), threshold, prints.count())
    schema = "key long, " + ", ".join(f"{w} long" for w in words)
    cell = F.shiftright("key", 2)
    some = prints.mapInArrow(_copies(way, SAMPLE), schema).groupBy(cell.alias("crowd")).count().where(F.col("count") * SAMPLE > CELL)
    crowds = written(some.select("crowd", F.ceil(F.col("count") * SAMPLE / CELL).alias("sides")), "crowds")
    dealt = prints.mapInArrow(_copies(way), schema)
    if crowds.isEmpty():
        dealt = dealt.repartition(cell).sortWithinPartitions("key").select("key", F.lit(0).cast("long").alias("tile"), *words)
    else:
        sides = F.coalesce("sides", F.lit(1).cast("long"))
        met = dealt.join(crowds, cell == F.col("crowd"), "left").withColumn("own", F.pmod(F.xxhash64(*words), sides))
        met = met.select("key", *words, "own", sides.alias("sides"), F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)).alias("other"))
        # Tile (i, j) holds the rows of i and j, those of the larger marked.
        tile, marked = F.least("own", "other") * F.col("sides") + F.greatest("own", "other"), F.when(F.col("own") > F.col("other"), 2).otherwise(0)
        met = met.select(F.col("key").bitwiseOR(marked).alias("key"), tile.alias("tile"), *words)
        dealt = met.repartition(cell, F.col("tile")).sortWithinPartitions(cell, "tile")
    return dealt.mapInArrow(_links(threshold), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b) of longs: root is the smallest node reachable.

    Each round every node hooks to its smallest neighbour, the hooks are followed to
    their ends by pointer jumping, and the links are drawn again between those; at
    least half of the nodes that have links left vanish in a round, and a path of n hooks
    takes log2 n jumps. Only joins and sums, nothing is gathered. Self-links and repeats are allowed.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        hooks = jumped(written(low, "hooks"))
        to_a, to_b = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        drawn = edges.join(to_a, "a").join(to_b, "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        if labels is None:
            labels = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = written(labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        edges = written(drawn.where("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def jumped(hooks: DataFrame) -> DataFrame:
    """node, root of a forest of hooks, each followed to its end: every jump halves all paths."""
    while True:
        # Only nodes that are not roots themselves can be jumped over.
        onward = hooks.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        far = hooks.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        far = written(far, "hooks")
        hooks = far.select("node", "root")
        if far.where("moved").isEmpty():
            return hooks


def near_duplicates(docs: DataFrame, threshold: int = 4, k: int = 4, words: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word), component_id for every row of docs (doc_id, text; others are ignored).

    component_id is the smallest doc_id reachable over links of at most `threshold`
    differing bits. Null, empty and blank texts have fingerprint zero and link like
    any other. Repeated rows are kept, each with its component; null ids are passed
    over when the smallest is taken (null if a component has no other). An empty
    table gives an empty result.
    """
    prints = written(fingerprints(docs, k, words), "prints")
    names = word_names(words)
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), *(F.min(w).alias(w) for w in names)), "nodes")
    roots = connected(links(nodes.select(*names), threshold))
    members = written(roots.withColumnRenamed("node", "fp").join(nodes, "fp"), "members")
    lowest = members.groupBy("root").agg(F.min("low").alias("lowest"))
    classes = written(members.join(written(lowest, "lowest"), "root").select("fp", "lowest"), "classes")
    known = written(nodes.join(classes, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id")), "known")
    digits = F.concat(*(F.lower(F.lpad(F.hex(w), 16, "0")) for w in reversed(names)))
    return prints.join(known, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, threshold: int = 4, k: int = 4, words: int = 1) -> DataFrame:
    """The rows of docs without near-duplicates: of each component that with the smallest doc_id stays.

    Columns stay as they are. Rows with a null doc_id stay; of rows that share the
    id that stays, one stays.
    """
    groups = written(near_duplicates(docs, threshold, k, words), "groups")
    removed = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("removed_id")).distinct(), "removed")
    kept = docs.join(removed, docs["doc_id"] == removed["removed_id"], "left_anti")
    repeated = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id"))
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    again = repeated["repeated_id"] == kept["doc_id"]
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id"]))
