"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's words are its runs without white space. Every word gives two tokens: the
word itself, and its shape (case, length class, trailing symbol, amount of symbols,
and whether it repeats the word before). The features are word 1- and 2-grams and
shape 1-, 2- and 3-grams, hashed into `SIZE` buckets; a score is the sparse dot
product of their relative frequencies with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder3, small_batches, utf8, written
from .ftrl import Ftrl

BITS = 18
SIZE = 1 << BITS
#: Relative frequencies are multiplied by this, so that a text's features weigh against the bias.
GAIN = 20.0
#: Labelled rows of one class that the fit uses at most.
MAX_ROWS = 3000
#: Bytes that are handled at once; a piece ends between words where it can.
PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_MARK = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


class Features:
    """Hashed n-grams of whole texts, as bucket numbers."""

    def __init__(self):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(PIECE + 1, _ODD, np.uint64))
            self.inverse = np.cumprod(np.full(PIECE + 1, pow(_ODD, -1, 1 << 64), np.uint64))

    def words(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hash and shape of every word, piece by piece."""
        at = 0
        while at < len(text):
            piece = np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)
            space = _SPACE[piece]
            if at + len(piece) < len(text) and len(blanks := np.flatnonzero(space[-(PIECE // 16) :])):
                piece = piece[: len(piece) - len(space[-(PIECE // 16) :]) + blanks[-1] + 1]
                space = space[: len(piece)]
            at += len(piece)
            edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
            start, end = edge[::2], edge[1::2]
            if not len(start):
                continue
            # Prefix sums of byte times power give every word's hash; the inverse power takes its place out.
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[piece] + np.uint64(1)) * self.power[: len(piece)])))
            word = (sums[end] - sums[start]) * self.inverse[start]
            marks = np.concatenate(([0], np.cumsum(_MARK[piece])))
            caps = np.concatenate(([0], np.cumsum(_UPPER[piece])))
            n, m, u = end - start, marks[end] - marks[start], caps[end] - caps[start]
            case = np.where(u == 0, 0, np.where(u == 1, 1, np.where(u + m >= n, 2, 3)))
            last = np.where(_MARK[piece[end - 1]], piece[end - 1], 0)
            shape = ((case * 256 + last) * 4 + np.minimum(m, 3)) * 4 + np.minimum(np.maximum(n - m, 0) // 4, 3)
            yield word, shape.astype(np.uint64)

    def buckets(self, text: bytes) -> Iterator[np.ndarray]:
        before = shape2 = shape1 = None
        for word, shape in self.words(text):
            if before is None:
                before, shape1, shape2 = np.uint64(1), np.uint64(1 << 20), np.uint64(1 << 20)
            words = np.concatenate(([before], word))
            shape = shape + np.uint64(1 << 16) * (words[1:] == words[:-1])
            shapes = np.concatenate(([shape2, shape1], shape))
            two = shapes[1:-1] * np.uint64(1 << 21) + shapes[2:]
            for salt, key in enumerate((word, words[:-1] * np.uint64(3) ^ word, shape, two, shapes[:-2] * np.uint64(1 << 42) + two)):
                yield ((((key + np.uint64(salt + 1)) * np.uint64(_ODD)) ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
            before, shape1, shape2 = word[-1], shapes[-1], shapes[-2]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        index, value = [], []
        for text in batch.column(1):
            got = np.concatenate([np.empty(0, np.int64), *features.buckets(text.as_py() or b"")])
            b, c = np.unique(got, return_counts=True)
            index.append(b.astype(np.int32))
            value.append((c * (GAIN / max(1, len(got)))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["label", "buckets", "vals"])


class Model:
    """Weights by bucket, and bias, of the log odds of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, features: Features, text: bytes | None) -> float:
        total, n = 0.0, 0
        for b in features.buckets(text or b""):
            total += float(self.weights[b].sum(dtype=np.float64))
            n += len(b)
        return 1 / (1 + float(np.exp(-np.clip(total * GAIN / max(n, 1) + self.bias, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, learn=None, max_rows: int = MAX_ROWS, epochs: int = 4) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, quality) over the ids where `learn` holds (default: crc32 of doc_id modulo 3 is not 1).

    Of each label the `max_rows` ids smallest by hash are used. A repeated id counts
    once, with label 1 if at least half of its labels are 1; null labels are passed over.
    """
    small_batches(docs.sparkSession)
    learn = remainder3() != 1 if learn is None else learn
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marked = written(marked, "marked")
    pick = lambda v: marked.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = pick(0).union(pick(1)).select(F.col("doc_id").alias("chosen_id"), "label")
    # At most 2 * max_rows ids: their number is bounded, so they are broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("chosen_id") == F.col("doc_id"))
    # One text for each id, so that the bound holds for rows too.
    texts = texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", utf8("text").alias("text"))
    sample = texts.mapInArrow(_sparse, "label int, buckets array<int>, vals array<float>").toArrow()
    rows = [(np.array(sample.column(1)[i].values, np.int64), np.array(sample.column(2)[i].values, np.float64), sample.column(0)[i].as_py()) for i in range(sample.num_rows)]
    rows.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum()), tuple(r[0][:16])))
    if not rows:
        return Model(np.zeros(SIZE, np.float32), 0.0)
    w = Ftrl(SIZE, 2, alpha=0.3, beta=1.0, l1=0.02, l2=0.01).fit(rows, epochs).weights()
    return Model((w[:-1, 1] - w[:-1, 0]).astype(np.float32), float(w[-1, 1] - w[-1, 0]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), Model(*shared.value)
        for batch in batches:
            p = np.array([model.score(features, t.as_py()) for t in batch.column(batch.num_columns - 1)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text; others are ignored).

    score is the probability of label 1; predicted is 1 from 0.5 on. Null and empty
    texts have no features and get the bias alone. Without labels every score is 0.5.
    Null ids are never held out; repeated rows are scored each.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder3() == 1).alias("held_out"), utf8("text").alias("text"))
    return rows.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), Model(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            good = [model.score(features, t.encode() if (t := v.as_py()) else None) >= 0.5 for v in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that the classifier predicts as 1."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))), docs.schema)
