"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters (every run of anything else is one
blank) are hashed into `SIZE` buckets. Document frequencies come from all rows that
may be learnt from; the weights are fitted by follow-the-regularised-leader on a
sample of at most `max_rows` rows a language, a fifth of which is kept out of the
fit for the temperature calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder3, small_batches, written
from .ftrl import Ftrl, softmax, temperature

SIZE = 1 << 15
ORDERS = (1, 2, 3)
#: Characters that are handled at once, so that very long texts need little memory.
PIECE = 1 << 18
#: Rows of one language that the fit uses at most.
MAX_ROWS = 1500


def _folding() -> np.ndarray:
    """For each code point of the basic plane: itself in lower case if it is a letter, else a blank."""
    table = np.full(1 << 16, 32, np.int64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Grams:
    """Hashed character n-grams of whole texts."""

    def __init__(self):
        self.fold = _folding()

    def codes(self, text: str) -> Iterator[np.ndarray]:
        """Folded text, blank at both ends, in pieces that overlap by the longest n-gram less one."""
        keep = np.array([32], np.int64)
        for at in range(0, len(text), PIECE):
            raw = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            low = np.where(raw < 1 << 16, self.fold[np.minimum(raw, (1 << 16) - 1)], raw)
            low = low[(low != 32) | (np.concatenate((keep[-1:], low[:-1])) != 32)]
            chunk = np.concatenate((keep, low))
            if at + PIECE >= len(text) and chunk[-1] != 32:
                chunk = np.append(chunk, 32)
            yield chunk
            keep = chunk[-(max(ORDERS) - 1) :]

    def buckets(self, text: str) -> Iterator[np.ndarray]:
        """Bucket of every n-gram of the text, n-grams of all orders, none twice."""
        first = True
        for code in self.codes(text):
            hashed = np.zeros(len(code), np.uint64)
            for n in range(1, max(ORDERS) + 1):
                hashed = hashed[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :].astype(np.uint64) + np.uint64(n)
                skip = 0 if first else max(ORDERS) - n  # those that lie in the overlap were counted
                if n in ORDERS:
                    yield ((hashed[skip:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
            first = False

    def has_letter(self, text: str) -> bool:
        return any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, df, n = Grams(), np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            n += 1
            seen = np.zeros(SIZE, bool)
            for b in grams.buckets(text.as_py() or ""):
                seen[b] = True
            df += seen
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": np.append(some, -1), "n": np.append(df[some], n)})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        index, count = [], []
        for text in batch.column(1):
            c = np.zeros(SIZE, np.int64)
            for b in grams.buckets(text.as_py() or ""):
                c += np.bincount(b, minlength=SIZE)
            index.append(np.flatnonzero(c).astype(np.int32))
            count.append(c[index[-1]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], ["lang", "buckets", "counts"])


class Model:
    """Class names, idf-scaled weights (buckets by classes), bias and temperature."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, heat: float):
        self.names, self.weights, self.bias, self.heat = names, weights, bias, heat

    def score(self, grams: Grams, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not grams.has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(self.names)), 0
        for b in grams.buckets(text):
            total += self.weights[b].sum(0, dtype=np.float64)
            n += len(b)
        p = softmax((total / n + self.bias) / self.heat)
        return self.names[int(p.argmax())], float(p.max())


def fit(docs: DataFrame, learn=None, max_rows: int = MAX_ROWS, epochs: int = 3) -> Model:
    """A model of docs (doc_id, text, lang) over the rows where `learn` holds (default: crc32 of doc_id modulo 3 is not 1) and lang is not null."""
    small_batches(docs.sparkSession)
    learn = remainder3() != 1 if learn is None else learn
    rows = docs.where(F.col("lang").isNotNull() & learn).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    found = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row a bucket
    df = np.zeros(SIZE + 1)
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    n, idf = df[SIZE], np.log((1 + df[-1]) / (1 + df[:SIZE])) + 1
    if not n:
        return Model([], np.zeros((SIZE, 0), np.float32), np.zeros(0), 1.0)
    # By hash, about max_rows a language; the limit to exactly as many then sorts few rows.
    order = F.xxhash64("doc_id", "text").alias("place")
    sizes = written(rows.groupBy("lang").count(), "languages", files=1)
    share = F.least(F.lit(1.0), F.lit(1.3 * max_rows + 50) / F.col("count"))
    near = rows.withColumn("place", order).join(sizes, "lang").where(F.shiftrightunsigned("place", 1) / F.lit(2.0**63) < share)
    from pyspark.sql import Window

    picked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("rank") <= max_rows)
    sample = picked.select("lang", "text", "place").select("lang", "text").mapInArrow(_counts, "lang string, buckets array<int>, counts array<int>").toArrow()
    names = sorted(set(sample.column(0).to_pylist()))
    number = {x: i for i, x in enumerate(names)}
    data = []
    for i in range(sample.num_rows):
        b = np.array(sample.column(1)[i].values, np.int64)
        c = np.array(sample.column(2)[i].values, np.float64)
        if len(b):
            data.append((b, c / c.sum() * idf[b], number[sample.column(0)[i].as_py()]))
    data.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum()), tuple(r[0][:32])))
    order = np.random.default_rng(11).permutation(len(data))
    held = [data[i] for i in order[: len(data) // 5]]
    model = Ftrl(SIZE, len(names), alpha=1.0, beta=0.1, l1=0.002, l2=0.002).fit([data[i] for i in order[len(data) // 5 :]], epochs)
    w = model.weights()
    logits = np.array([r[1] @ w[r[0]] + w[-1] for r in held]).reshape(len(held), len(names))
    heat = temperature(logits, np.array([r[2] for r in held], np.int64))
    return Model(names, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], heat)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(), Model(*shared.value)
        for batch in batches:
            out = [model.score(grams, t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang; others are ignored).

    score is the calibrated probability of the language given. Texts that are null
    or have no letter get `und` and 0, as does everything if nothing can be learnt.
    Rows with null ids take no part in held-out rows. Repeated rows are scored each.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias, model.heat))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (remainder3() == 1).alias("held_out"), "text").mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
