"""Token counts of whole texts by a public BPE vocabulary, without token ids.

Each distinct pre-token is cut into pieces once. A document's count is the sum, over its
distinct pre-tokens, of frequency times pieces. The pre-tokens that occur most often in a
sample of the documents (at most `head`, a fixed bound) are counted first and broadcast. Every
text is then cut once: what the head knows is summed where it is read, and only the other
pre-tokens are written, with their frequencies. Their distinct ones are counted and joined by a
shuffle. The sample decides how much is left for that join, not the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8, written

#: Distinct pre-tokens that are broadcast at most; a bound on memory, not on results.
HEAD = 1 << 18
#: Rows, about, from which the head is taken at most.
SAMPLE_ROWS = 20_000
#: Distinct pre-tokens that a task gathers before it passes them on.
FLUSH = 1 << 19


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PreTokenizer:
    """Cuts texts into the pre-tokens of a tokenizers file; exact for that file's normalizer, pattern and added tokens.

    Texts of plain Latin letters take a short cut through one regular expression
    (where the file is lower-casing and splits by its pattern); all others go
    through the library itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = sorted({s[:2] for s in special})
        norm = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = pre[0] if pre and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] else None
        self.find = regex.compile(split["pattern"]["Regex"]).findall if split and norm == ["NFC", "Replace", "Lowercase"] else None
        #: Characters on which every Unicode version agrees, which are composed, and whose lower case needs no context.
        self.plain = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ‐-‧]*").fullmatch
        self.letters = byte_letters()

    def segment(self, text: str) -> list[str]:
        if self.find and self.plain(text):
            return self.find(text.lower())
        text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of text, and how many added tokens stand in it (one token each)."""
        if self.special is None or not any(m in text for m in self.marks):
            return self.segment(text), 0
        parts = self.special.split(text)
        return [t for s in parts[::2] if s for t in self.segment(s)], len(parts) // 2

    def pieces(self, pre_token: str) -> int:
        return len(self.tok.model.tokenize("".join(self.letters[b] for b in pre_token.encode())))


def _vocabulary(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = PreTokenizer(path), Counter()

        def out():
            return pa.RecordBatch.from_pydict({"pre_token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    seen.update(cutter.cut(text)[0])
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokenizer(path)
        for batch in batches:
            got = pa.array([cutter.pieces(t) for t in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], ["pre_token", "n", "pieces"])

    return run


def _frequencies(path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = PreTokenizer(path), dict(zip(*head.value, strict=True))
        for batch in batches:
            sums, rare, times = [], [], []
            for text in batch.column(0):
                pre_tokens, total = cutter.cut(text.as_py() or "")
                left, n = [], []
                for t, k in Counter(pre_tokens).items():
                    if (p := known.get(t)) is None:
                        left.append(t)
                        n.append(k)
                    else:
                        total += k * p
                sums.append(total)
                rare.append(left)
                times.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["row_key", "doc_id", "n_bytes", "head_tokens", "rare", "times"],
            )

    return run


def pre_token_pieces(vocabulary: DataFrame, path: str) -> DataFrame:
    """The rows of pre_token and n (occurrences), one for each distinct pre-token, with the pieces of each."""
    return written(vocabulary.mapInArrow(_pieces(path), "pre_token string, n long, pieces int"), "pieces")


def head_of(docs: DataFrame, path: str, head: int, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """The most frequent pre-tokens, at most `head`, of about `rows` documents or a tenth of all, chosen by hash, and their pieces."""
    n = docs.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / F.lit(2.0**63)
    some = docs.where(place < min(rows / max(n, 1), 0.1))
    counted = some.select("text").mapInArrow(_vocabulary(path), "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    top = frequent(pre_token_pieces(counted, path), head).select("pre_token", "pieces").toArrow()
    return top.column(0).to_pylist(), top.column(1).to_pylist()


def frequent(table: DataFrame, head: int) -> DataFrame:
    """The rows of the most frequent pre-tokens, at most `head`, down to a frequency that a histogram of few hundred rows gives: nothing is sorted."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    low, room = None, head
    for n, count in sorted(table.groupBy(step).count().collect(), reverse=True):
        if count > room:
            break
        low, room = n, room - count
    return table.where(F.lit(False) if low is None else step >= low)


def count_tokens(docs: DataFrame, path: str, limit: int, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text; others are ignored).

    Counts are those of the file's library without begin, end or template tokens,
    with added tokens inside texts taken as such. Null and empty texts have no
    tokens; rows with null or repeated doc_id are counted each for itself; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(head_of(docs, path, head))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = written(
        docs.select("text", F.monotonically_increasing_id().alias("row_key"), "doc_id", F.coalesce(F.octet_length(utf8("text")), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(
            _frequencies(path, shared), f"row_key long, doc_id {id_type}, n_bytes long, head_tokens long, rare array<string>, times array<long>"
        ),
        "frequencies",
    )
    rare = rows.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_key", F.col("x.rare").alias("pre_token"), F.col("x.times").alias("times"))
    table = pre_token_pieces(rare.groupBy("pre_token").agg(F.sum("times").alias("n")), path)
    tails = rare.join(table.select("pre_token", "pieces"), "pre_token").groupBy("row_key").agg(F.sum(F.col("times") * F.col("pieces")).alias("tail_tokens"))
    n = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return rows.drop("rare", "times").join(tails, "row_key", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
