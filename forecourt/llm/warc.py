"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, with the
seek table of the public seekable format in a skippable frame at its end. The index
maps record identifiers to bundle, frame and the record's offset in the frame's
content, so that one record costs one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, utf8, written

#: Bytes of records in a frame, and of frames in a bundle, after which the next one begins.
FRAME, BUNDLE = 1 << 20, 1 << 26
#: Tasks that read bundles, at most.
TASKS = 20_000
#: Smaller payloads are never revisits.
LEAST = 1000
#: Fixed values of the seekable format: magic numbers of skippable frame and seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str):
    """File system and path within, for a path or URI of any store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record(fields: dict, body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def parse(content: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Fields and body of the record at an offset, and where the next one begins."""
    end = content.index(b"\r\n\r\n", at)
    lines = content[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = end + 4 + int(fields["Content-Length"])
    if content[body : body + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where it should")
    return fields, content[end + 4 : body], body + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, plain) sizes of all frames."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame of an open bundle."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    table, out, at = file.read(n * width), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


class _Writer:
    """Writes records to bundles of its own; several tasks, or attempts of one, never share a file."""

    def __init__(self, root: str, frame: int, bundle: int):
        import zstandard

        self.store, self.root = open_store(root)
        self.store.create_dir(self.root, recursive=True)
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)
        self.frame_size, self.bundle_size, self.file, self.index = frame, bundle, None, []

    def add(self, record_id: str, data: bytes) -> None:
        if self.file is None:
            context = TaskContext.get()
            self.name = f"part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}.warc.zst"
            self.file = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)  # by its name, it would be compressed again
            self.frames, self.parts, self.plain, self.packed = [], [], 0, 0
        self.index.append((record_id, self.name, len(self.frames), self.plain, len(data)))
        self.parts.append(data)
        self.plain += len(data)
        if self.plain >= self.frame_size:
            self.flush()
            if self.packed >= self.bundle_size:
                self.close()

    def flush(self) -> None:
        if self.parts:
            out = self.pack.compress(b"".join(self.parts))
            self.file.write(out)
            self.frames.append((len(out), self.plain))
            self.packed += len(out)
            self.parts, self.plain = [], 0

    def close(self) -> None:
        if self.file is not None:
            self.flush()
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None

    def take(self) -> pa.RecordBatch:
        rows, self.index = self.index, []
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record_id", "bundle", "frame", "frame_offset", "length"])


def record_id(page_id) -> str:
    """The identifier of a page's record; what may not stand in a URN is escaped."""
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='-')}>"


def _write(root: str, frame: int, bundle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            out = out or _Writer(root, frame, bundle)
            for page, url, payload, keeper in zip(*batch.columns, strict=True):
                page, url, payload, keeper = page.as_py(), url.as_py(), payload.as_py() or b"", keeper.as_py()
                revisit = keeper is not None and keeper != page
                fields = {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": record_id(page),
                    "WARC-Target-URI": None if url is None else "".join(" " if ord(c) < 32 else c for c in url),
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest(),
                    "WARC-Profile": PROFILE if revisit else None,
                    "WARC-Refers-To": record_id(keeper) if revisit else None,
                    "X-Payload-Length": len(payload),
                    "Content-Type": "application/http; msgtype=response",
                }
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
                out.add(fields["WARC-Record-ID"], record(fields, body))
            if len(out.index) > 10_000:
                yield out.take()
        if out:
            out.close()
            yield out.take()

    return run


def write_archives(pages: DataFrame, root: str, frame: int = FRAME, bundle: int = BUNDLE, least: int = LEAST) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) below root; gives the index.

    The index has record_id, bundle (file name), frame, frame_offset and length. Of
    rows with equal payloads of at least `least` bytes, those with the largest page_id
    are responses, the others revisits of it; all smaller ones are responses. Null html
    is an empty payload. A null page_id has an empty identifier and is never the one
    referred to while others are there. Repeated rows give a record each. Files of failed
    attempts may lie about, but the index names none of them.
    """
    small_batches(pages.sparkSession)
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(utf8("html"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    groups = own.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    shared = written(groups.where("n > 1").select(F.col("digest").alias("shared_digest"), "keeper"), "shared")
    # Rows that no other can equal are dealt by their own hash, should the join shuffle: null is no key.
    key = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("page_id", "url", F.octet_length("payload"))))
    rows = own.join(shared, key == F.col("shared_digest"), "left").select("page_id", "url", "payload", "keeper")
    index = rows.mapInArrow(_write(root, frame, bundle), "record_id string, bundle string, frame long, frame_offset long, length long")
    return written(index, "index")


def _payload(body: bytes) -> bytes:
    return body[body.index(b"\r\n\r\n") + 4 :]


def _page(identifier: str | None) -> str | None:
    return unquote((identifier or "")[10:-1]) or None


def _row(fields: dict, body: bytes) -> tuple:
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
    if kind == "response":
        payload = _payload(body)
        size, own = len(payload), hashlib.sha1(payload).hexdigest()
        if own != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, _page(fields.get("WARC-Refers-To"))


_FIELDS = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, top = open_store(root)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with store.open_input_file(f"{top}/{bundle}") as file:
                    for at, packed, plain in read_seek_table(file, file.size()):
                        file.seek(at)
                        content, rows, place = unpack.decompress(file.read(packed), max_output_size=plain), [], 0
                        while place < len(content):
                            fields, body, place = parse(content, place)
                            rows.append(_row(fields, body))
                        columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return run


def read_archives(index: DataFrame, root: str, id_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the bundles that the index names.

    Both ids are of the type given, that of the pages' own.
    Frames are found by the seek table and read one by one; payloads of responses are hashed again.
    """
    bundles = written(index.select("bundle").distinct(), "bundles")
    # A bundle's name says nothing of its size, by which small partitions are merged: the number of tasks is set.
    bundles = bundles.repartition(max(1, min(bundles.count(), TASKS)))
    rows = bundles.mapInArrow(_read(root), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def fetch(index: DataFrame, root: str, page_id: int) -> list[tuple[dict, bytes]]:
    """Fields and payload of the records of one page, each read from its one frame."""
    import zstandard

    store, top = open_store(root)
    out = []
    for row in index.where(F.col("record_id") == record_id(page_id)).collect():
        with store.open_input_file(f"{top}/{row.bundle}") as file:
            at, packed, plain = read_seek_table(file, file.size())[row.frame]
            file.seek(at)
            content = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
        fields, body, _ = parse(content, row.frame_offset)
        out.append((fields, _payload(body)))
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages in the shared folder, read back."""
    root = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, root), root, pages.schema["page_id"].dataType.simpleString())
