"""WARC archives with a Zstandard dictionary: each record is a frame of its own, the dictionary leads in a skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, bounded_sample, stored, text_slices, trimmed, work_folder

#: Frame magic of dictionaries and of Zstandard frames, and the profile of revisits by equal payload.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are stored again: a revisit would not be smaller.
LEAST_REVISIT = 1000
#: Shared payloads (some 60 bytes each) that are sent to every executor; more are joined by digest.
BROADCAST_PAYLOADS = 200_000
_COLUMNS = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def trained_dictionary(
    pages: DataFrame, html: str = "html", key: str = "page_id", max_records: int = 2000, max_record_bytes: int = 64 << 10,
    size: int = 64 << 10,
) -> bytes:
    """A dictionary from up to ``max_records`` payloads (a sample by hash), those of up to ``max_record_bytes``.

    The sample bounds what the driver holds; it affects the size of archives, never their content.  Empty where the records are
    too few or too short to train on.
    """
    usable = pages.where((F.octet_length(html) > 0) & (F.octet_length(html) <= max_record_bytes))
    payload = F.col(html).cast("binary").alias("p")
    # rows with one key are one record here, whatever their number
    sample = bounded_sample(usable.select(F.col(key).alias("k"), payload), ["k", "p"], max_records).select("p").distinct()
    records = [bytes(r.p) for r in sample.collect()]
    try:
        return zstandard.train_dictionary(size, records, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _responses(rows: DataFrame) -> DataFrame:
    """``payload_digest, response`` of the payloads that several rows share; sent to all executors if they are few."""
    shared = stored(
        rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-shared"
    )
    return F.broadcast(shared) if shared.count() <= BROADCAST_PAYLOADS else shared


def decided(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to`` of every row.

    Of rows with equal payloads of ``LEAST_REVISIT`` bytes or more the one with the largest ``page_id`` is the response; rows
    that repeat its ``page_id`` are responses too.  Where no such payload has a ``page_id``, all are responses.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("payload"),
        F.sha1(text.cast("binary")).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes"),
    )
    joined = rows.join(_responses(rows.drop("payload")), "payload_digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"),
    )


def _record(
    key: int | None, url: str | None, payload: str | None, digest: str, size: int, kind: str, refers_to: int | None, moment: str
) -> bytes:
    block = _HTTP.format(size).encode() + (payload or "").encode()
    # an id that depends on the row alone, so a repeated task writes the same bytes
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}|{url}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {moment}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if key is None else key}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(
    pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", archive_bytes: int = 256 << 20,
    moment: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row as a record; returns the manifest ``archive, n_records, n_bytes`` of the written archives.

    An archive is closed at ``archive_bytes``.  It is written under a name of the attempt and moved to its own when complete, so
    a task that is repeated replaces its archives by equal ones.  The archives lie below the shared folder; its store must be one
    that Arrow's file systems reach.  NULL html is an empty payload, a NULL key has an empty ``X-Page-Id``, a NULL url is
    ``about:blank``.  Other columns are not read.  An empty table gives no archives.
    """
    spark = pages.sparkSession
    dictionary = trained_dictionary(pages, html, key)
    folder = work_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        archive, number, made = None, 0, []
        for batch in batches:
            for piece in text_slices(batch, "payload"):
                for row in zip(*(piece.column(c).to_pylist() for c in _COLUMNS)):
                    if archive is None:
                        archive = _Archive(store, f"{root}/part-{part:06d}-{number:05d}.warc.zst", dictionary)
                    archive.add(_record(*row, moment))
                    if archive.size >= archive_bytes:
                        made.append(archive.close())
                        archive, number = None, number + 1
        if archive is not None:
            made.append(archive.close())
        for name, records, size in made:
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": [records], "n_bytes": [size]})

    rows = decided(pages, html, key, url).select(*_COLUMNS)
    return stored(rows.mapInArrow(trimmed(run), "archive string, n_records long, n_bytes long"), "warc-manifest")


class _Archive:
    def __init__(self, store: fs.FileSystem, path: str, dictionary: bytes):
        self.store, self.path, self.own = store, path, f"{path}.{uuid.uuid4().hex}"
        self.out, self.size, self.records = store.open_output_stream(self.own, compression=None), 0, 0
        packed = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=packed, write_checksum=True)
        if dictionary:
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.store.move(self.own, self.path)
        return self.path.rpartition("/")[2], self.records, self.size


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an open archive."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        dictionary, head = stream.read(struct.unpack("<I", head[4:])[0]), b""
        if struct.unpack("<I", dictionary[:4])[0] == FRAME_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    packed = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frames = zstandard.ZstdDecompressor(dict_data=packed).stream_reader(_Joined(head, stream), read_across_frames=True)
    reader = io.BufferedReader(frames, 1 << 20)
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("record does not start with its version")
        fields = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = reader.read(int(fields["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("record does not end with empty lines")
        yield fields, block


class _Joined:
    """``head``, then the rest of ``stream``."""

    def __init__(self, head: bytes, stream):
        self.head, self.stream = head, stream

    def read(self, size: int = -1) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.stream.read(size)


def read(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of all records of the archives.

    A response's size and digest are those of the payload that was read, and must equal its headers; a revisit has
    no payload, its size and digest are those of its headers.
    """
    spark = manifest.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, block in records(stream):
                        row = _row(fields, block)
                        rows.append(row)
                        held += len(block) + 200
                        if held >= SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return manifest.select("archive").repartition(n, "archive").mapInArrow(
        trimmed(run), "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _row(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(h.partition(b":")[2]) for h in http.split(b"\r\n") if h.startswith(b"Content-Length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if (len(payload), found) != (size, digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its headers")
    key = fields["X-Page-Id"]
    return {
        "page_id": int(key) if key else None, "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "payload": payload.decode() if kind == "response" else None, "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if kind == "revisit" else None,
    }
