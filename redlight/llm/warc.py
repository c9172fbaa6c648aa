"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a
last skippable frame with the seek table (the layout of the public "seekable format":
compressed and decompressed size of every frame, then the number of frames, a descriptor
byte and a magic number). Any Zstandard reader can read a bundle from end to end; with the
seek table one frame can be read alone.

Writing tasks name their files afresh. The index (record identifier -> bundle, frame,
offset and length within the frame) is a table that Spark commits; a file that no index row
names is left over from a lost task and is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, utf8

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "record_id string, bundle string, frame int, record_offset long, record_length long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to``: of equal payloads
    of at least ``least_bytes`` bytes, every row with the largest page_id is a response
    (``refers_to`` null), the others refer to it. A null page_id is never the largest. A null
    html is empty; other columns are not read, so no name can clash. A payload and its record
    stand whole in memory, one at a time, and in a frame of its own if it is longer than one.
    An empty table gives no rows, and no file."""
    rows = pages.select("page_id", "url", utf8("html").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    target = (
        pages.select("page_id", utf8("html").alias("p")).where(F.octet_length("p") >= least_bytes)
        .groupBy(F.sha1("p").alias("payload_digest"), F.octet_length("p").cast("long").alias("payload_bytes"))
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    joined = rows.join(target, ["payload_digest", "payload_bytes"], "left")
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def build_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, and so the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {_one_line(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers in lower case, with ``payload`` (None for a revisit) and ``payload_bytes``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8").split("\r\n")[1:])
    out = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
    out["payload_bytes"] = int(said["Content-Length"])
    out["payload"] = None if out["warc-type"] == "revisit" else payload
    return out


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame of a bundle."""
    f.seek(size - 9)
    n, kind, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if kind & 0x80 else 8
    f.seek(size - 9 - n * width)
    table, out, at = f.read(n * width), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Groups records into frames of about ``frame_bytes`` and writes a bundle as it goes."""

    def __init__(self, fs, path: str, frame_bytes: int, level: int):
        self.out, self.frame_bytes = fs.open_output_stream(path, compression=None), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.buffer, self.sizes, self.plain = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset within it."""
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.sizes), len(self.buffer)
        self.buffer += record
        self.plain += len(record)
        return at

    def flush(self) -> None:
        if self.buffer:
            packed = self.pack(bytes(self.buffer))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.buffer)))
            self.buffer.clear()

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()


def write_archives(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write ``records`` (see :func:`classify`) as bundles into ``folder``, which driver and
    executors share; return the index (see :data:`INDEX`), committed as a table beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        fs, root = pfs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        writer, name = None, ""
        names = ["record_id", "bundle", "frame", "record_offset", "record_length"]
        for b in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(b.column(n) for n in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                record = build_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                if writer and writer.plain + len(record) > bundle_bytes:
                    writer.close()
                    writer = None
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs, f"{root}/{name}", frame_bytes, level)
                rows.append((record_id(page_id.as_py()), name, *writer.add(record), len(record)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))] if rows else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())], names=names)
        if writer:
            writer.close()

    spark = records.sparkSession
    at = f"{folder}/index"
    # In order of the identifiers within each file, so that a look-up skips pages of the index.
    index = records.mapInArrow(work, INDEX).repartition(partitions(spark), "record_id").sortWithinPartitions("record_id")
    index.write.parquet(at)
    return spark.read.schema(INDEX).parquet(at)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``record_id, warc_type, refers_to, payload_digest, payload_bytes, payload`` of the
    records that ``index`` names (all, or a few looked up): each frame is read once, by its
    place in the bundle's seek table. The digest of a response is that of what was read."""
    spark = index.sparkSession
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("record_offset", "record_length"))).alias("at"))
    schema = "record_id string, warc_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        fs, root = pfs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        name, file, table = None, None, []
        for b in batches:
            for bundle, frame, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                if bundle != name:
                    if file:
                        file.close()
                    name, file = bundle, fs.open_input_file(f"{root}/{bundle}")
                    table = read_seek_table(file, file.size())
                offset, packed, plain = table[frame]
                file.seek(offset)
                data = unpack(file.read(packed), max_output_size=plain)
                out = []
                for x in at:
                    r = parse_record(data[x["record_offset"] : x["record_offset"] + x["record_length"]])
                    said = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["payload"] is not None and (hashlib.sha1(r["payload"]).hexdigest() != said or len(r["payload"]) != r["payload_bytes"]):
                        raise ValueError(f"{r['warc-record-id']} in {bundle} is damaged")
                    out.append((r["warc-record-id"], r["warc-type"], r.get("warc-refers-to"), said, r["payload_bytes"], r["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["record_id", "warc_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
        if file:
            file.close()

    # A bundle's frames lie in few tasks, in order; many bundles give many tasks.
    dealt = frames.repartition(partitions(spark), "bundle", (F.col("frame") / 16).cast("int")).sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(work, schema)


def lookup(index: DataFrame, folder: str, page_ids: list[int]) -> DataFrame:
    """Random access: the index is sorted and the filter pushed down to it, and only the frames
    that hold these records are read."""
    wanted = index.where(F.col("record_id").isin([record_id(i) for i in page_ids]))
    return read_records(wanted, folder)


def page_id_of(col: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({col}, '^<urn:page:(.*)>$', 1) as long)")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages, read all archives back: one row per page."""
    index = write_archives(classify(pages), folder)
    return read_records(index, folder).select(
        page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page_id_of("refers_to").alias("refers_to"), "payload",
    )
