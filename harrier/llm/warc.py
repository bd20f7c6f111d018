"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: payloads of equal SHA-1 and at least ``MIN_BYTES`` are grouped (digests only, combined before any shuffle);
the largest key of a group is its response, the others become revisit records without payload; a digest that very many
records share is dealt over as many groups as it fills. Each attempt of a task writes one archive of its own name, a
gzip member for each record. The manifest is a table of archives, of which Spark commits the rows of one attempt for
each task: what it does not name, as of an attempt that was lost, is no part of the collection and is never read.

Reading: archives are cut into byte ranges. A task scans its range for the gzip magic, takes a candidate for a
member only if its head decodes to a WARC header, and owns the records that start inside its range, reading on past
its end for the last one. After a member the next one is taken where it ended.

Archives are reached through pyarrow's file systems, in the shared folder of the session.

Edge cases: null payloads are empty; repeated keys keep a record each; a null key is written as empty and read as
null; keys must be whole numbers, others raise a TypeError; line breaks in a URL are escaped; an empty table writes nothing and reads as an empty table; other columns are
not read. A record whose payload does not match its digest, or an archive cut short, raises an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.store import col, hot_join, long_ids, new_folder, partitions

MIN_BYTES = 1_000
SPLIT = 4 << 20
MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """id, url, payload (binary), digest, refers_to (null for responses)."""
    rows = pages.select(long_ids(pages, id_col).alias("id"), col(url_col).cast("string").alias("url"), F.encode(F.coalesce(col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digests = rows.filter(F.octet_length("payload") >= min_bytes).select("id", F.sha1("payload").alias("digest"))
    groups = digests.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    revisits = hot_join(digests, groups, ["digest"], "id", "n", "digests").filter("id < response").select("id", "digest", "response").distinct()
    # a key may have several rows: its digest tells which of them revisits
    rows = rows.withColumn("digest", F.sha1("payload"))
    joined = rows.join(revisits, ["id", "digest"], "left")
    return joined.select("id", "url", "payload", "digest", F.col("response").alias("refers_to"))


def _header(fields: list[tuple[str, str]], body: bytes) -> bytes:
    lines = [b"WARC/1.1", *[f"{k}: {v}".encode() for k, v in fields], b"Content-Length: %d" % len(body)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head with the payload's length, and no payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(key)), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(_header(fields, http + (payload if refers_to is None else b""))) + packer.flush()


def write_archives(found: DataFrame, folder: str) -> DataFrame:
    """Writes one archive for each partition and returns the manifest, a table in the folder: path, bytes, records."""
    spark = found.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n, out = 0, None
        for batch in batches:
            for key, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                out = out or system.open_output_stream(path, compression=None)
                out.write(record_bytes(key, url, payload, digest, refers_to))
                n += 1
        if out is not None:
            out.close()
            size = system.get_file_info(path).size
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    manifest = f"{folder}/_manifest"
    found.select("id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, bytes long, records long").write.parquet(manifest)
    return spark.read.schema("path string, bytes long, records long").parquet(manifest)


class Bytes:
    """Forward reads of a file at given places, keeping what was read ahead."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        end = min(self.size, place + n)
        if place < self.start or place > self.start + len(self.held):
            self.start, self.held = place, b""
        if self.start + len(self.held) < end:
            self.file.seek(self.start + len(self.held))
            self.held = self.held[place - self.start :] + self.file.read(max(CHUNK, end - self.start - len(self.held)))
            self.start = place
        return self.held[place - self.start : end - self.start]


def is_record(data: bytes) -> bool:
    """Whether a gzip member that starts with these bytes decodes to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data, len(HEAD)) == HEAD
    except zlib.error:
        return False


def members(file: Bytes, start: int, end: int) -> Iterator[bytes]:
    """The decoded records that start in start:end."""
    place = start
    while place < end:
        window = file.at(place, CHUNK)
        hit = window.find(MAGIC)
        if hit < 0:
            place += max(1, len(window) - len(MAGIC) + 1)
            continue
        place += hit
        if place >= end:
            return
        if not is_record(file.at(place, 1 << 12)):
            place += 1
            continue
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = file.at(place, 1 << 16)
            if not data:
                raise ValueError("an archive ends within a record")
            parts.append(unpacker.decompress(data))
            place += len(data) - len(unpacker.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """Key, payload length, digest, type, key it refers to, payload (empty for revisits)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    key = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    length = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    if kind == "response" and (length != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of record {fields['warc-record-id']} does not match its head")
    return key(fields["warc-record-id"]), length, digest, kind, key(fields["warc-refers-to"]) if kind == "revisit" else None, payload


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, folder: str, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Records of the archives of a manifest (path, bytes), read in byte ranges of ``split``."""
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    dealt = ranges.repartition(partitions(manifest.sparkSession), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows: list[tuple] = []
                held = 0
                with system.open_input_file(path) as file:
                    for record in members(Bytes(file, size), start, min(size, start + split)):
                        row = parse(record)
                        rows.append(row if with_payload else (*row[:5], None))
                        held += len(record)
                        if held > 8 * CHUNK:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return dealt.mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes all rows as archives in the shared folder and reads them back."""
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(records(pages, id_col, url_col, payload_col), folder), folder, with_payload=with_payload)
