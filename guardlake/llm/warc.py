"""WARC archives with a Zstandard dictionary per file.

A file starts with a skippable frame that holds its dictionary, built from its own
leading records; every record then is a frame of its own, so one record can be read by
offset with the dictionary alone. Of records with equal payloads one is the response and
the others are revisit records that refer to it.

Tasks write whole files of bounded size into a shared folder under names of their own and
return a manifest; only files that the saved manifest lists count, so a task that is run
again leaves nothing but an unread file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm.common import saved, shared_dir, table

#: Magic of the skippable frame for dictionaries, the revisit profile.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and not the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{kind}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: quote(m[0], errors="replace"), url))
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:response>"]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Archive:
    """Writes one file: the dictionary frame, then a frame for each record."""

    def __init__(self, out, sample: list[bytes], dict_bytes: int, level: int) -> None:
        self.out, self.size, self.records = out, 0, 0
        try:
            trained = zstandard.train_dictionary(min(dict_bytes, max(1024, sum(map(len, sample)) // 10)), sample)
        except zstandard.ZstdError:  # too few or too small records for a dictionary
            trained = None
        if trained is not None:
            data = trained.as_bytes()
            self._write(struct.pack("<II", MAGIC, len(data)) + data)
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=trained)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.frames.compress(data))
        self.records += 1


def opened(folder: str):
    """The file system and path of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 64 << 20, sample_bytes: int = 4 << 20, dict_bytes: int = 64 << 10, level: int = 6) -> DataFrame:
    """Write every row of ``pages`` as a record; returns the saved manifest ``(path, records, bytes)``.

    The payload is the html in UTF-8, null as empty. Among rows with equal payloads of at
    least ``min_bytes`` bytes that with the largest id is the response (of rows that repeat
    that id, each is); rows with a null id are responses and nothing refers to them.
    ``sample_bytes`` bounds the records a file's dictionary is built from, ``archive_bytes``
    a file before compression.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha1("payload"))
    equal = rows.where(F.octet_length("payload") >= min_bytes).select(key.alias("key"), "id").groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    equal = saved(equal.where("n > 1 and first is not null").select("key", "first"))
    refers = F.when(F.col("id") < F.col("first"), F.col("first"))
    todo = rows.withColumn("key", key).join(equal, "key", "left").select("id", "url", "payload", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)

        def records() -> Iterator[bytes]:
            for b in batches:
                for i, u, p, r in zip(*b.columns):
                    yield record(i.as_py(), u.as_py(), p.as_py(), r.as_py())

        source, sample, raw, archive, out = records(), [], 0, None, None
        done = object()
        while True:
            data = next(source, done)
            if data is not done:
                raw += len(data)
                if archive is None:
                    sample.append(data)
                else:
                    archive.add(data)
            if archive is None and sample and (data is done or raw >= sample_bytes):
                name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                out = system.open_output_stream(name)
                archive = Archive(out, sample, dict_bytes, level)
                for x in sample:
                    archive.add(x)
                sample = []
            if archive is not None and (data is done or raw >= archive_bytes):
                out.close()
                yield pa.record_batch([pa.array([name.rsplit("/", 1)[1]]), pa.array([archive.records], pa.int64()), pa.array([archive.size], pa.int64())], names=["path", "records", "bytes"])
                archive, raw = None, 0
            if data is done:
                return

    return saved(todo.mapInArrow(run, "path string, records long, bytes long"))


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers by lower-case name, and the block."""
    lead = stream.read(8)
    known = None
    if len(lead) == 8 and struct.unpack("<I", lead[:4])[0] == MAGIC:
        known = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", lead[4:])[0]))
        lead = b""
    plain = zstandard.ZstdDecompressor(dict_data=known).stream_reader(_Joined(lead, stream), read_across_frames=True)
    lines = io.BufferedReader(plain, 1 << 20)
    while (first := lines.readline()) != b"":
        if first.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        head = {}
        while (line := lines.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        block = lines.read(int(head["content-length"]))
        lines.read(4)
        yield head, block


class _Joined:
    """A stream with some bytes put back before it."""

    def __init__(self, lead: bytes, rest) -> None:
        self.lead, self.rest = lead, rest

    def read(self, size: int = -1) -> bytes:
        if self.lead:
            out, self.lead = self.lead, b""
            return out
        return self.rest.read(size)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives: ``page_id``, ``url``, ``payload`` (null for a revisit),
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``; payloads are held against their digests."""

    def number(uri: str | None) -> int | None:
        found = re.search(r"urn:page:(-?\d+):", uri or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}") as stream:
                    for head, block in read_records(stream):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != length or base32_sha1(body) != digest):
                            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                        rows.append({"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload": body if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("warc-refers-to"))})
                        size += len(body)
                        if len(rows) >= 2000 or size > 16 << 20:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    files = max(1, manifest.count())
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(files).mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    folder = system.makeQualified(path).toString()
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has SHA-1 in hex: the digits are regrouped from 4 to 5 bits.
ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, strlen(h) as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as top from p),
bits as (select d.*, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', x[i]) - 1), 4, '0')), 'string_agg', '') as b from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: cast(b[i * 5 + j + 1] as int) * cast(power(2, 4 - j) as int)))::int]), 'string_agg', '') as payload_digest,
  case when page_id < top then 'revisit' else 'response' end as record_type, case when page_id < top then top end as refers_to
from bits"""
