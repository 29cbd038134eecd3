"""WARC archives with an index first: offset, length, URL and digest of each record, then coalesced byte-range reads.

Records are gzip members of rolled archives in a shared folder; the index is a table of one row per record. A payload that
an earlier page has is written as a `revisit` without its body. A reader selects rows of the index, sorts them by
archive and offset, merges neighbouring ranges into one read of bounded size, and checks each payload against its digest.

An archive's name holds the task attempt that wrote it, and the index only names archives of attempts that succeeded, so
retried or speculative tasks leave at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import storage

ARCHIVE_BYTES = 64 << 20
#: Ranges this close are read together, up to RANGE_BYTES at once.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
#: Archive bytes that a reading task should have.
TASK_BYTES = 64 << 20
LEAST_REVISIT_BYTES = 0
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder (file, hdfs, s3 or gs URIs, or a plain path) and the path in it."""
    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlsplit(uri).path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def _line(value: str) -> str:
    """A header value must be one line; other characters of a URL stay as they are."""
    return urllib.parse.quote(value, safe="".join(map(chr, range(33, 127)))) if any(ord(c) < 33 or ord(c) > 126 for c in value) else value


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, size: int) -> bytes:
    """One gzip member; a revisit's `payload` is not written, only its `size`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(None if revisit else page_id, f"{digest}:{page_id}" if revisit else digest),
        "WARC-Target-URI": None if url is None else _line(url),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": _record_id(refers_to, digest) if revisit else None,
        "X-Refers-To-Page": refers_to if revisit else None,
        "X-Page": page_id,
        "X-Payload-Length": size,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and the payload of one gzipped record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


_INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, file string, offset long, length long"
_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        task = TaskContext.get()
        name, out, at, made = "", None, 0, 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, sha1, size, least in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{path}/{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.gz"
                        out, at, made = system.open_output_stream(name, compression=None), 0, made + 1
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    revisit = least is not None and page != least
                    payload = b"" if revisit else html.encode()
                    member = record(page, url, payload, digest, least, revisit, date, size)
                    out.write(member)
                    rows.append({"page_id": page, "url": url, "digest": digest, "payload_bytes": size, "record_type": "revisit" if revisit else "response", "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, _INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) and return the index, itself a table in the shared folder.

    Payloads are the html in UTF-8, null as empty. Of equal payloads of `least_bytes` or more, the one of the smallest id is the
    response (each of them, where an id repeats; of null ids all, if there are no others) and the others revisit it. Digests
    meet first; only pages with a payload that others may have are dealt by it, and a hot payload's not even then. An empty table
    gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or storage.scratch_path(spark, "warc")
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1")).withColumn("size", F.octet_length("html").cast("long"))
    many = keyed.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("least")).where("n > 1 and least is not null")
    many = storage.materialise(many, "warc-copies")
    marked = storage.possibly(keyed, F.col("sha1"), many.select("sha1"), "sha1", "shared")
    alone = marked.where("not shared").select("page_id", "url", "html", "sha1", "size", F.lit(None).cast("long").alias("least"))
    copies = marked.where("shared").drop("shared")
    rows = alone.unionByName(storage.with_class(copies, many, ["sha1"], "n").drop("n"))
    return storage.materialise(rows.mapInArrow(_writer(folder, archive_bytes, date), _INDEX), "warc-index")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ_ARROW = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _reader(folder: str, with_payload: bool):
    schema = pa.schema([*_READ_ARROW, *([("payload", pa.binary())] if with_payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        name, handle = "", None
        for batch in batches:
            for file, low, high, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if file != name:
                    if handle is not None:
                        handle.close()
                    name, handle = file, system.open_input_file(file)
                raw = handle.read_at(high - low, low)
                rows = []
                for part in parts:
                    at = part["offset"] - low
                    head, payload = parse(raw[at : at + part["length"]])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    kind = head["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {file} at {part['offset']} does not match its digest")
                    number = lambda k, h=head: int(h[k]) if k in h else None
                    row = {"page_id": number("x-page"), "url": head.get("warc-target-uri"), "payload_bytes": number("x-payload-length") if kind == "revisit" else len(payload), "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page")}
                    rows.append(row | ({"payload": payload if kind == "response" else None} if with_payload else {}))
                yield pa.RecordBatch.from_pylist(rows, schema)
        if handle is not None:
            handle.close()

    return run


def read_records(index: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """The records of the given index rows, one row each; select rows of the index to read only those.

    A revisit's payload is null: it is that of the page it refers to. Digests are those of the full payloads. The number of reading
    tasks follows the bytes of the archives, not those of the index.
    """
    folder = folder or "file:///"
    by_offset = Window.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    apart = F.col("offset") - F.coalesce(F.lag(end).over(by_offset), F.col("offset")) > GAP_BYTES
    ranged = index.select("file", "offset", "length").withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_offset.rowsBetween(Window.unboundedPreceding, 0)))
    block = F.floor(F.col("offset") / RANGE_BYTES)
    ranges = ranged.groupBy("file", "run", block.alias("block")).agg(F.min("offset").alias("low"), F.max(end).alias("high"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"))
    spark = index.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, (index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    dealt = ranges.select("file", "low", "high", "parts").repartition(int(tasks), "file", "low").sortWithinPartitions("file", "low")
    return dealt.mapInArrow(_reader(folder, with_payload), _READ + (", payload binary" if with_payload else ""))
