"""WARC archives: one gzip member a record, written by tasks and read back by byte ranges.

The reader is splittable without an index. A task searches its byte range for the gzip magic,
decodes the beginning of each candidate to see whether a WARC header follows, and owns exactly the
records whose member starts inside its range; the last one is read to its end beyond the range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, text

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
DATE = "2000-01-01T00:00:00Z"
LEAST = 0
_STEP = 1 << 16
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}")


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat the payload of a smaller page_id.

    Only ids and digests are shuffled; a payload shared by many pages is pre-aggregated per task.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    later = rows.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))
    return later.select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Write a record per row into ``path``/part-*.warc.gz; returns the manifest (file, bytes, records).

    Of rows with equal payloads of at least ``least`` bytes the smallest page_id is a response and the
    others revisit it (rows that repeat that page_id too are responses). A null html is an empty
    payload; a null page_id sorts last. An empty table writes no record. A task writes under a name of
    its attempt and renames at its end, so a repeated task replaces its file whole.
    """
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest")).alias("p")
    later = revisits(pages, least).alias("r")
    on = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    rows = rows.join(later, on, "left").select("p.page_id", "p.url", "p.payload", "p.digest", "r.refers_to")

    def archive(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _open(path)
        name = f"part-{task.partitionId():06d}.warc.gz"
        part, n, size, out = f"{root}/_{name}.{task.taskAttemptId()}", 0, 0, None
        for block in text.blocks(batches, "payload"):
            out = out or fs.open_output_stream(part)
            for page, url, payload, digest, refers in zip(*(block.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                member = _member(page, url, payload, digest, refers, date)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out:
            out.close()
            fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    return storage.materialize(rows.mapInArrow(archive, "file string, bytes long, records long"), "warc-manifest")


def _uri(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _member(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    kind = "response" if refers is None else "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers is None else head
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: {_uri(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _inflate(source, at: int, head: bytes) -> tuple[bytes, int] | None:
    """(record, end) of the gzip member at ``at`` of an open file, or None if it holds no WARC record."""
    unpack, parts, end, seen = zlib.decompressobj(wbits=31), [], at, 0
    while not unpack.eof:
        chunk = head or source.read_at(_STEP, end)
        head = b""
        if not chunk:
            return None
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        end += len(chunk)
        seen += len(parts[-1])
        if seen >= 6 and not parts[0].startswith(b"WARC/"):
            parts = [b"".join(parts)]
            if not parts[0].startswith(b"WARC/"):
                return None
    return b"".join(parts), end - len(unpack.unused_data)


def members(source, low: int, high: int) -> Iterator[bytes]:
    """Decoded records of an open file whose gzip member starts in [low, high)."""
    at, window, base = low, b"", low
    while at < high:
        if not base <= at < base + len(window) - 2:
            base, window = at, source.read_at(_STEP, at)
            if len(window) < 3:
                return
        spot = window.find(MAGIC, at - base)
        if spot < 0:
            at = base + len(window) - 2
            continue
        at = base + spot
        if at >= high:
            return
        found = _inflate(source, at, window[spot:])
        if found is None:
            at += 1
        else:
            yield found[0]
            at = found[1]


def _fields(record: bytes) -> tuple | None:
    head, _, block = record.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    kind = named.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    block = block[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda uri: int(m[1]) if (m := re.search(r":(-?\d+)>$", uri or "")) else None
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {named.get('WARC-Record-ID')}")
    return number(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), size, digest, kind, number(named.get("WARC-Refers-To")), payload if kind == "response" else None


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """One row a response or revisit record of ``path``/*.warc.gz, read in ranges of ``split`` bytes.

    Other record types are skipped; a response whose payload does not match its digest is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("low"))
    ranges = ranges.repartition(F.col("path"), F.col("low"))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low in zip(batch.column("path").to_pylist(), batch.column("low").to_pylist()):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    kept: list[tuple] = []
                    size = 0
                    for record in members(source, low, low + split):
                        if row := _fields(record):
                            kept.append(row)
                            size += len(record)
                        if size > text.BLOCK_BYTES:
                            yield _batch(kept)
                            kept, size = [], 0
                    if kept:
                        yield _batch(kept)

    return ranges.mapInArrow(scan, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RECORD.split(", ")])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT page_id, payload_bytes, first, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
