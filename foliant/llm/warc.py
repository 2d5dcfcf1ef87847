"""WARC archives: index first, then coalesced byte-range reads.

Archives lie in the folder named by spark.checkpoint.dir (or one given), a gzip member for each
record, so that any record can be read by its range.  A task writes files of its own, named at
random, and returns index rows; only a task that ends well leaves rows in the index, so the files
of lost attempts are never read.  Readers sort the index by file and offset and fetch neighbours
with one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, fresh_path, release, ship, spread

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:foliant:page:"
#: A task starts another file beyond this size.
FILE_BYTES = 256 << 20
#: Neighbouring records are read at once if the gap and the whole stay below these.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
LEVEL = 4

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, payload_bytes long"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64())])


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that executors open archives on, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{NAME}{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(NAME)
    return int(number) if number else None


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return headers, rest[: int(headers["Content-Length"])]


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload), digest


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")


def write(pages: DataFrame, *, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the index.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest
    page_id is a response and the others revisit it; rows that repeat this page_id are responses
    too.  A null html is the empty payload, a null url gives no target URI, and a null page_id
    counts as the smallest.  An empty table writes nothing."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    sha = F.sha1("payload").alias("sha")
    groups = source.filter(F.octet_length("payload") >= least_bytes).groupBy(sha).agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("sha", "lead")
    groups = cut(groups, "warc-groups")
    joined = source.withColumn("sha", sha).join(groups.withColumn("grouped", F.lit(True)), "sha", "left")
    joined = joined.select("page_id", "url", "payload", "lead", (F.coalesce("grouped", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("lead"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = filesystem(folder)
        disk.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, lead, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = disk.open_output_stream(f"{root}/{name}", compression=None)
                        first = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: foliant\r\n")
                        out.write(first)
                        at = len(first)
                    data, digest = page_record(page_id, url, payload, lead, revisit)
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), page_id, url, digest, "revisit" if revisit else "response", len(payload)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_INDEX), _INDEX.types, strict=True)], schema=_INDEX)
                release()
        finally:
            if out is not None:
                out.close()

    return cut(joined.mapInArrow(run, INDEX), "warc-index")


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _parsed(member: bytes) -> tuple:
    headers, block = parse(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], digest, length, _page(headers["WARC-Refers-To"]) if revisit else None, None if revisit else payload


def ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """(first row, last row + 1, start, end) of the reads that cover sorted (offset, length) rows."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            first, _, start, end = out[-1]
            out[-1] = (first, i + 1, start, max(end, offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def read(index: DataFrame) -> DataFrame:
    """The selected records of an index (any rows of it), payloads included; a response's payload
    is checked against its digest.  A revisit has no payload of its own."""
    ship(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            files, spans = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if files[lo] != name:
                    disk, path = filesystem(files[lo])
                    name, source = files[lo], disk.open_input_file(path)
                for first, last, start, end in ranges(spans[lo:hi]):
                    data = source.read_at(end - start, start)
                    rows = [_parsed(data[o - start : o - start + n]) for o, n in spans[lo + first : lo + last]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
                lo = hi
            release()

    # Tasks by the bytes they read, not by those of the index.
    part = F.floor(F.col("offset") / F.lit(2 * READ_BYTES))
    n_tasks = spread(index.agg(F.sum("length")).first()[0] or 0, 8 * READ_BYTES)
    return index.select("file", "offset", "length").repartition(n_tasks, "file", part).sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, url, payload) of records, revisits with the payload of what they refer to."""
    own = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").select("page_id", "url", "refers_to")
    held = own.select(F.col("page_id").alias("lead"), F.col("payload")).dropDuplicates(["lead"])
    return own.select("page_id", "url", "payload").unionByName(again.join(held, F.col("refers_to").eqNullSafe(F.col("lead"))).select("page_id", "url", "payload"))
