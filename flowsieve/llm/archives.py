"""Legacy ARC archives to WARC, with revisits for payloads that were stored before.

An ARC file starts with a record that names its version and the fields of the header lines that
follow; each header line ends with the length of its block. The converter reads them by that
definition and writes equivalent WARC records: identifiers from the record's key, dates, types,
block and payload digests. Records with a payload that an earlier one holds become revisits.
Archives are written and read by tasks, file by file; Spark decides which record is the first.

The query writes ``pages`` as ARC files of both versions, converts them and reads the WARC files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import open_folder, records, scratch_folder, stored, table

ARC_BYTES = 16 << 20
LEVEL = 3
ARC_DATE = "20240101000000"
RECORD_IDS = uuid.UUID("5bd9a5c4-7d4f-4f0e-9c55-0b8e4d1d6a0f")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed by the format: the fields of a header line by version; the length is always last.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER = "X-Page-Id"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    number: int  # place in the file, from 1; the version record is 0
    fields: dict[str, str]  # by the names of the file's own definition
    block: bytes


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member of its own."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(data: bytes) -> bytes:
    """The file uncompressed; members are read in turn from a buffer, as copying what follows each would
    take time with the square of their number."""
    if data[:2] != b"\x1f\x8b":
        return data
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as file:
        return file.read()


def arc_start(name: str, version: int, date: str = ARC_DATE) -> bytes:
    """The version record of an ARC file."""
    block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(block)}\n".encode() + block


def arc_record(name: str, version: int, offset: int, url: str, kind: str, block: bytes, date: str = ARC_DATE) -> bytes:
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"
    rest = "" if version == 1 else f"200 {digest(block)} - {offset} {name} "
    return f"\n{url} 0.0.0.0 {date} {kind} {rest}{len(block)}\n".encode() + block


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records of an ARC file, compressed or not, the version record first."""
    data, at, number = plain(data), 0, 0
    names: list[str] = []
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without an end at byte {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"ARC header line without a length at byte {at}")
        block = data[end + 1 : end + 1 + int(values[-1])]
        if len(block) < int(values[-1]):
            raise ValueError(f"ARC record cut short at byte {at}")
        if not number:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0][:1].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError("unknown ARC version")
            names = (lines[1] if len(lines) > 1 else ARC_FIELDS[version]).split(" ")
        if len(values) < len(names):
            raise ValueError(f"ARC header line of {len(values)} fields, {len(names)} declared")
        head = len(values) - len(names) + 1  # spaces in an old URL
        yield ArcRecord(number, dict(zip(names, [" ".join(values[:head]), *values[head:]])), block)
        at, number = end + 1 + len(block), number + 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload; a block without an HTTP header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def http_value(header: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$".encode(), header)
    return found[1].decode() if found else None


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_IDS, key)}>"


def record_key(record: ArcRecord, name: str) -> str:
    """What identifies a record for good: the page it holds, else its place in the named file."""
    page = http_value(split_http(record.block)[0], PAGE_HEADER)
    return f"page:{page}:{name}:{record.number}" if page is not None else f"{name}:{record.number}"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def convert_record(record: ArcRecord, name: str, first: tuple[str, str | None] | None = None) -> bytes:
    """The equivalent WARC record; ``first`` is key and page of the record that it revisits."""
    f = record.fields
    date = f["Archive-date"].ljust(14, "0")
    shared = [("WARC-Date", f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z")]
    key = record_key(record, name)
    if not record.number:
        return warc_record(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(key)), *shared, ("Content-Type", "text/plain")], record.block
        )
    header, payload = split_http(record.block)
    kind, media = ("response", "application/http; msgtype=response") if header else ("resource", f["Content-type"])
    out = [
        ("WARC-Record-ID", record_id(key)), *shared, ("WARC-Target-URI", f["URL"]), ("WARC-IP-Address", f["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", media),
    ]
    if first is None:
        return warc_record([("WARC-Type", kind), *out], record.block)
    refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0]))]
    if first[1] is not None:
        refers.append(("X-Refers-To-Page", first[1]))
    return warc_record([("WARC-Type", "revisit"), *out, *refers, ("X-Payload-Length", str(len(payload)))], header)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, compressed or not."""
    data, at = plain(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(fields["Content-Length"])
        block = data[start : start + size]
        if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest differs at byte {at}")
        yield fields, block
        at = start + size + 4


def write_arcs(pages: DataFrame, folder: str, arc_bytes: int = ARC_BYTES) -> DataFrame:
    """Writes ``page_id, url, html`` as ARC files, odd tasks as version 2; one row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        version = 1 + TaskContext.get().partitionId() % 2
        done: list[str] = []
        parts: list[bytes] = []
        name, size = "", 0

        def flush() -> None:
            nonlocal parts
            if parts:
                with system.open_output_stream(f"{place}/{name}") as out:
                    out.write(b"".join(parts))
                done.append(name)
                parts = []

        for batch in batches:
            for page_id, url, html in records(batch, "page_id", "url", "html"):
                if not parts:
                    name = f"pages-{uuid.uuid4().hex}.arc.gz"
                    start = arc_start(name, version)
                    parts, size = [member(start)], len(start)
                payload = (html or "").encode()
                head = ["HTTP/1.0 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                head += [] if page_id is None else [f"{PAGE_HEADER}: {page_id}"]
                block = "\r\n".join([*head, "", ""]).encode() + payload
                record = arc_record(name, version, size, url or "", "text/html", block)
                parts.append(member(record))
                size += len(record)
                if size >= arc_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return stored(pages.select("page_id", "url", "html").mapInArrow(write, "path string"), "arcs")


def _one_by_one(files: DataFrame) -> DataFrame:
    """Few files to a task."""
    tasks = min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(max(tasks, 1))


_INDEX = "path string, number int, key string, page long, payload_bytes long, digest string"


def index_arcs(arcs: DataFrame, folder: str) -> DataFrame:
    """A row per record of the ARC files: key, page, payload length and digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        for batch in batches:
            for (name,) in records(batch, "path"):
                with system.open_input_stream(f"{place}/{name}") as file:
                    data = file.read()
                rows = []
                for record in read_arc(data):
                    if record.number:
                        header, payload = split_http(record.block)
                        page = http_value(header, PAGE_HEADER)
                        rows.append(
                            (name, record.number, record_key(record, name), None if page is None else int(page), len(payload), digest(payload))
                        )
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")]
                )

    return stored(_one_by_one(arcs.select("path")).mapInArrow(read, _INDEX), "arc-index")


def convert_arcs(arcs: DataFrame, folder: str, target: str, least_bytes: int = 0) -> DataFrame:
    """One WARC file for each ARC file; one row per file.

    Of records with equal payloads of at least ``least_bytes``, that with the smallest page is stored
    (records without a page come last, ties go by file and place); the others revisit it.
    """
    index = index_arcs(arcs, folder)
    own = F.struct(F.col("page").isNull().alias("none"), "page", "path", "number", "key")
    large = index.where(F.col("payload_bytes") >= least_bytes)
    # written: only a join of two plain exchanges lets the engine split a digest that very many records share
    firsts = stored(large.groupBy("digest").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1"), "arc-firsts")
    again = large.join(firsts, "digest").where((F.col("path") != F.col("first.path")) | (F.col("number") != F.col("first.number")))
    decided = again.groupBy("path").agg(  # no more than the records of one file
        F.collect_list(F.struct("number", F.col("first.key").alias("key"), F.col("first.page").cast("string").alias("page"))).alias("revisits")
    )
    work = arcs.select("path").join(decided, "path", "left")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        out_system, out_place = open_folder(target)
        done = []
        for batch in batches:
            for name, revisits in records(batch, "path", "revisits"):
                first = {r["number"]: (r["key"], r["page"]) for r in revisits or ()}
                with system.open_input_stream(f"{place}/{name}") as file:
                    data = file.read()
                written = f"{name.removesuffix('.arc.gz')}-{uuid.uuid4().hex}.warc.gz"
                with out_system.open_output_stream(f"{out_place}/{written}") as out:
                    for record in read_arc(data):
                        out.write(member(convert_record(record, name, first.get(record.number))))
                done.append(written)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return stored(_one_by_one(work).mapInArrow(convert, "path string"), "warcs")


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warcs(warcs: DataFrame, folder: str) -> DataFrame:
    """A row per response or revisit of the WARC files; stored payloads are checked against their digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        for batch in batches:
            for (name,) in records(batch, "path"):
                with system.open_input_stream(f"{place}/{name}") as file:
                    data = file.read()
                rows = []
                for fields, block in read_warc(data):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    header, payload = split_http(block)
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest(payload) != stated:
                        raise ValueError(f"payload digest differs in {name}")
                    page, first = http_value(header, PAGE_HEADER), fields.get("X-Refers-To-Page")
                    size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    rows.append((None if page is None else int(page), size, stated, kind, None if first is None else int(first)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PAGES.split(", ")]
                )

    return _one_by_one(warcs.select("path")).mapInArrow(read, _PAGES)


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` through ARC and WARC files. NULL html is an empty payload, a NULL url is written as ``-``, a
    NULL page_id stays NULL; of repeated rows one is stored; an empty table gives no row."""
    arcs_at, warcs_at = scratch_folder(spark, "arc"), scratch_folder(spark, "warc")
    arcs = write_arcs(table(spark, sf_dir, "pages"), arcs_at)
    return read_warcs(convert_arcs(arcs, arcs_at, warcs_at), warcs_at)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
