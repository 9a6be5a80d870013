"""Legacy ARC archives converted to WARC, both read and written through Spark's own file formats.

ARC files (versions 1 and 2) begin with a version block that declares its length and the fields of the header lines;
each document follows as a header line and as many bytes as the line declares. The converter parses these by the
version's fields and makes WARC records of them: an identifier, the ISO timestamp, the type and SHA-1 digests of block
and payload. Of records with equal payloads of at least ``least`` bytes that of the largest page id is the response, the
others revisit it. Archives are text with a record separator as line end, gzipped. A new ARC file, with its own version block, begins when
one has ROLL bytes, a WARC file after some records; they are read back whole files at a time.

Defined cases: null html is an empty payload; a null or blank url is written as "-"; a null page_id has no field
and reads back as null, never the target of a revisit while another holds the same payload; rows that repeat the
largest page_id with the same payload are responses alike; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import materialize, scratch, table

#: Repeated payloads (digest and page, some 100 bytes) up to which they are broadcast; beyond, the join shuffles, salted.
BROADCAST_ROWS = 100_000
#: Parts into which that join deals the holders of each payload.
SALTS = 32
#: Bytes of documents after which an ARC file ends; a larger document is a file of its own.
ROLL = 16_000_000

# The fields of a header line by version, and the first line's version number.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = "\r\n"


def _blob(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", roll: int = ROLL) -> None:
    """pages as ARC archives of some `roll` bytes (odd partitions version 2), each document an HTTP response with its page id in a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        number, size, out = 0, 0, []

        def file() -> pa.RecordBatch:
            """What is held as one row, which is one file."""
            fields = f"{version} 0 gazette\n{' '.join(ARC_FIELDS[version])}\n"
            tail = ["text/plain"] if version == 1 else ["text/plain", "200", "-", "-", "0", f"part-{part:05d}.arc"]
            begin = f"{' '.join([f'filedesc://part-{part:05d}-{number}.arc', '0.0.0.0', date, *tail, str(len(fields))])}\n{fields}"
            return pa.RecordBatch.from_arrays([pa.array(["\n".join([begin, *out])], pa.string())], ["value"])

        for b in batches:
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                html = html or ""
                length = len(html.encode())
                head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", *([f"X-Page-Id: {page}"] if page is not None else [])]
                block = CRLF.join([*head, "", ""]) + html
                place = "".join((url or "-").split()) or "-"
                mime = ["text/html"] if version == 1 else ["text/html", "200", "-", "-", "0", f"part-{part:05d}.arc"]
                out.append(f"{' '.join([place, '0.0.0.0', date, *mime, str(len(block.encode()))])}\n{block}")
                size += length
                if size >= roll:
                    yield file()
                    number, size, out = number + 1, 0, []
        if out:
            yield file()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "value string")
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").text(path)


def arc_records(data: bytes) -> Iterator[dict]:
    """The documents of one ARC file: fields by the version's names, and their declared bytes as block."""
    at = io.BytesIO(data)
    version = 0
    while line := at.readline():
        parts = line.decode("utf-8", "replace").split()
        if not parts:
            continue
        fields = ARC_FIELDS.get(version, ARC_FIELDS[1])
        if parts[0].startswith("filedesc://"):
            block = at.read(int(parts[-1]))
            version = int(block.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if len(parts) < len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not a header line of ARC version {version}: {line[:80]!r}")
        block = at.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"a document of {parts[-1]} bytes ends after {len(block)}")
        yield dict(zip(fields, parts, strict=False)) | {"version": version, "block": block}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes with the blank line, and payload of an HTTP response."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split(CRLF)[1:] if ": " in x)
    return fields, head + sep, payload


def _batch(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def read_arc(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """page_id, payload_bytes, sha1 of each document, and with contents also url, date, mime, head, html."""
    names = ["page_id", "payload_bytes", "sha1", *(["url", "date", "mime", "head", "html"] if contents else [])]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = []
                for r in arc_records(_blob(data)):
                    fields, head, payload = http_parts(r["block"])
                    page = fields.get("X-Page-Id")
                    row = (int(page) if page else None, len(payload), hashlib.sha1(payload).hexdigest())
                    rows.append((*row, r["URL"], r["Archive-date"], r["Content-type"], head.decode(), payload.decode()) if contents else row)
                    if len(rows) == 500:
                        yield _batch(rows, names, kinds)
                        rows = []
                yield _batch(rows, names, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, sha1 string" + ", url string, date string, mime string, head string, html string" * contents)


def record_id(url: str, date: str, page: int | None, sha1: str) -> str:
    """Of the page and its payload; without a page id of the place and time."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {sha1}' if page is None else f'{page} {sha1}')}>"


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_warc(documents: DataFrame, digests: DataFrame, path: str, least: int = 1000) -> None:
    """The documents of read_arc as WARC archives; digests: the same without contents."""
    best = digests.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("target"), F.count("*").alias("holders"))
    best = materialize(best.where("holders > 1").select(F.col("sha1").alias("__sha1"), "target"), "repeated")
    same = (F.col("sha1") == F.col("__sha1")) & (F.col("payload_bytes") >= least)
    if best.count() <= BROADCAST_ROWS:
        rows = documents.join(F.broadcast(best), same, "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        parts = best.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = documents.withColumn("__salt", salt).join(parts, same & (F.col("__salt") == F.col("__part")), "left")
    rows = rows.drop("__sha1", "__salt", "__part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                revisit = r["target"] is not None and r["page_id"] != r["target"]
                date = datetime.strptime(r["date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                block = r["head"] + ("" if revisit else r["html"])
                data = block.encode()
                head = {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": record_id(r["url"], r["date"], r["page_id"], r["sha1"]),
                    "WARC-Date": date,
                    "WARC-Target-URI": r["url"],
                    "WARC-Payload-Digest": _b32(r["sha1"]),
                    "WARC-Block-Digest": _b32(hashlib.sha1(data).hexdigest()),
                }
                if revisit:
                    head |= {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": record_id("", "", r["target"], r["sha1"]),
                        "X-Refers-To-Page-Id": str(r["target"]),
                    }
                head |= {"X-Payload-Length": str(r["payload_bytes"]), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(data))}
                out.append("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + CRLF + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 20_000).option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record's length doesn't meet its end")
        yield fields, data[start:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, record_id, url, date, html (null in a revisit); digests are verified."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date", "html"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = []
                for fields, block in warc_records(_blob(data)):
                    http, _, payload = http_parts(block)
                    kind, want = fields["WARC-Type"], fields["WARC-Payload-Digest"]
                    digest, size = base64.b32decode(want[5:]).hex(), int(fields["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    page, to = http.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], payload.decode() if kind == "response" else None))
                    if len(rows) == 500:
                        yield _batch(rows, names, kinds)
                        rows = []
                yield _batch(rows, names, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string, html string")


def convert(spark: SparkSession, arc: str, warc: str, least: int = 1000) -> None:
    """ARC archives under one path to WARC archives under another."""
    write_warc(read_arc(spark, arc), read_arc(spark, arc, contents=False), warc, least)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL: dict[str, str] = {
    "op10_warc": """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
}
