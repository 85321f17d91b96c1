"""Legacy archive converter: ARC records become WARC records.

An ARC file starts with a version block that names the fields of every header line after it: version 1 has
five, version 2 ten. A header line ends with the declared length of what follows it. The converter reads
these lines by the fields of their version, takes the declared bytes, and makes up what WARC wants: a
record identifier from the record's own bytes, an ISO timestamp from the ARC date, a record type from scheme
and content type, digests of block and payload. Records whose payload another record of the collection has
become revisits of it.

Archives are gzip files written and read by Spark's text source, which works on any store. The reader puts
lines together again byte for byte, so payloads may hold any bytes, and parses the stream of a file with one
record in memory. Files are as large as the partitions that wrote them.

Cases: null html is an empty payload; null and odd URLs are escaped or stand as ``unknown:``; short dates are
filled up; equal payloads of fewer than ``MIN_REVISIT`` bytes are not revisits; of rows with equal payloads
and key the ties are settled by the key alone, so repeated rows are all responses; a null key is written as
empty and never refers to anything; damaged header lines raise an error; an empty table gives archives
without pages and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.sources.checkpoint import shared_folder

MIN_REVISIT = 1_000
CRAWL_DATE = "20240102030405"
KEY_HEADER = "X-Page-Id"
END = b"\r\n"
# fixed values: the fields of a header line by version
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "key string, url string, date string, type string, content_type string, http binary, payload binary, "
    "payload_bytes long, digest string, block_digest string, record_id string"
)


def escaped(url: str | None) -> str:
    """An ARC field holds no white space."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|") if url else "unknown:"


def http_head(key: str, size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY_HEADER}: {key}\r\nContent-Length: {size}\r\n\r\n".encode()


def version_block(version: str, name: str) -> bytes:
    body = f"{version} 0 barograph\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": CRAWL_DATE, "Content-type": "text/plain"}
    return header_line(version, own, len(body)) + body


def header_line(version: str, values: dict[str, str], size: int) -> bytes:
    values = values | {"Archive-length": str(size)}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def write_arc(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One ARC file per partition, versions 1 and 2 in turn."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = str(1 + part % 2)
        pending = [version_block(version, f"part-{part}.arc")]
        for b in batches:
            for key, url, html in zip(*(c.to_pylist() for c in b.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                doc = http_head("" if key is None else key, len(payload)) + payload
                own = {"URL": escaped(url), "IP-address": "192.0.2.1", "Archive-date": CRAWL_DATE, "Content-type": "text/html"}
                own |= {"Result-code": "200", "Offset": "0", "Filename": f"part-{part}.arc"}
                pending.append(header_line(version, own, len(doc)) + doc)
            yield pa.RecordBatch.from_arrays([pa.array(pending, pa.binary())], ["value"])
            pending = []

    rows = pages.select(
        F.col(key_col).cast("string").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    write_bytes(rows.mapInArrow(run, "value binary"), folder, "\n")


def write_bytes(rows: DataFrame, folder: str, end: str) -> None:
    """Each value, as it is, and ``end`` after it, into gzip files."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(folder, compression="gzip")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``file, value``: the bytes between line feeds of each file, in order within a partition."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


class Stream:
    """Bytes of one file from its lines: by line, or by number of bytes."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines = lines
        self.rest = b""
        self.more = True

    def pull(self) -> bool:
        line = next(self.lines, None)
        if line is None:
            self.more = False
            return False
        self.rest += line + b"\n"
        return True

    def line(self) -> bytes | None:
        if not self.rest and not self.pull():
            return None
        line, _, self.rest = self.rest.partition(b"\n")
        return line

    def take(self, size: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < size:
            line = next(self.lines, None)
            if line is None:
                raise ValueError("a record ends before its declared length")
            parts += [line, b"\n"]
            have += len(line) + 1
        data = b"".join(parts)
        self.rest = data[size:]
        return data[:size]


def by_file(batches) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Lines of each file; files don't mix within a partition."""
    rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    pending = next(rows, None)

    def lines(name):
        nonlocal pending
        while pending is not None and pending[0] == name:
            yield pending[1]
            pending = next(rows, None)

    while pending is not None:
        name = pending[0]
        own = lines(name)
        yield name, own
        for _ in own:
            pass


class Record(NamedTuple):
    url: str
    date: str
    content_type: str
    body: bytes


def arc_records(lines: Iterator[bytes]) -> Iterator[Record]:
    """Records of one ARC file, the version block first."""
    stream, fields = Stream(lines), ARC_FIELDS["1"]
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").split(" ")
        version_line = values[0].startswith("filedesc:")
        names = fields if not version_line or len(values) == len(fields) else ARC_FIELDS["2" if len(values) == 10 else "1"]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        own = dict(zip(names, values))
        body = stream.take(int(own["Archive-length"]))
        if version_line:
            version = body.split(b" ", 1)[0].decode()
            fields = ARC_FIELDS.get(version, ARC_FIELDS["1"])
        yield Record(own["URL"], own["Archive-date"], own["Content-type"], body)


def iso_date(date: str) -> str:
    """ARC dates have 12 or 14 digits, old ones fewer; what is missing is the start of the period."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_type(record: Record) -> str:
    if record.url.startswith("filedesc:"):
        return "warcinfo"
    if record.content_type == "text/dns" or not record.body.startswith(b"HTTP/"):
        return "resource"
    return "response"


def converted(record: Record) -> tuple:
    """A row of RECORD_SCHEMA."""
    kind = record_type(record)
    head, payload, key = b"", record.body, None
    if kind == "response":
        at = record.body.find(b"\r\n\r\n")
        at = len(record.body) if at < 0 else at + 4
        head, payload = record.body[:at], record.body[at:]
        found = re.search(rb"(?mi)^" + KEY_HEADER.encode() + rb": *([^\r\n]*)", head)
        key = found[1].decode() if found and found[1] else None
    block = sha1(record.body)
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{record.url} {record.date} {key} {block}")
    content_type = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}
    return (
        key, record.url, iso_date(record.date), kind, content_type.get(kind, record.content_type), head, payload,
        len(payload), sha1(payload), block, f"urn:uuid:{own}",
    )


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of RECORD_SCHEMA for the records of all ARC files in ``folder``."""
    kinds = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.int64()] + [pa.string()] * 3
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def run(batches):
        for _, lines in by_file(batches):
            rows, size = [], 0
            for r in arc_records(lines):
                rows.append(converted(r))
                size += len(r.body)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return read_lines(spark, folder).mapInArrow(run, RECORD_SCHEMA)


def with_targets(records: DataFrame) -> DataFrame:
    """``refers_to``: the key of the record that a record revisits, by payload.

    The largest key of each large payload is an aggregate; only payloads that several records have are
    joined back, and the join may split a payload that many records have.
    """
    large = records.filter((F.col("payload_bytes") >= MIN_REVISIT) & F.col("key").isNotNull())
    number = F.col("key").cast("long")
    first = (
        large.groupBy("digest")
        .agg(F.max(number).alias("target"), F.min(number).alias("least"))
        .filter("target <> least")
        .select("digest", "target")
    )
    target = F.when((F.col("payload_bytes") >= MIN_REVISIT) & (number < F.col("target")), F.col("target"))
    return records.join(first, "digest", "left").withColumn("refers_to", target.cast("string")).drop("target")


def warc_record(r: dict) -> bytes:
    """The bytes of one record without the two line ends after it."""
    body, kind = r["http"] + r["payload"], r["type"]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"])]
    if kind == "warcinfo":
        body = b"software: barograph\r\nformat: WARC File Format 1.1\r\n"
    else:
        fields += [("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", r["digest"])]
    if r["refers_to"] is not None:
        body = r["http"]
        fields[0] = ("WARC-Type", "revisit")
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", r["refers_to"])]
    if r["key"] is not None:
        fields.append((KEY_HEADER, r["key"]))
    fields += [("WARC-Block-Digest", sha1(body)), ("Content-Type", r["content_type"]), ("Content-Length", str(len(body)))]
    return END.join([b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in fields), b"", body])


def write_warc(records: DataFrame, folder: str) -> None:
    names = ["key", "url", "date", "type", "content_type", "http", "payload", "digest", "record_id", "refers_to"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in b.to_pylist()], pa.binary())], ["value"])

    write_bytes(records.select(*names).mapInArrow(run, "value binary"), folder, "\r\n\r\n")


def warc_records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = Stream(lines)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        body = stream.take(int(fields["content-length"]))
        if fields.get("warc-block-digest", sha1(body)) != sha1(body):
            raise ValueError(f"damaged record {fields.get('warc-record-id')}")
        yield fields, body


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the page records."""
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in kind.split(", ")]

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def run(batches):
        for _, lines in by_file(batches):
            rows = []
            for fields, body in warc_records(lines):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = body.partition(b"\r\n\r\n")
                size = re.search(rb"(?mi)^content-length: *(\d+)", head)
                digest = fields["warc-payload-digest"]
                if fields["warc-type"] == "response" and (len(payload) != int(size[1]) or sha1(payload) != digest):
                    raise ValueError(f"damaged payload {fields['warc-record-id']}")
                hexadecimal = base64.b32decode(digest.removeprefix("sha1:")).hex()
                key, target = number(fields.get(KEY_HEADER.lower())), number(fields.get("x-refers-to-page-id"))
                rows.append((key, int(size[1]), hexadecimal, fields["warc-type"], target))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return read_lines(spark, folder).mapInArrow(run, kind)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> None:
    """All ARC files of one folder into WARC files of another."""
    write_warc(with_targets(read_arc(spark, arc_folder)), warc_folder)


def archived(pages: DataFrame) -> DataFrame:
    """Pages into ARC files, those into WARC files, and the page records read back from them."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")


