"""Legacy ARC archives, their conversion to WARC, and reading WARC back."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_path
from .text import prepare, stored

# Payload bytes of one archive file, on average. A file is read whole by one task.
FILE_BYTES = 8 << 20
# Decisions (a page, a digest and a page) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Gzip at its fastest: most of the work of writing an archive is its compression.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
# Equal payloads of fewer bytes are stored again and again.
REVISIT_BYTES = 100
# Field names of a record line, by the version that the archive's first record states.
# They are fixed by the format.
FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
DATE = "20240101000000"
CRLF = "\r\n"
RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("media", T.StringType()),
        T.StructField("http", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("digest", T.StringType()),
    ]
)


def file_count(size: int) -> int:
    return max(1, -(-size // FILE_BYTES))


# Writing ARC


def arc_line(version: str, values: dict[str, str]) -> str:
    return " ".join(values.get(name, "-") for name in FIELDS[version])


def write_arc(pages: DataFrame, path: str, files: int, date: str = DATE) -> None:
    """Archive ``id, url, html`` as gzipped ARC files: odd ones of version 1, even ones of version 2.

    A record is an HTTP response; the page's number travels in the header ``X-Page-Id``.
    """

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        version = "1" if number % 2 else "2"
        started = False
        for batch in batches:
            lines = []
            if not started and batch.num_rows:
                started = True
                names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}
                body = f"{version} 0 framescope\n{arc_line(version, names)}\n"
                first = {"url": f"filedesc://part-{number}.arc", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200", "offset": "0", "length": str(len(body))}
                lines.append(f"{arc_line(version, first)}\n{body}")
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html"))):
                html = html or ""
                size = len(html.encode())
                mark = "" if page is None else f"X-Page-Id: {page}{CRLF}"
                document = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: {size}{CRLF}{mark}{CRLF}{html}"
                values = {"url": quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=~"), "ip": "0.0.0.0", "date": date, "type": "text/html", "status": "200", "file": f"part-{number}.arc", "length": str(len(document.encode()))}
                lines.append(f"{arc_line(version, values)}\n{document}")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    dealt = pages.repartition(files, F.xxhash64("id", "url"))
    dealt.mapInArrow(archive, "value string").write.option("lineSep", "\n").options(**GZIP).text(path)


# Reading ARC


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of one ARC file, the version record left out.

    The version record states which fields the lines have; the length, always the last one,
    says where a record ends. What follows a length that the file does not have is lost.
    """
    at, version = 0, "1"
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        fields = line.split(" ")
        first = line.startswith("filedesc:")
        if first:
            found = re.match(rb"(\d+) ", data[end + 1 : end + 32])
            version = found[1].decode() if found else "1"
            version = version if version in FIELDS else "1"
        names = FIELDS[version]
        if len(fields) < len(names) or not fields[-1].isdigit():
            raise ValueError(f"not an ARC record line: {line[:200]!r}")
        # An address with spaces is all that stands before the fixed number of other fields.
        rest = len(names) - 1
        values = dict(zip(names, [" ".join(fields[:-rest]), *fields[-rest:]]))
        size = int(values["length"])
        content = data[end + 1 : end + 1 + size]
        if len(content) < size:
            raise ValueError(f"the archive ends inside a record of {values['url'][:200]}")
        at = end + 1 + size
        if not first:
            yield values, content


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files (version 1 or 2, gzipped or not) with payload and digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for values, document in arc_records(unpacked(content.as_py())):
                    head, _, payload = document.partition(b"\r\n\r\n")
                    http = head.decode("utf-8", "replace")
                    page = re.search(r"(?im)^X-Page-Id: (-?\d+)", http)
                    rows.append((int(page[1]) if page else None, values["url"], values["date"], values["type"], http, payload.decode("utf-8", "replace"), len(payload), hashlib.sha256(payload).hexdigest()))
                    if len(rows) == 500:
                        yield record_batch(rows)
                        rows = []
                if rows:
                    yield record_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], RECORD.names)


# Conversion


def urn(page: Column, digest: Column) -> Column:
    """A record's name as a UUID of version 8 (free form): a mark, the page, and a check of the payload."""
    code = F.lpad(F.lower(F.hex(page)), 16, "0")
    text = F.concat(F.substring(digest, 1, 6), code)
    part = lambda start, size: F.substring(text, start, size)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 3), F.lit("-"), part(19, 4), F.lit("00000000>"))


def page_of(name: str | None) -> int | None:
    """The page of a name made by :func:`urn`."""
    if not name or "00000000>" not in name:
        return None
    digits = name[10:18] + name[19:23] + name[25:28] + name[30:33] + name[34:38]
    value = int(digits[6:22], 16)
    return value - (1 << 64) if value >> 63 else value


def decide(records: DataFrame) -> DataFrame:
    """``refers_to`` of each record: the page whose equal payload it revisits, else NULL.

    Only the digest travels with the page number; among equal payloads the first page is
    found by a partial aggregation, so a payload that a third of all pages share sends one
    row per task.
    """
    large = records.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("id").isNotNull())
    large = stored(large.select("id", "digest"), "digests")  # the archives are parsed for them once
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = first.where("first < last").select("digest", "first")
    later = large.select("id", "digest").join(first, "digest").where("id > first")
    return later.groupBy("id", "digest").agg(F.min("first").alias("refers_to"))


def convert(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """WARC records (one text each, without the closing blank lines) of parsed ARC records.

    A small number of decisions is broadcast, so that the payloads stay where they are read.
    """
    few = decisions.count() <= BROADCAST_ROWS
    joined = records.join(F.broadcast(decisions) if few else decisions, ["id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    body = F.concat("http", F.lit(CRLF * 2), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    day = F.date_format(F.coalesce(F.try_to_timestamp("date", F.lit("yyyyMMddHHmmss")), F.lit(datetime(1970, 1, 1))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(urn(F.col("id"), F.col("digest")), F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">")))),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Date: "), day),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit(f"{CRLF}WARC-Refers-To: "), urn(F.col("refers_to"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("body").cast("string")),
    )
    return joined.withColumn("body", body).select(F.concat(header, F.lit(CRLF * 2), "body").alias("value"))


def write_warc(warc: DataFrame, path: str, records: int) -> None:
    """Write WARC records as gzipped files of at most ``records`` each.

    The rows are written where they are; the blank lines that end a record are the line separator.
    """
    warc.write.option("lineSep", CRLF * 2).options(**GZIP).option("maxRecordsPerFile", records).text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of one WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        yield fields, block
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date`` of WARC files.

    The digest of a response is computed from its payload and must equal the declared one.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in warc_records(unpacked(content.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = head.decode("utf-8", "replace")
                    page = re.search(r"(?im)^X-Page-Id: (-?\d+)", http)
                    size = re.search(r"(?im)^Content-Length: (\d+)", http)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    length = len(payload)
                    if fields["warc-type"] == "revisit":
                        length = int(size[1])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
                    rows.append((int(page[1]) if page else None, length, digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-date")))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


NAMES = "id payload_bytes payload_digest record_type refers_to record_id url date".split()


def archive_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Store pages as ARC, convert the archives to WARC and read those back.

    The result has a row per page: :func:`read_warc`. Of the pages with equal payloads of at
    least ``REVISIT_BYTES`` bytes that with the smallest id is the response and later ones
    revisit it; repeated rows of that id are responses too, as are pages without an id. NULL
    or empty html is an empty payload; a NULL address is ``about:blank``. An empty table
    gives no row, and other columns are not read.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(pages[id_column].cast("long").alias("id"), pages[url_column].cast("string").alias("url"), pages[html_column].cast("string").alias("html"))
    count = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) + F.count("*") * 400, F.count("*")).first()
    files = file_count(count[0])
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(rows, arc, files)
    records = read_arc(spark, arc)
    decisions = stored(decide(records.select("id", "digest", "payload_bytes")), "revisits")
    write_warc(convert(records, decisions), warc, count[1] // files + 1)
    return read_warc(spark, warc)
