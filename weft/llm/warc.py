"""Legacy ARC archives to WARC, with revisits for repeated payloads.

``write_arc`` makes legacy archives (either version of the header line) of a table of pages;
``convert`` turns archives into WARC files; ``read_warc`` reads those back. Archives are streamed record by
record by their declared lengths, so a task holds one record and the revisits of one archive file.
Spark's text writer writes them: the end of a record is its line separator, the bytes of a record are
passed through, a lost task leaves nothing behind. The files are gzip streams.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, open_shared, scratch_path

#: Fields of the record header lines by version (fixed by the format; the length is last in both).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
#: Payloads below this size are never stored as revisits.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURED = "20240101000000"
END = "\r\n\r\n"
#: Bytes of records handed over at a time.
BATCH = 4 << 20


def file_head(version: int, date: str) -> str:
    """The version block that opens an archive file."""
    body = f"{version} 0 weft\n{' '.join(ARC_FIELDS[version])}\n"
    line = {1: f"filedesc://weft.arc 0.0.0.0 {date} text/plain {len(body)}", 2: f"filedesc://weft.arc 0.0.0.0 {date} text/plain 200 - - 0 weft.arc {len(body)}"}
    return f"{line[version]}\n{body}\n"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CAPTURED) -> None:
    """Write a table of pages as ARC files, one per partition, versions 1 and 2 in turn.

    The payload is the text in UTF-8 (NULL: empty) behind an HTTP head that names the page; characters that would
    break a header line are escaped in the URL (NULL: ``unknown:``). Nothing is shuffled.
    """
    html = F.coalesce(col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(col(url_col).cast("string"), F.lit("unknown:")), r"[\x00-\x20]", "%20")
    named = F.coalesce(F.concat(F.lit("X-Page-Id: "), col(id_col).cast("long").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), named, F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    rows = pages.select(F.when(F.length(url) > 0, url).otherwise("unknown:").alias("url"), F.concat(head, html).alias("body"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))

    def line(version: int) -> Column:
        middle = " - - 0 weft.arc " if version == 2 else " "
        code = " 200" if version == 2 else ""
        return F.concat("url", F.lit(f" 0.0.0.0 {date} text/html{code}{middle}"), F.octet_length("body").cast("string"), F.lit("\n"), "body")

    first = F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) == 0
    one, two = (F.concat(F.when(first, F.lit(file_head(v, date))).otherwise(F.lit("")), line(v)) for v in (1, 2))
    write_text(rows.select(F.when(F.col("part") % 2 == 0, one).otherwise(two).alias("record")), path, "\n")


def write_text(records: DataFrame, path: str, end: str) -> None:
    records.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes

    @property
    def http(self) -> tuple[bytes, bytes]:
        """HTTP head (without its blank line) and payload; a body without a head is all payload."""
        if self.body.startswith(b"HTTP/"):
            m = re.search(rb"\r?\n\r?\n", self.body)
            if m:
                return self.body[: m.start()], self.body[m.end() :]
        return b"", self.body


def arc_records(stream) -> Iterator[ArcRecord]:
    """The records of an archive; version blocks may come anywhere (archives may be concatenated)."""
    version = 1
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        fields = line.decode("utf-8", "replace").split(" ")
        length = int(fields[-1])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError("archive ends within a record")
        if line.startswith(b"filedesc:"):
            version = 2 if body[:1] == b"2" else 1
            continue
        n = len(ARC_FIELDS[version])
        if len(fields) < n:
            raise ValueError(f"header line of version {version} has {len(fields)} fields")
        yield ArcRecord(" ".join(fields[: len(fields) - n + 1]), *fields[len(fields) - n + 1 :][:3], body)


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def w3c(date: str) -> str:
    """A 14-digit date (shorter ones are filled up) in the form of WARC-Date."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(path: str, at: int) -> str:
    """The identifier made for record ``at`` of an archive file: the same at every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit('/', 1)[-1]}#{at}')}>"


def opened(name: str):
    stream = open_shared(name)
    return gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream


def listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path")


KEYS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("n", pa.int64()), ("digest", pa.string())])


def payload_keys(files: DataFrame) -> DataFrame:
    """(path, at, page_id, url, date, n, digest) of every record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = []
                with opened(name) as stream:
                    for at, record in enumerate(arc_records(stream)):
                        head, payload = record.http
                        rows.append((name, at, number(header(head, "X-Page-Id")), record.url, w3c(record.date), len(payload), hashlib.sha256(payload).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), KEYS)], schema=KEYS)

    return files.mapInArrow(run, "path string, at long, page_id long, url string, date string, n long, digest string")


def revisits(keys: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(path, again): for each archive its records that repeat the payload of another one.

    Of equal payloads the record of the smallest page id comes first (no id: last; then by file and place).
    The list of a file is as long as the file at most.
    """
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "path", "at", "url", "date")
    groups = keys.where(F.col("n") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("records")).where("records > 1").select("digest", "first")
    found = keys.where(F.col("n") >= least).join(cut(groups), "digest").where("path <> first.path OR at <> first.at")
    return found.groupBy("path").agg(F.collect_list(F.struct("at", F.col("first.path").alias("path"), F.col("first.at").alias("first_at"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("again"))


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """Header lines and block; the two line ends behind it come from the writer."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None]
    return "\r\n".join(["WARC/1.0", *lines]).encode() + END.encode() + block


def converted(name: str, record: ArcRecord, at: int, origin: dict | None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of ``origin``."""
    head, payload = record.http
    common = [
        ("WARC-Record-ID", record_id(name, at)), ("WARC-Date", w3c(record.date)), ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("Content-Type", "application/http; msgtype=response" if head else record.content_type),
    ]
    if origin is None:
        return warc_record([("WARC-Type", "response" if head else "resource"), *common], head + END.encode() + payload if head else payload)
    refers = [("WARC-Refers-To", record_id(origin["path"], origin["first_at"])), ("WARC-Refers-To-Target-URI", origin["url"]), ("WARC-Refers-To-Date", origin["date"]), ("WARC-Profile", PROFILE)]
    return warc_record([("WARC-Type", "revisit"), *common, *refers], head + END.encode())


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Write WARC files below ``warc`` for the ARC files below ``arc``."""
    files = listed(spark, arc)
    again = cut(revisits(cut(payload_keys(files))))
    jobs = files.join(again, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, repeated in zip(batch.column("path").to_pylist(), batch.column("again").to_pylist()):
                origins, size = {r["at"]: r for r in repeated or ()}, 0
                held = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", w3c(CAPTURED)), ("Content-Type", "application/warc-fields")], b"software: weft\r\nformat: WARC File Format 1.0\r\n")]
                with opened(name) as stream:
                    for at, record in enumerate(arc_records(stream)):
                        held.append(converted(name, record, at, origins.get(at)))
                        size += len(held[-1])
                        if size >= BATCH:
                            yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.binary())})
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.binary())})

    write_text(jobs.mapInArrow(run, "record binary").select(F.col("record").cast("string")), warc, END)


def warc_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(header lines, block) of each record."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        head = b"".join(lines)
        block = stream.read(int(header(head, "Content-Length")))
        if stream.read(4) != END.encode():
            raise ValueError("record without its end")
        yield head, block


READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_id", pa.string())])


def read_record(head: bytes, block: bytes) -> tuple | None:
    """A row of ``READ``; None for records about the file. A response whose payload isn't its digest's is an error."""
    kind, digest = header(head, "WARC-Type"), (header(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
    if kind == "warcinfo":
        return None
    http, payload = ArcRecord("", "", "", "", block).http
    n = len(payload)
    if kind == "revisit":
        n = number(header(http, "Content-Length"))
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload differs from its digest")
    return header(head, "WARC-Record-ID"), number(header(http, "X-Page-Id")), n, digest, kind, header(head, "WARC-Refers-To")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as stream:
                    rows = [row for head, block in warc_records(stream) if (row := read_record(head, block))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)

    rows = cut(listed(spark, path).mapInArrow(run, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string"))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = rows.where("record_type <> 'revisit'")
    named = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(named, "refers_id", "left").select(*shown, "refers_to")
    return responses.select(*shown, F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as legacy archives, convert them and read the WARC files back (see ``read_warc``).

    One row per page; NULL texts are empty payloads; rows without an id are never chosen before rows with one;
    rows that repeat a page are records of their own (a revisit may then name its own page id). An
    empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    base = scratch_path(spark, "archives")
    write_arc(pages, f"{base}/arc", id_col, url_col, html_col)
    convert(spark, f"{base}/arc", f"{base}/warc")
    return read_warc(spark, f"{base}/warc")
