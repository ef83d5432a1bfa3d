"""Content-addressed WARC archive: payload bytes once, record headers apart, records rebuilt by joins.

``write_archive`` leaves two tables in one folder.  ``payloads`` holds every distinct payload once,
under its SHA-256, SHA-1 and length.  ``headers`` holds one row per record: the exact bytes in front
of the payload (WARC header and HTTP header) and the key of the payload.  ``read_records`` joins
them again, takes the digests of the stored bytes anew and fails on any difference.
``write_files`` lays the rebuilt records out as gzipped WARC files, ``read_files`` parses such files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch

#: Two payloads are one only if they agree in all three.
KEY = ["sha256", "sha1", "bytes"]
#: Fixed values of the WARC 1.1 format and of RFC 4648.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # the digits of conv(..., 32)
_END = "\r\n"


def base32(hex40: Column) -> Column:
    """The base32 form of 40 hexadecimal digits: 10 digits make 8."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _CONV32, BASE32)


def _named(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row, F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*[part for name, value in fields for part in (F.lit(f"{name}: "), value, F.lit(_END))])


def with_headers(records: DataFrame, date: str) -> DataFrame:
    """Add ``header``: the bytes of every record in front of its payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}"), _lines(
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes").cast("string"))), F.lit(_END))
    own, revisit = _named(F.col("page_id"), F.col("row")), F.col("record_type") == "revisit"
    # control characters and blanks would end a header line early
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), "row")), r"[\x00-\x20\x7F]", "%20")
    block = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))
    told = records.withColumn("http", http)
    header = F.concat(
        F.lit(f"{VERSION}{_END}"),
        _lines(("WARC-Type", F.col("record_type")), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)),
               ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("sha1"))))),
        F.when(revisit, _lines(
            ("WARC-Refers-To", _named(F.col("lead.page_id"), F.col("lead.row"))),
            ("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _lines(("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", block.cast("string"))),
        F.lit(_END), F.col("http"))
    return told.withColumn("header", header.cast("binary"))


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", scratch: Scratch | None = None,
) -> None:
    """One record per row of ``pages`` into ``folder``: tables ``headers`` and ``payloads``.

    Of the records with equal payloads of ``min_bytes`` or more, the one with the largest id is the
    response (of repeated ids the first row; a null id loses against any other) and the others
    revisit it; smaller payloads are all responses, and their bytes too are stored once.  A
    null body counts as empty.  A missing URL becomes ``urn:page:<row>``; blanks and control
    characters in one are written ``%20``.  Other columns are not read, whatever their names; an
    empty table gives an empty archive.

    Only digests are shuffled to elect responses.  Bodies meet once, on their digest, after
    each task has dropped its own copies, so a payload of a third of all rows arrives once a task.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    body = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = body.select(
        "*", F.unhex(F.sha2("payload", 256)).alias("sha256"), F.unhex(F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"))
    keyed.groupBy(*KEY).agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    rows = scratch.keep(keyed.select(
        F.monotonically_increasing_id().cast("string").alias("row"), F.monotonically_increasing_id().alias("place"),
        "page_id", "url", *KEY), "rows")
    best = F.max(F.struct(F.col("page_id").isNotNull(), "page_id", (-F.col("place")).alias("back"), "row"))
    leads = rows.filter(F.col("bytes") >= min_bytes).groupBy(*KEY).agg(best.alias("lead"), F.count("*").alias("n"))
    shared = scratch.keep(leads.filter("n > 1").drop("n"), "leads")
    # only payloads that occur again are looked up; the join may split a key of very many records
    told = rows.join(shared, KEY, "left").withColumn("record_type", F.when(
        F.col("lead").isNotNull() & (F.col("lead.row") != F.col("row")), "revisit").otherwise("response"))
    with_headers(told, date).select("row", *KEY, "header").write.parquet(f"{folder}/headers")


def _verified(payloads: DataFrame) -> DataFrame:
    """Stored payloads whose bytes still have the digests they are stored under."""
    same = (
        (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.unhex(F.sha1("payload")) == F.col("sha1"))
        & (F.octet_length("payload") == F.col("bytes")))
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("sha256")))
    return payloads.withColumn("payload", F.when(same, F.col("payload")).otherwise(wrong.cast("binary")))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: fields of the header, ``header`` and the full ``payload``, revisits too."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    return with_fields(headers.join(_verified(payloads), KEY).select("header", "payload"))


def with_fields(records: DataFrame) -> DataFrame:
    """Parse ``header``: page_id, record_type, refers_to, uri, payload_digest, with header and payload."""
    head = F.split(F.col("header").cast("string"), "\r\n\r\n", 2)[0]

    def field(name: str, pattern: str = ".*") -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?im)^{re.escape(name)}: *({pattern})\r?$", 1), F.lit(""))

    def page(name: str) -> Column:
        return F.regexp_extract(F.coalesce(field(name), F.lit("")), r"<urn:page:(-?\d+):\d+>", 1).try_cast("long")

    return records.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("uri"),
        field("WARC-Payload-Digest", r"(?:sha1:)?[A-Z2-7]+").alias("payload_digest"), "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """Add ``record``: the exact bytes of each record; a revisit carries no payload."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat("header", block, F.lit(f"{_END}{_END}".encode())))


def page_report(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to")


def warc_report(pages: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """Write ``pages`` as an archive, read it back and report every record."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archive"
    write_archive(pages, folder, scratch=scratch, **options)
    return page_report(read_records(pages.sparkSession, folder))


def write_files(records: DataFrame, path: str, file_bytes: int = 32 << 20) -> None:
    """Write records as ``.txt.gz`` files of WARC records, each of about ``file_bytes`` before compression.

    Payloads have to be text in UTF-8, as those from a string column are.
    """
    laid = record_bytes(records).select("record")
    total = laid.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # the writer adds the line feed that ends a record
    line = F.expr("substring(record, 1, octet_length(record) - 1)").cast("string").alias("value")
    laid.repartition(files).select(line).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _inflated(data: bytes) -> bytes:
    """All gzip members of a file, one after the other; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of every record; HTTP headers count to the header."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        ends = data.index(b"\r\n\r\n", at) + 4
        length = int(re.search(rb"(?im)^content-length: *(\d+)", data[at:ends])[1])
        block, http = ends, re.search(rb"(?im)^content-type: *application/http", data[at:ends])
        if http and (cut := data.find(b"\r\n\r\n", ends, ends + length)) >= 0:
            block = cut + 4
        yield data[at:block], data[block:ends + length]
        at = ends + length


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped; a task holds one file at a time.  Revisits have an empty payload."""
    schema = pa.schema([("header", pa.binary()), ("payload", pa.binary())])

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parsed(_inflated(content.as_py())))
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[j] for r in rows[k:k + 1000]], pa.binary()) for j in (0, 1)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return with_fields(files.mapInArrow(parse, "header binary, payload binary"))
