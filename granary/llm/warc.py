"""A content-addressed WARC archive: payloads once by verified digest, exact record headers apart, records back by joins.

An archive is two tables under one folder:

* ``payloads``: a row per distinct payload, keyed by the SHA-256 of its bytes,
  with its length and SHA-1; stored once however many records carry it.
* ``headers``: a row per record, with the exact bytes of its WARC header, the
  digest of its payload and the exact url. In the header, control characters of
  the url are percent-encoded, so that no url can end its line.

Of the records with equal payloads the one with the smallest id is the
``response``; the others are ``revisit`` records that refer to it (identical
payload digest). Payloads shorter than ``least_bytes`` are all responses.

Reading joins headers to payloads by digest, so a lost payload is an error and
never a silent gap, and hashes each payload again: bytes that do not give the
digest under which they are stored raise an error.

Record ids follow from page id, url, payload and, for rows equal in all three,
their number; a revisit refers to the record id of the response with the
smallest (page id, url).

Edge cases: a null payload is an empty one; records with equal ids and payloads
are each kept, and are responses together if their id is the smallest; a record
without id is never referred to, and is a response if none of its group has an
id; null urls give an empty target; an empty table gives empty tables; other
columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import save, scratch_path, table

LEAST_BYTES = 0
#: Fixed value: the alphabet of base32 as RFC 4648 has it.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the profile of a record whose payload is that of an earlier one.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits at a time give four letters."""
    digest = F.sha1(data)
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def _uuid(*of: Column) -> Column:
    """A record's identifier, from what tells it from all others."""
    h = F.md5(F.concat_ws("\x1f", F.lit("record"), *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in of]).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_safe(url: Column) -> Column:
    """The url with its control characters percent-encoded."""
    control = r"[\x00-\x1F\x7F]"
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(control), F.array_join(each, "")).otherwise(url)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write both tables under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    keyed = rows.select("*", F.sha2("payload", 256).alias("sha256"))
    stored = keyed.groupBy("sha256").agg(F.first("payload").alias("payload"))
    save(stored.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "payload"), f"{path}/payloads")

    # Equal rows meet as a count and part again as numbered copies.
    small = keyed.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    records = small.groupBy(*small.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    first = small.where("page_id is not null").groupBy("sha256").agg(F.min(F.struct("page_id", "url")).alias("first"))
    typed = records.join(first, "sha256", "left").withColumn("first_id", F.col("first.page_id"))
    typed = typed.withColumn("revisits", F.coalesce((F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)))
    kind = F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))
    referred = _uuid(F.col("first_id"), F.col("first.url"), F.col("sha256"), F.lit(0))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", header_safe(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("revisits"), F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", referred), _line("X-Refers-To-Page", F.col("first_id").cast("string")))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), _line("X-Page", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        _line("X-Payload-SHA256", F.col("sha256")),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(F.col("revisits"), F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    save(typed.select("sha256", header.cast("binary").alias("header"), "url"), f"{path}/headers")


_FIELDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target", pa.string()), ("digest", pa.string()), ("sha256", pa.string()), ("header", pa.binary())])


def parse_header(header: bytes) -> dict[str, str]:
    """The named fields of a WARC header, the first of each name; raises ValueError for other bytes."""
    if not header.startswith(b"WARC/1.1\r\n") or not header.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC header")
    fields: dict[str, str] = {}
    for line in header.decode().split(CRLF)[1:-2]:
        name, colon, value = line.partition(": ")
        if not colon:
            raise ValueError("a line of a WARC header has no name")
        fields.setdefault(name, value)
    return fields


def _parsed(headers: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = parse_header(raw)
                to, page = f.get("X-Refers-To-Page"), f.get("X-Page")
                rows.append((page and int(page), f["WARC-Type"], to and int(to), url, f["WARC-Payload-Digest"].removeprefix("sha1:"), f["X-Payload-SHA256"], raw))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, _FIELDS, strict=True)], schema=_FIELDS)

    return headers.select("header", "url").mapInArrow(read, "page_id long, record_type string, refers_to long, target string, digest string, sha256 string, header binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, record_type, refers_to, target (the exact url), header and full payload, with its length and digest.

    Every payload is hashed again where it is read; a wrong one raises an error.
    """
    payloads = spark.read.schema("sha256 string, payload_bytes long, payload_digest string, payload binary").parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = payloads.select("sha256", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload"))
    records = _parsed(spark.read.schema("sha256 string, header binary, url string").parquet(f"{path}/headers"))
    joined = records.join(checked.withColumn("found", F.lit(True)), "sha256", "left")
    whole = F.when(F.col("found"), F.col("payload")).otherwise(F.raise_error(F.lit("a record's payload is missing from the archive")))
    return joined.select("page_id", "record_type", "refers_to", "target", "digest", "header", whole.alias("payload"))


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """The archive as WARC text files under ``out``: each record's header, its block if it is a response, two line ends. For payloads in UTF-8."""
    block = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise(F.lit(""))
    read_archive(spark, path).select(F.concat(F.col("header").cast("string"), block).alias("value")).write.option("lineSep", CRLF + CRLF).text(out)


def op3_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, html, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('{BASE32}',
         CAST(((CAST(concat('0x', substr(hex, (k // 4) * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
