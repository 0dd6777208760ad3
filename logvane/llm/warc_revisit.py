"""WARC archives without repeated payloads: write, read, and resolve revisits.

Headers alone are shuffled by payload digest. Of the records that share a
payload of a certain size, the one with the largest key stays a response; the
others become revisit records that refer to it and carry no payload. Archives
are gzip-compressed files of a bounded number of records and bytes, written by
Spark and read back by the ``Content-Length`` of each record, so a payload may hold
anything, record separators included.

Defined cases: a null payload counts as empty. Payloads below the least size
are always responses. Rows that repeat both key and payload are records of
their own and all of one type. A null key is smaller than any other. Line
breaks in a URI are written as ``%0A``; a null URI or key has no header line.
Empty tables give no archives and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.llm.text import small_batches
from logvane.session import materialize, work_path

LEAST_BYTES = 1000
#: an archive holds at most so many records, and about so many bytes before compression
RECORDS_PER_FILE, BYTES_PER_FILE = 2_000, 512 << 20
#: archives are unpacked so many bytes at a time
PART_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _record_id(key: Column, digest: Column) -> Column:
    """A URN that depends on key and payload alone, so a repeated task writes the same record."""
    h = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), digest))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]))


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Revisits among ``key, digest, bytes``: ``key, digest`` with ``refers_to``, the key of the response.

    The largest key of a digest comes from partial maxima, so a payload on a
    third of all rows is reduced before it is shuffled.
    """
    large = headers.filter(F.col("bytes") >= least_bytes)
    responses = large.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a response is not a revisit of itself; null keys are below all others
    return large.join(responses, "digest").filter(~F.col("key").eqNullSafe(F.col("refers_to"))).select(
        "key", "digest", "refers_to"
    ).distinct()


def write_archives(df: DataFrame, key: str, uri: str, payload: str, date: str, path: str | None = None) -> str:
    """Write a record per row and return the folder."""
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    pages = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{uri}`").alias("uri"), body.alias("body"))
    pages = pages.select("*", F.sha1("body").alias("digest"), F.octet_length("body").cast("long").alias("bytes"))
    headers = materialize(pages.select("key", "digest", "bytes"), "warc_headers")
    revisits = materialize(resolve(headers), "warc_revisits").select(
        F.col("key").alias("r_key"), F.col("digest").alias("r_digest"), "refers_to"
    )
    records = pages.join(revisits, (F.col("digest") == F.col("r_digest")) & F.col("key").eqNullSafe(F.col("r_key")), "left")
    revisit = F.col("r_digest").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"),
                    F.lit(CRLF + CRLF))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    identifier = lambda k: F.concat(F.lit("<"), _record_id(k, F.col("digest")), F.lit(">"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", identifier(F.col("key"))), line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]+", "%0A")), optional("X-Record-Key", F.col("key").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", identifier(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF), http, F.when(revisit, "").otherwise(F.col("body").cast("string")),
    )
    path = path or work_path(spark, "warc")
    # payloads that a full file of their like could not hold are written apart, a few to a file
    usual = BYTES_PER_FILE // RECORDS_PER_FILE
    largest = headers.agg(F.max("bytes")).first()[0] or 0
    for some, most in [(F.col("bytes") <= usual, usual), (F.col("bytes") > usual, largest)]:
        if most <= usual or largest > usual:
            records.filter(some).select(record.alias("value")).write.mode("append").option("lineSep", CRLF + CRLF).option(
                "compression", "gzip"
            ).option("maxRecordsPerFile", min(RECORDS_PER_FILE, max(BYTES_PER_FILE // max(most, 1), 1))).text(path)
    return path


# ---- reading


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a part at a time."""
    while content:
        member = zlib.decompressobj(31)
        rest = content
        while rest and not member.eof:
            yield member.decompress(rest, PART_BYTES)
            rest = member.unconsumed_tail
        content = member.unused_data


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of every record of a gzip archive."""
    parts, data, at, done = _unpacked(content), bytearray(), 0, False

    def need(enough) -> bool:
        nonlocal done, at
        while not (found := enough()) and not done:
            part = next(parts, None)
            if part is None:
                done = True
            else:
                # what is read may end before the separator that ``at`` has already passed
                passed = min(at, len(data))
                del data[:passed]
                at -= passed
                data.extend(part)
        return bool(found)

    while need(lambda: data.find(b"\r\n\r\n", at) >= 0):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode()
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
        at = end + 4
        if "content-length" not in fields:
            raise ValueError(f"record without a length: {fields.get('warc-record-id')}")
        size = int(fields["content-length"])
        if not need(lambda: len(data) - at >= size):
            raise ValueError(f"the archive ends inside record {fields.get('warc-record-id')}")
        yield fields, bytes(data[at : at + size])
        at += size + 4


_RECORD = pa.schema([
    ("record_id", pa.string()), ("record_key", pa.string()), ("record_type", pa.string()), ("uri", pa.string()),
    ("header_digest", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()),
])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. Length and digest are taken from the payload read; a revisit has none."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse(content.as_py()):
                    payload = None
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                    rows.append({
                        "record_id": fields["warc-record-id"].strip("<>"), "record_key": fields.get("x-record-key"),
                        "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
                        "header_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                        "payload_bytes": None if payload is None else len(payload),
                        "payload_digest": None if payload is None else hashlib.sha1(payload).hexdigest(),
                        "payload": payload if payloads else None,
                    })
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    fields = ("record_id string, record_key string, record_type string, uri string, header_digest string, refers_to_id string, "
              "payload_bytes long, payload_digest string, payload binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, fields)


def with_originals(records: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload, for revisits those of the response they refer to."""
    kept = ["record_key", "record_type", "payload_bytes", "payload_digest"]
    responses = records.filter("record_type = 'response'").select(*kept, F.lit(None).cast("string").alias("refers_to"))
    originals = records.filter("record_type = 'response'").groupBy("record_id").agg(
        F.first("record_key").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"),
        F.first("payload_digest").alias("payload_digest"),
    )
    revisits = records.filter("record_type = 'revisit'").select("record_key", "record_type", F.col("refers_to_id").alias("record_id"))
    return responses.unionByName(revisits.join(originals, "record_id", "left").drop("record_id"))
