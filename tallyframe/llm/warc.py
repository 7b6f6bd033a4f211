"""WARC archives with revisit records.

Writing.  Payload digests are shuffled as headers only; among records with equal
payloads that with the largest id becomes the ``response`` and the others
``revisit`` it.  Archives are written by Spark's own text writer, so tasks may be
lost and run again, and any store that Spark writes to will do: a record's bytes
are rows, and the line feed after a row is a record's last byte.  Tasks pack
records into rows of at most ``FILE_BYTES``, and the writer gives each row a file
of its own: only a record that is larger by itself makes a larger file.

Reading.  Archives are read as whole files, cut into records by their
Content-Length (payloads may hold anything, also WARC headers), digested anew, and
revisit records are joined to the original responses on the payload digest, again
with headers only.

Defined results: a null payload is the empty one; a null url is written empty
and line breaks in urls are left out; rows that repeat the winning id of a
payload are all responses; a null id is written as ``-`` and read as null, it
never wins against a number; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, shared_dir

#: Most bytes of an archive file that holds several records; a reading task holds a few files.
FILE_BYTES = 16 << 20

# Fixed value: the profile of WARC 1.1 for revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits at a time through base 32 and its digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(key), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, sha, winner, winner_url) of the records that become revisits.

    ``pages`` has id, url, payload, sha and size.  Only headers are shuffled; a
    payload that a third of all records share meets in a partial maximum and in
    a join that AQE may split.
    """
    heads = pages.where(F.col("size") >= min_bytes).select("id", "url", "sha")
    best = heads.groupBy("sha").agg(F.max("id").alias("winner"), F.max_by("url", "id").alias("winner_url"), F.count("*").alias("c")).where("c > 1 and winner is not null").drop("c")
    return heads.select("id", "sha").join(best, "sha").where("id is null or id <> winner").dropDuplicates(["id", "sha"])


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write one WARC record per row under ``path``, payloads once each."""
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    given = given.withColumn("sha", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    revisits = resolve(given, min_bytes)
    revisits = revisits.withColumnRenamed("sha", "rsha").withColumnRenamed("id", "rid")
    rows = given.join(broadcast_if_small(revisits, revisits.count(), 100_000), F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")

    again = F.col("winner").isNotNull()
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), "\r\n", "")
    key = lambda c: F.concat_ws("-", F.coalesce(c.cast("string"), F.lit("-")), F.col("sha"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(key(F.col("id")))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("X-Page-Id", F.coalesce(F.col("id").cast("string"), F.lit("-"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(key(F.col("winner")))), line("WARC-Refers-To-Target-URI", clean(F.col("winner_url"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),
    )
    packed = rows.select(record.alias("value")).mapInArrow(_pack(FILE_BYTES), "value string")
    packed.write.option("maxRecordsPerFile", 1).text(path)


def _pack(most: int):
    """Records joined by line feeds to rows of at most ``most`` bytes, as they come."""

    def row(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary()).cast(pa.string())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                data = record.as_buffer()
                if held and size + len(data) + 1 > most:
                    yield row(held)
                    held, size = [], 0
                held.append(data.to_pybytes())
                size += len(data) + 1
        if held:
            yield row(held)

    return run


def records(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of an archive."""
    view, raw, at = memoryview(content), bytes(content), 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        start = head_end + 4
        end = start + int(head["content-length"])
        yield head, view[start:end]
        at = end + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: dict[str, list] = {k: [] for k in ("id", "record_id", "kind", "url", "digest", "size", "refers")}
            for head, block in records(content.as_buffer()):
                kind = head["warc-type"]
                digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:"), None
                if kind == "response":
                    body = bytes(block)
                    payload = body[body.index(b"\r\n\r\n") + 4 :]
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                page = head.get("x-page-id", "-")
                for k, v in zip(rows, (None if page == "-" else int(page), head["warc-record-id"], kind, head.get("warc-target-uri"), digest, size, head.get("warc-refers-to")), strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("id", "size") else pa.string()) for k, v in rows.items()], names=list(rows))


def read_archives(spark: SparkSession, path: str, *, id_col: str = "page_id") -> DataFrame:
    """One row per record, revisits resolved to their original responses.

    Returns the id, ``payload_bytes``, ``payload_digest`` (both of the full
    payload, taken from the response that holds it), ``record_type`` and
    ``refers_to`` (the response's id for revisits).
    """
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, "id long, record_id string, kind string, url string, digest string, size long, refers string")
    found = materialize(found, "records")  # archives are cut and digested once
    first = found.where("kind = 'response'").groupBy(F.col("digest").alias("d")).agg(F.max(F.struct("id", "size")).alias("r"))
    joined = found.where("kind = 'revisit'").join(first, F.col("digest") == F.col("d"), "left")
    out = found.where("kind = 'response'").select(F.col("id"), "size", "digest", "kind", F.lit(None).cast("long").alias("refers_to"))
    out = out.unionByName(joined.select("id", F.col("r.size").alias("size"), "digest", "kind", F.col("r.id").alias("refers_to")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write the pages as deduplicated archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(spark, path)
