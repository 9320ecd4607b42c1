"""A content-addressed archive of WARC records: payloads once by digest, exact record headers apart."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import pieces, prepare, shared_dir

#: Fixed values of the format (ISO 28500).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
RECORDS, PAYLOADS = "page_id long, sha256 string, response boolean, header binary", "sha256 string, payload binary"
#: How many buckets an archive's payloads are in.
LAYOUT = "buckets int"
#: Repetitions of one row that are numbered in one array.
RUN = 100_000


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def header_of(page_id, url, sha1: str, size: int, refers_to, refers_url, occurrence: int, response: bool, date: str) -> bytes:
    """The exact header block of one record, its closing empty line included. A revisit has no block of its own."""
    lines = [
        VERSION,
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id, url, sha1, occurrence)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {'' if url is None else url}".replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if not response:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(refers_to, refers_url, sha1, 1)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}", f"Content-Length: {size if response else 0}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def fields_of(header: bytes) -> dict[str, str]:
    first, *lines = header.decode().removesuffix("\r\n\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC header: {first[:40]!r}")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The payloads under path in their buckets, in any session: named in its catalog while the plan is made, and no longer."""
    name, place = f"warc_payloads_{uuid.uuid4().hex}", f"{path}/payloads".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (sha256 STRING, payload BINARY) USING parquet CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.read.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record for each row of pages (page_id, url, html), and return the archive's folder.

    `payloads` holds each payload once, under its SHA-256, in UTF-8, in buckets of that digest, so that records find their
    payloads without moving these again; `records` holds each record's exact header. Of records whose payloads are equal
    and of at least least_bytes, the one with the smallest page_id (then url) is the response and the others revisit it; the
    rest are responses. Defined cases: a null html is an empty payload; a null page_id or url comes after all others; of
    repeated rows one is the response; rows of one page_id that differ in url are records of their own; a payload of any
    length, up to the 2 GB of a value, is one record; an empty table gives an empty archive; other columns are not archived.
    """
    spark = pages.sparkSession
    prepare(spark)
    path = path or os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    # digests and keys travel without the payloads
    copies = keyed.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("payload_bytes")).groupBy("page_id", "url", "sha256", "sha1", "payload_bytes").agg(F.count("*").alias("n"))
    place = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"))
    owners = copies.groupBy("sha256").agg(F.min(place).alias("o")).select(F.col("sha256").alias("_of"), F.col("o.page_id").alias("owner"), F.col("o.url").alias("owner_url"))
    runs = copies.join(owners, copies["sha256"] == owners["_of"]).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    each = runs.withColumn("occurrence", F.explode(F.sequence(F.col("run") * RUN + 1, F.least("n", (F.col("run") + 1) * RUN))))
    first = F.col("page_id").eqNullSafe(F.col("owner")) & F.col("url").eqNullSafe(F.col("owner_url")) & (F.col("occurrence") == 1)
    each = each.select("page_id", "url", "sha256", "sha1", "payload_bytes", "owner", "owner_url", "occurrence", (first | (F.col("payload_bytes") < least_bytes)).alias("response"))

    def headers(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                out.append(header_of(r["page_id"], r["url"], sha1, r["payload_bytes"], r["owner"], r["owner_url"], r["occurrence"], r["response"], date))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "sha256", "response")), pa.array(out, pa.binary())], ["page_id", "sha256", "response", "header"])

    each.mapInArrow(headers, RECORDS).write.parquet(f"{path}/records")
    # payloads of one digest are equal: a map-side merge leaves one of them for each task, and one shuffle one of all
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = keyed.groupBy("sha256").agg(F.any_value("payload").alias("payload"))
    name = f"warc_payloads_{uuid.uuid4().hex}"
    once.write.bucketBy(buckets, "sha256").sortBy("sha256").option("path", f"{path}/payloads").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.createDataFrame([(buckets,)], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    return path


def read_archive(spark: SparkSession, path: str, bodies: bool | str = False) -> DataFrame:
    """Read the records back: headers parsed, each payload joined by its digest and both digests verified over its bytes.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to; with bodies also record (the original record's
    exact bytes) and payload. bodies="records" gives the payload only where the record holds it (responses), so that no
    payload is multiplied; bodies=True gives it to revisits too. A payload whose bytes do not have the digest it is stored
    under, or not the digest and length that a header names, fails the job; so does a header without payload.

    Responses meet their payloads in the buckets that the archive was written in, whichever session reads it. Revisits, of
    which one payload can have any number, meet digests only, in a shuffle whose large partitions can be split. Nothing
    stays in the catalog. Defined cases are those of write_archive; an empty archive gives no records.
    """
    prepare(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["record", "payload"] if bodies else [])
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", record binary, payload binary" if bodies else "")
    records = spark.read.schema(RECORDS).parquet(f"{path}/records")

    def joined(some: DataFrame, payloads: DataFrame, whole: bool) -> DataFrame:
        sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256")))
        held = payloads.select(F.col("sha256").alias("_of"), sound.alias("_sha1"), F.length("payload").cast("long").alias("_bytes"), (F.col("payload") if whole else F.lit(None).cast("binary")).alias("payload"))
        return some.join(held, some["sha256"] == held["_of"], "left").drop("_of")

    def parse(batches):
        for batch in batches:
            for piece in pieces(batch, "payload"):
                rows = []
                for r in piece.to_pylist():
                    f = fields_of(r["header"])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r["_sha1"] is None or base64.b32encode(bytes.fromhex(r["_sha1"])).decode() != digest or r["_bytes"] != int(f["X-Payload-Length"]):
                        raise ValueError(f"record {f['WARC-Record-ID']} does not match its payload")
                    kind, refers = f["WARC-Type"], f.get("X-Refers-To-Page")
                    row = [int(f["X-Page"]) if f["X-Page"] else None, r["_bytes"], digest, kind, int(refers) if refers not in (None, "None") else None]
                    rows.append([*row, r["header"] + (r["payload"] if kind == "response" else b"") + RECORD_END, r["payload"]] if bodies else row)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds[i]) for i in range(len(names))], names)

    files = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    if not bodies:
        return joined(records, files, False).mapInArrow(parse, schema)
    (layout,) = spark.read.schema(LAYOUT).parquet(f"{path}/layout").collect()
    buckets = _bucketed(spark, path, layout["buckets"])
    responses = joined(records.filter("response"), buckets, True).mapInArrow(parse, schema)
    return responses.unionByName(joined(records.filter("NOT response"), files, bodies is True).mapInArrow(parse, schema))


def parse_stream(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records of one run of WARC bytes, as (fields, block); for archives that other tools wrote or will read."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = fields_of(data[at:end])
        size = int(fields["Content-Length"])
        out.append((fields, data[end : end + size]))
        at = end + size + len(RECORD_END)
    return out


def rebuilt(records: DataFrame) -> DataFrame:
    """What rebuilt records (record, and payload_bytes and payload_digest of the payload that a revisit means) say of
    themselves: page_id, payload_bytes, payload_digest, record_type, refers_to. A response is measured by its own block.
    Defined cases: repeated records give a row each, an empty page is a null page_id, records of any length pass in batches of a
    few, an empty table gives an empty result, and other columns are left out."""

    def each(batches):
        for batch in batches:
            for piece in pieces(batch, "record"):
                rows = []
                for r in piece.to_pylist():
                    ((f, block),) = parse_stream(r["record"])
                    response, refers = f["WARC-Type"] == "response", f.get("X-Refers-To-Page")
                    size, digest = (len(block), digest_of(block)) if response else (r["payload_bytes"], r["payload_digest"])
                    rows.append((int(f["X-Page"]) if f["X-Page"] else None, size, digest, f["WARC-Type"], int(refers) if refers not in (None, "None") else None))
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    prepare(records.sparkSession)
    return records.select("record", "payload_bytes", "payload_digest").mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
