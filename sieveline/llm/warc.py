"""Web archives: pages to WARC records and back, large payloads as rows of record identifier and chunk number.

*Writing.* Every page is a record. Payloads are cut by bytes into chunks of ``chunk_bytes``: a record is its first chunk, each further
one a ``continuation`` record with the identifier of the first and its own number (WARC 1.1 segmentation). So the row that is written, the
row that is read and the memory for either are bounded by the chunk, not by the record. Equal payloads of at least ``min_bytes`` are
found by digest: the page with the largest id is the response, the others are ``revisit`` records without payload. All of it
is DataFrame functions and Spark's text writer; a payload is shuffled only if the table of repeated digests is too large for
Spark to broadcast, and then once.

*Reading.* All records of an archive name its warcinfo record in their first line after the version. These two lines, with a random
identifier, part the records for Spark's text reader, so that files are read in parallel splits whatever the payloads hold. Rows meet
by record identifier, ordered by chunk number, and a digest is carried along from chunk to chunk; no task ever holds a record. It must
equal the digest that the record states, and so must its length, or the job fails. Records of one chunk are checked where they
are read and send only their facts.

Null payloads are empty. Null ids are never the response of a payload that a page with an id has, too; of rows that share the
largest id each is a response. Rows are kept as they are, repeated ids too. Identifiers of records are new in every archive.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import keep_table, scratch_path, ship_package

CHUNK_BYTES = 1 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """A folder of WARC files that share one warcinfo record."""

    path: str
    name: str

    @property
    def opening(self) -> str:
        """How every record starts."""
        return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{self.name}>\r\n"


def line(name: str, value: Column | str) -> Column:
    """One header line; nothing if the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def as_urn(digest: Column) -> Column:
    """32 hexadecimal digits as an identifier."""
    return F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def marked_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (id, uri, payload) with size, digest, and the id that a repeated payload refers to."""
    pages = pages.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    repeated = pages.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("times"))
    repeated = keep_table(repeated.filter("times > 1 AND original IS NOT NULL").select("digest", "original"), "warc-repeated")  # its size is known before the join
    marked = pages.join(repeated, "digest", "left")
    return marked.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")))


def write_archive(
    df: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 1000, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url"
) -> Archive:
    """Write one record per row into WARC files under ``path`` and return the archive."""
    spark = df.sparkSession
    archive = Archive(path, str(uuid.uuid4()))
    uri = F.regexp_replace(F.col(uri_col).cast("string"), r"[\r\n]", "") if uri_col else F.lit(None).cast("string")
    pages = df.select(F.col(id_col).cast("long").alias("id"), uri.alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    marked = marked_pages(pages, min_bytes).withColumn("key", F.monotonically_increasing_id())
    revisit = F.col("refers_to").isNotNull()
    chunks = F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(chunk_bytes)))).cast("long")
    rows = marked.withColumn("chunks", chunks)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunks"))).alias("chunk"))
    first, cut = F.col("chunk") == 1, F.col("chunks") > 1

    def record_id(chunk: Column) -> Column:
        return as_urn(F.md5(F.concat_ws("/", F.lit(archive.name), F.col("key"), chunk).cast("binary")))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END),
    ).cast("binary")
    nothing = F.lit(b"")
    part = F.substring(F.col("payload").cast("binary"), ((F.col("chunk") - 1) * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    block = F.concat(F.when(first, http).otherwise(nothing), F.when(revisit, nothing).otherwise(part))
    rows = rows.withColumn("block", block)
    total = F.octet_length(http) + F.col("size")
    head = F.concat(
        F.lit(archive.opening),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("chunk"))), line("WARC-Date", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        line("WARC-Target-URI", F.col("uri")), line("X-Row-ID", F.col("id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("size")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("X-Refers-To-Row-ID", F.col("refers_to")),
        line("WARC-Segment-Number", F.when(cut, F.col("chunk"))), line("WARC-Segment-Origin-ID", F.when(~first, record_id(F.lit(1)))),
        line("WARC-Segment-Total-Length", F.when(cut & (F.col("chunk") == F.col("chunks")), total)),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        line("Content-Type", "application/http;msgtype=response"), line("Content-Length", F.octet_length("block")), F.lit("\r\n"),
    )
    records = rows.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    fields = "software: sieveline\r\nformat: WARC File Format 1.1\r\n"
    own = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{archive.name}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n{fields}"
    first_of_all = spark.createDataFrame([(own,)], "value string").coalesce(1)  # stands before every opening, in a file of its own or at the head of one
    first_of_all.union(records).write.option("lineSep", END).text(path)
    return archive


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a record without its opening; None for what stands before the first record."""
    head, gap, rest = raw.partition(END.encode())
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
    if "Content-Length" not in fields or fields.get("WARC-Type", "warcinfo") == "warcinfo":
        return None
    size = int(fields["Content-Length"])
    if rest[size:] != END.encode():
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is {len(rest) - len(END)} bytes long and states {size}")
    return fields, rest[:size]


CHUNKS = "record string, chunk long, id long, type string, uri string, refers_to long, size long, digest string, found_size long, found_digest string, data binary"


def read_chunks(spark: SparkSession, archive: Archive) -> DataFrame:
    """The chunked record table: `CHUNKS`, one row per record of the files.

    Records of one chunk have ``found_size`` and ``found_digest`` of their payload; chunks of larger ones carry ``data``.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("value"):
                found = parse(raw.as_py())
                if found is None:
                    continue
                fields, block = found
                number, origin = fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Origin-ID")
                data = block if origin else block.partition(END.encode())[2]
                whole = number is None and fields["WARC-Type"] != "revisit"
                long = {k: int(fields[k]) if k in fields else None for k in ("X-Row-ID", "X-Refers-To-Row-ID", "X-Payload-Length")}
                out.append((
                    origin or fields["WARC-Record-ID"], int(number or 1), long["X-Row-ID"], None if origin else fields["WARC-Type"], fields.get("WARC-Target-URI"), long["X-Refers-To-Row-ID"],
                    long["X-Payload-Length"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                    len(data) if whole else None, hashlib.sha1(data).hexdigest() if whole else None, data if number else None,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_ARROW), _ARROW.values())], list(_ARROW))

    lines = spark.read.option("lineSep", archive.opening).text(archive.path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


_ARROW = {
    "record": pa.string(), "chunk": pa.int64(), "id": pa.int64(), "type": pa.string(), "uri": pa.string(), "refers_to": pa.int64(),
    "size": pa.int64(), "digest": pa.string(), "found_size": pa.int64(), "found_digest": pa.string(), "data": pa.binary(),
}


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``record, id, type, uri, refers_to, payload_bytes, payload_digest, chunks`` of every record, digests and sizes checked."""
    chunks = read_chunks(spark, archive).repartition("record").sortWithinPartitions("record", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, hashed, size, count = None, None, 0, 0

        def finished() -> tuple:
            if hashed is not None:
                row["found_size"], row["found_digest"] = size, hashed.hexdigest()
            if row["type"] != "revisit" and (row["found_size"], row["found_digest"]) != (row["size"], row["digest"]):
                raise ValueError(f"record {row['record']} does not have the payload that it states")
            return row["record"], row["id"], row["type"], row["uri"], row["refers_to"], row["size"], row["digest"], count

        for batch in batches:
            out = []
            for new in batch.to_pylist():
                data = new.pop("data")
                if row is None or new["record"] != row["record"]:
                    if row is not None:
                        out.append(finished())
                    row, hashed, size, count = new, None if data is None else hashlib.sha1(), 0, 0
                count += 1
                if new["chunk"] != count:
                    raise ValueError(f"record {row['record']} lacks its chunk {count}")
                if data is not None:
                    hashed.update(data)
                    size += len(data)
            yield made(out)
        yield made([finished()] if row is not None else [])

    names = ["record", "id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", "chunks"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return chunks.mapInArrow(run, "record string, id long, type string, uri string, refers_to long, payload_bytes long, payload_digest string, chunks long")


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """``id, chunk, data``: payloads as rows of bounded size, those of revisits left out."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for f in (parse(raw.as_py()) for raw in batch.column("value")) if f and f[0]["WARC-Type"] != "revisit"]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([int(f["X-Row-ID"]) if "X-Row-ID" in f else None for f, _ in found], pa.int64()),
                "chunk": pa.array([int(f.get("WARC-Segment-Number", 1)) for f, _ in found], pa.int64()),
                "data": pa.array([b if "WARC-Segment-Origin-ID" in f else b.partition(END.encode())[2] for f, b in found], pa.binary()),
            })

    lines = spark.read.option("lineSep", archive.opening).text(archive.path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, "id long, chunk long, data binary")


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` into a new archive under the shared folder, read it back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    archive = write_archive(pages, scratch_path(spark, "warc"), **options)
    records = read_records(spark, archive)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
