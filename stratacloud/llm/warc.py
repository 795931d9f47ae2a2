"""WARC archives as chunked record tables.

A payload is written as rows of at most `CHUNK_BYTES` bytes, (record id, chunk number), each
carrying the SHA-1 of the payload so far.  html is one value of a stored row, which Spark's scan
holds once; from there on the JVM cuts a row for each chunk and nothing holds a whole
record: the writer's state for a record is its running digest, and so is the reader's.
Which records are revisits is decided on digests and ids alone.  Every chunk becomes a segment of its WARC record (WARC 1.1 section 7: the
first keeps the record's type, later ones are continuations), segments end with CRLF CRLF,
and Spark's text writer, with that as its line separator, stores them in gzip files, which
it neither splits nor reorders.  The reader walks each file by Content-Length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._common import cut, hot_join, text_or_empty
from stratacloud.llm._text import frugal

CHUNK_BYTES = 1 << 20
#: Payloads below this size are stored each time; revisits of them would save nothing.
LEAST_SHARED_BYTES = 1000
BATCH_BYTES = 4 << 20
BROADCAST_GROUPS = 1 << 17
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

CHUNKS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, chunk binary, digest_so_far string, bytes_so_far long, is_last boolean"


def plan_records(pages: DataFrame, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads (SHA-1 and length) of at least `least` bytes that with the
    largest page_id is the response and the others revisit it.  Groups of equal payloads are counted
    on digests and ids and written; up to BROADCAST_GROUPS of them (about 70 bytes each) pages look theirs up where
    they are, beyond that in a join on the digest from which hot payloads are kept.  Null html counts as empty;
    rows without page_id are responses, or revisits if the
    group has an id; of rows repeating the response's id all are responses.
    """
    size = F.octet_length(text_or_empty("html")).cast("long")
    digest = F.sha1(text_or_empty("html").cast("binary"))
    signed = pages.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest")).where(F.col("payload_bytes") >= least)
    shared = signed.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    shared = cut(shared, "shared")
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"), size.alias("payload_bytes"), digest.alias("payload_digest"))
    keys = ["payload_digest", "payload_bytes"]
    if shared.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(shared), keys, "left")
    else:
        joined = hot_join(rows, shared, keys, "copies", pages.count(), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def cut_chunks(records: DataFrame, limit: int) -> DataFrame:
    """records with a row for each chunk: chunk_no from 0, chunks, and chunk instead of html.

    Chunks have at most `limit` bytes, at least 4, and end between UTF-8 characters; a record
    without payload has one empty chunk.  The rows of a record follow each other in their task.
    """
    if limit < 4:
        raise ValueError("cut_chunks: a chunk must hold any character")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / F.lit(limit - 3))).cast("int")
    one = records.withColumn("_payload", payload).withColumn("chunks", count).drop("html")
    numbered = one.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    within = lambda at: F.substring("_payload", at + 1, F.lit(1)).between(F.lit(bytes([0x80])), F.lit(bytes([0xBF])))

    def edge(number: Column) -> Column:
        """Byte at which a chunk begins: the first at or after its place that begins a character."""
        at = number * (limit - 3)
        return F.when(~within(at), at).when(~within(at + 1), at + 1).when(~within(at + 2), at + 2).otherwise(at + 3)

    begin = F.when(F.col("chunk_no") == 0, 0).otherwise(edge(F.col("chunk_no")))
    end = F.when(F.col("chunk_no") + 1 == F.col("chunks"), F.octet_length("_payload")).otherwise(edge(F.col("chunk_no") + 1))
    return numbered.withColumn("chunk", F.substring("_payload", begin + 1, end - begin)).drop("_payload")


def _line(value: str) -> str:
    """A header value: line breaks and percent signs percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    made = hashlib.md5(f"{page_id}\n{url}\n{digest}".encode()).hexdigest()
    return f"urn:uuid:{made[:8]}-{made[8:12]}-{made[12:16]}-{made[16:20]}-{made[20:]}"


def segment(row: dict, chunk: memoryview, so_far: str, done: int) -> str:
    """The WARC segment of a chunk without its closing CRLF CRLF; row has the other columns of cut_chunks()."""
    first, last = row["chunk_no"] == 0, row["chunk_no"] + 1 == row["chunks"]
    number, record = row["chunk_no"] + 1, record_id(row["page_id"], row["url"], row["payload_digest"])
    kind = row["record_type"] if first else "continuation"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}{'' if first else f'-{number}'}>", f"WARC-Date: {DATE}"]
    if first:
        head += [f"WARC-Target-URI: {_line(row['url'] or '')}"] * (row["url"] is not None) + [f"X-Page-ID: {row['page_id']}"] * (row["page_id"] is not None)
        head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
        if kind == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {row['refers_to']}"]
    else:
        head += [f"WARC-Segment-Origin-ID: <{record}>"]
    if not first or not last:
        head += [f"WARC-Segment-Number: {number}"] + [f"WARC-Segment-Total-Length: {done}"] * last
    head += [f"X-Digest-So-Far: sha1:{so_far}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(chunk)}"]
    return "\r\n".join(head) + END + str(chunk, "utf-8")


def write_archives(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write records of plan_records() as gzip WARC files below path; an empty table writes no record."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, running, done = [], 0, hashlib.sha1(), 0
        for batch in batches:
            columns, chunks = [batch.column(c) for c in names], batch.column("chunk")
            for i in range(batch.num_rows):
                row = {c: v[i].as_py() for c, v in zip(names, columns)}
                chunk = memoryview(chunks[i].as_buffer())
                if row["chunk_no"] == 0:
                    running, done = hashlib.sha1(), 0
                running.update(chunk)
                done += len(chunk)
                out.append(segment(row, chunk, running.hexdigest(), done))
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows = cut_chunks(records, chunk_bytes).select(*names, "chunk")
    rows.mapInArrow(frugal(run), "value string").write.option("lineSep", END).option("compression", "gzip").mode("overwrite").text(path)


class _Reader:
    """State of one file: the segment being read, and the record that its segments belong to."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.head: dict[str, str] | None = None
        self.need = 0
        self.body: list[bytes] = []
        self.record: tuple = ()
        self.number, self.running, self.bytes = 0, hashlib.sha1(), 0
        self.skip = 0

    def feed(self, line: str) -> Iterator[tuple]:
        """A stretch of the file between two CRLF CRLF."""
        line, self.skip = line[self.skip :], 0
        if self.head is None:
            if not line:
                return
            names = (h.split(": ", 1) for h in line.split("\r\n")[1:])
            self.head = {k.lower(): v for k, v in names}
            self.need, self.body = int(self.head["content-length"]), []
            return
        part = line.encode()
        self.need -= len(part)
        self.body.append(part)
        if self.need == 2:  # it ends with CRLF: half of the separator after it stands in the next stretch
            self.body.append(b"\r\n")
            self.need, self.skip = 0, 2
        if self.need > 0:  # the payload itself holds CRLF CRLF
            self.body.append(END.encode())
            self.need -= len(END)
            if self.need >= 0:
                return
        if self.need < 0:
            raise ValueError(f"{self.name}: a segment is longer than its Content-Length")
        yield self.row(b"".join(self.body))
        self.head = None

    def row(self, chunk: bytes) -> tuple:
        head = self.head
        if head["warc-type"] != "continuation":
            known = lambda k: int(head[k]) if k in head else None
            self.record = (head["warc-record-id"].strip("<>"), known("x-page-id"), head["warc-type"], known("x-refers-to-page"), known("x-payload-length"), head["warc-payload-digest"].removeprefix("sha1:"))
            self.number, self.running, self.bytes = 0, hashlib.sha1(), 0
        self.running.update(chunk)
        self.bytes += len(chunk)
        number, self.number = self.number, self.number + 1
        last = "warc-segment-total-length" in head or "warc-segment-number" not in head
        return (*self.record, number, chunk, self.running.hexdigest(), self.bytes, last)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below path: a row for each record and chunk number.

    digest_so_far and bytes_so_far run over the record's chunks, computed from what was
    read; the row with is_last has those of the whole stored payload.  A revisit stores no
    payload.  A segment that disagrees with its Content-Length fails the read.
    """
    names = [c.strip().split(" ")[0] for c in CHUNKS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = None, [], 0
        schema = pa.schema(dict(zip(names, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()])))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for line, name in zip(batch.column("value"), batch.column("file").to_pylist()):
                if reader is None or reader.name != name:
                    reader = _Reader(name)
                for row in reader.feed(line.as_py()):
                    rows.append(row)
                    size += len(row[7]) + 200
                    if size >= BATCH_BYTES:
                        yield batch_of()
                        rows, size = [], 0
        yield batch_of()

    lines = spark.read.option("lineSep", END).text(path).select("value", F.input_file_name().alias("file"))
    return lines.mapInArrow(frugal(run), CHUNKS)


def checked_records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read.

    Responses report the size and digest of the chunks as read, revisits those of the payload they refer to.
    """
    read = F.col("record_type") == "response"
    return chunks.where("is_last").select(
        "page_id",
        F.when(read, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
