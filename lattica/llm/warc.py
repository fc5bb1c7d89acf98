"""WARC archives: one gzip member for each record, and a sequential reader that verifies what it reads.

The files lie in the folder that driver and executors share and are reached through pyarrow's file systems, so
a local path, HDFS or an object store will do. A task that is run again writes files of other names; only those
of the run that Spark keeps are in the manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import new_path, shuffle_width, slices, small_batches, stash, table

#: Bytes of compressed records after which a writer begins another file.
FILE_BYTES = 64 << 20
#: Bytes that the reader asks for at a time.
CHUNK = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head alone; the digest and length are of the full payload."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": url and one_line(url),
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Payload-Length": len(payload),
        "X-Page-ID": page_id,
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes = field(repr=False)


def parts_of_member(read, held: bytes) -> Iterator[bytes]:
    """Decompresses one member bit by bit; the generator's value is what was read beyond it."""
    unpacker = zlib.decompressobj(31)
    while not unpacker.eof:
        data = held or read(CHUNK)
        if not data:
            raise EOFError("a gzip member is cut short")
        yield unpacker.decompress(data)
        held = b""
    return unpacker.unused_data


def read_records(read) -> Iterator[Record]:
    """The records of one archive, in order, by read(n). Raises ValueError where framing or a digest is wrong."""
    held = read(CHUNK)
    while held:
        parts = parts_of_member(read, held)
        seen = bytearray()
        while (at := seen.find(b"\r\n\r\n")) < 0:
            try:
                seen += next(parts)
            except StopIteration:
                raise ValueError("a record has no end of its header") from None
        version, *lines = bytes(seen[:at]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = seen[at + 4 :]
        held = None
        while held is None:
            try:
                block += next(parts)
            except StopIteration as end:
                held = end.value
        if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
            raise ValueError(f"a record has {len(block)} bytes after its header; its content length is {size}")
        block = bytes(block[:size])
        if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"wrong block digest: {headers['WARC-Record-ID']}")
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError(f"wrong payload digest: {headers['WARC-Record-ID']}")
        yield Record(headers, payload)
        held = held or read(CHUNK)


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, body, refers_to, revisit: of equal payloads of at least `least` bytes, all but the smallest page_id revisit it.

    A null html is an empty payload. Rows that repeat the smallest page_id are responses too; a null page_id is
    never referred to, but refers to another. Only groups of two or more are joined back, and Spark can split
    the rows of a large one.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    long = rows.where(F.octet_length("body") >= least)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "body", F.when(other, F.col("first")).alias("refers_to"), other.alias("revisit"))


def write_archives(marked: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records and returns the manifest: file, records, bytes. Tasks hold one record at a time.

    A null url or body is written as empty, a null page_id as a record without one; rows that repeat are records of
    their own, and other columns are left out. An empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        out, name, records, size, made = None, "", 0, 0, []
        for batch in slices(batches):
            for row in batch.to_pylist():
                if out is None:
                    name, records, size = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made)}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                member = make_record(row["page_id"], row["url"], row["body"], row["refers_to"], row["revisit"], date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    made.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, records, size))
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in made], "records": [x[1] for x in made], "bytes": [x[2] for x in made]}, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stash(small_batches(marked).mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest (both of the full payload), record_type, refers_to.

    Records that repeat are rows of their own; an empty manifest gives no rows. A digest that isn't the payload's,
    or a record whose frame is broken, is an error.
    """
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for record in read_records(stream.read):
                        h = record.headers
                        rows.append((number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], number(h.get("X-Refers-To-Page-ID"))))
                if len(rows) != records:
                    raise ValueError(f"{name} has {len(rows)} records; {records} were written")
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    spread = manifest.select("file", "records").repartition(shuffle_width(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    manifest = write_archives(mark_revisits(table(spark, sf_dir, "pages")), path)
    return read_archives(manifest, path).drop("url")


OP10_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
