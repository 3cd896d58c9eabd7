"""WARC archives with an index first.

Writing: each task streams its rows to gzip archives in the shared folder, one member per record,
and notes file, offset, length, URL and digest of every record. That index is a Parquet table that
Spark commits, so it names only files of tasks that succeeded; what a failed attempt wrote is never
read. Payloads that repeat are found by digest before, from ids and digests alone: the largest id of
equal payloads of ``revisit_bytes`` or more is written in full, the others as revisits to it.

Reading: the selected index rows are sorted by (file, offset) in ranges of similar size; each task
merges neighbouring records to one byte range (gaps up to ``gap``, at most ``run`` bytes) and so
reads an archive in few, sorted requests. Every payload is checked against its digest.

Archives are opened through Arrow's file systems, so the shared folder may be local, HDFS or an object store.

Defined results: null html is an empty payload, null url an empty one; line breaks in a URL are
percent-encoded; rows that repeat the largest id of their group are each a response; a null id is smaller than any other, so its
row revisits the largest; where all ids of a group are null every row is a response; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, shared_dir

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str, str, int | None, int, str, bytes | None]:
    """The fields of RECORD of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != number("X-Payload-Bytes"):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page-ID"), number("X-Payload-Bytes"), digest, payload


def revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """(page_id, content, refers_to) of the pages that repeat another's payload; SHA-256 decides what is equal."""
    long = pages.where(F.octet_length("html") >= revisit_bytes).select("page_id", F.sha2("html", 256).alias("content"))
    largest = F.max("page_id")
    several = (F.min("page_id") < largest) | (F.count(F.lit(1)) > F.count("page_id"))  # a null id is smaller than any
    groups = long.groupBy("content").agg(largest.alias("refers_to"), several.alias("several")).where("several and refers_to is not null")
    return long.join(groups.drop("several"), "content").where("not page_id <=> refers_to").select("page_id", "content", "refers_to").distinct()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, file_bytes: int = 1 << 30, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Write one record per page and return the index, a committed table."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    again = materialise(revisits(own, revisit_bytes), "revisits")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    again = again.select(F.col("page_id").alias("again"), F.col("content").alias("same"), "refers_to")
    told = own.withColumn("content", F.when(F.octet_length("html") >= revisit_bytes, F.sha2("html", 256)))
    told = told.join(again, (F.col("content") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("again")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        stem = f"{root}/{context.partitionId():06d}-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        out, number, offset = None, 0, 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{stem}-{number:04d}.warc.gz", 0
                        out, number = store.open_output_stream(name, compression=None), number + 1
                    payload = html.as_py().encode("utf-8", "surrogatepass")
                    digest, page, target = hashlib.sha1(payload).hexdigest(), page_id.as_py(), refers_to.as_py()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page, url.as_py(), payload, digest, target)) + packer.flush()
                    out.write(raw)
                    index.append((name, offset, len(raw), url.as_py(), digest, page, "response" if target is None else "revisit", target))
                    offset += len(raw)
                yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return materialise(told.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warc-index")


TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def byte_runs(rows: Iterator[tuple[str, int, int]], gap: int, run: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) -> (file, start, end, records) with near records merged."""
    held: list[tuple[int, int]] = []
    name, start, end = "", 0, 0
    for file, offset, length in rows:
        if held and (file != name or offset - end > gap or offset + length - start > run):
            yield name, start, end, held
            held = []
        if not held:
            name, start, end = file, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield name, start, end, held


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, run: int = 4 << 20, task_bytes: int = 8 << 20, most_tasks: int = 100_000) -> DataFrame:
    """The records that ``index`` selects, with their payloads."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(most_tasks, -(-total // task_bytes)))
    chosen = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pa.fs.FileSystem.from_uri(folder)
        source, opened = None, ""
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for name, start, end, records in byte_runs(rows, gap, run):
            if name != opened:
                if source is not None:
                    source.close()
                source, opened = store.open_input_file(name), name
            raw = source.read_at(end - start, start)
            yield _batch([parse(zlib.decompress(raw[o - start : o - start + n], 31)) for o, n in records], RECORD)
        if source is not None:
            source.close()

    return chosen.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, folder), folder)
