"""WARC archives: an index is written first-class beside them, and reads follow the index.

Every page becomes one gzip member (WARC/1.1), so that a record can be fetched
by offset and length alone.  An archive's name is that of the task attempt that
wrote it and stands in the index, so that a repeated attempt changes nothing
that is read.  Pages with equal payloads of at least
MIN_REVISIT_BYTES share one response, that of the smallest page_id; the others
are revisit records that refer to it.  The index holds file, offset, length,
page_id, URL and payload digest of each record; a read sorts the selected
entries by place and fetches neighbouring byte ranges together.

Null html is an empty payload, a null URL leaves out the target header, line
breaks inside a URL are percent-encoded.  Rows that repeat the smallest page_id
of their payload are all responses; a null page_id counts as larger than any.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.session import maybe_broadcast, stored
from cityloom.sources.files import attempt_output, open_input

MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges at most this far apart are fetched by one read ...
GAP_BYTES = 64 << 10
#: ... of at most this size (a longer record is fetched alone).
READ_BYTES = 8 << 20
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string"


#: Compressed bytes that a task reads.
TASK_BYTES = 128 << 20


def archive_uri(folder: str, file: str) -> str:
    return f"{folder}/archives/{file}"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, compressed as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers)}", f"WARC-Refers-To-Page-ID: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header block and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _write(batches: Iterator[pa.RecordBatch], *, folder: str, date: str) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    index, at = [], 0
    names = ["file", "offset", "length", "page_id", "url", "digest"]
    with attempt_output(f"{folder}/archives", f"{TaskContext.get().partitionId():06d}", ".warc.gz") as (file, out):
        batch: pa.RecordBatch | None = first
        while batch is not None:
            place, length = [], []
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for page, url, html, size, digest, refers, revisit in zip(*(cols[n].to_pylist() for n in ("page_id", "url", "html", "size", "digest", "refers_to", "revisit"))):
                data = record(page, url, (html or "").encode(), size, digest, refers, revisit, date)
                out.write(data)
                place.append(at)
                length.append(len(data))
                at += len(data)
            index.append(pa.RecordBatch.from_arrays([pa.array([file] * len(place), pa.string()), pa.array(place, pa.int64()), pa.array(length, pa.int64()), cols["page_id"].cast(pa.int64()), cols["url"], cols["digest"]], names=names))
            batch = next(batches, None)
    yield from index  # only once the archive is whole


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest, revisit, refers_to.

    Groups of equal payloads are found on digests alone.  Only digests that repeat
    are joined back: measured small they are broadcast and the pages stay where
    they are; else pages are joined by digest, which adaptive execution splits
    where one payload fills a partition.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumns({"size": F.octet_length(payload).cast("bigint"), "digest": F.sha2(payload, 256)})
    groups = rows.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = rows.join(maybe_broadcast(stored(groups, "warc-groups"), 120), "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "digest", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page below `folder` (a URI all executors share); the index read back."""
    with_revisits(pages).mapInArrow(partial(_write, folder=folder, date=date), INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch], *, folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    source, of = None, None
    try:
        for batch in batches:
            file, offset, length = (batch.column(i).to_pylist() for i in range(3))
            out: dict[str, list] = {n: [] for n in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            data, base = b"", 0
            for i, (f, o, n) in enumerate(zip(file, offset, length)):
                if f != of:
                    if source is not None:
                        source.close()
                    source, of, data = open_input(archive_uri(folder, f)), f, b""
                if not base <= o <= o + n <= base + len(data):
                    end, k = o + n, i + 1
                    while k < len(file) and file[k] == f and 0 <= offset[k] - end <= GAP_BYTES and offset[k] + length[k] - o <= READ_BYTES:
                        end, k = offset[k] + length[k], k + 1
                    data, base = source.read_at(end - o, o), o
                fields, http, payload = parse(data[o - base : o - base + n])
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged payload in archive {f} at {o}")
                page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                for name, x in (("page_id", None if page is None else int(page)), ("url", fields.get("WARC-Target-URI")), ("payload_bytes", size), ("payload_digest", digest), ("record_type", kind), ("refers_to", None if refers is None else int(refers)), ("payload", payload.decode() if payloads and kind == "response" else None)):
                    out[name].append(x)
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items() if payloads or k != "payload"], names=[k for k in out if payloads or k != "payload"])
    finally:
        if source is not None:
            source.close()


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that `index` (or any selection of its rows) names, payload digests verified.

    Entries are dealt by (file, offset) so that a task's ranges lie together.
    """
    # sizes of index rows say nothing of the bytes to read: those are summed
    size = index.agg(F.sum("length").alias("b")).first()["b"] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    placed = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload string" * payloads
    return placed.mapInArrow(partial(_read, folder=folder, payloads=payloads), schema)
