"""WARC archives through a chunked record table.

Payloads travel as rows ``(page_id, chunk_no, data)`` of at most
``CHUNK_BYTES`` each.  Writers and readers hold one chunk at a time: digests
are carried incrementally over the chunks, gzip members are streamed, and no
step allocates a whole record.

* ``chunk_table``   pages -> chunk rows (JVM expressions, no shuffle)
* ``digest_chunks`` chunk rows -> one row per record: bytes and SHA-256
* ``plan_records``  which record is a response, which one revisits it
* ``write_archives`` chunk rows + plan -> ``.warc.gz`` files and their manifest
* ``read_chunks``   manifest -> chunk rows, with the digest so far
* ``read_records``  manifest -> one row per record

Cases: a null payload is empty; payloads under ``MIN_DEDUP_BYTES`` are always
responses; a null ``page_id`` or one that occurs with different payloads gives
one record each (records are keyed by the id and a hash of url and payload);
exact repeats of a row give one record each, too, numbered by ``copy``, and
refer to the first; an empty table gives no files.  Extra columns are ignored.

Files are written below ``spark.checkpoint.dir`` under a name that holds a
fresh id per task attempt; the manifest lists only what committed attempts
wrote, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace, as_bytes

CHUNK_BYTES = 1 << 16
MIN_DEDUP_BYTES = 100
RECORD_DATE = "2024-01-01T00:00:00Z"      # records carry no capture time
CRLF = b"\r\n"

MANIFEST = "path string, n_records long"
CHUNKS = ("record_id string, chunk_no long, data binary, sha256_so_far string, "
          "bytes_so_far long, is_last boolean, record_type string, refers_to long, "
          "page_id long, declared_bytes long, declared_digest string")


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(rec, row, page_id, url, chunk_no, n_chunks, data)``; the chunks of a record
    leave the scan together and in order.  ``row`` tells repeats of a row apart within
    one read."""
    payload = as_bytes("html")
    rec = F.concat_ws("-", F.col("page_id").cast("string"), F.xxhash64("url", "html").cast("string"))
    n = F.greatest(F.ceil(F.length("_payload") / chunk_bytes), F.lit(1)).cast("int")
    return (pages.select(rec.alias("rec"), F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"), payload.alias("_payload"))
            .withColumn("n_chunks", n)
            .select("rec", "row", "page_id", "url", "n_chunks", "_payload",
                    F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
            .select("rec", "row", "page_id", "url", "chunk_no", "n_chunks",
                    F.substring("_payload", F.col("chunk_no") * chunk_bytes + 1,
                                F.lit(chunk_bytes)).alias("data")))


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """``(rec, page_id, payload_bytes, payload_digest)`` per record, from ordered chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha256(), 0
        for b in batches:
            out = []
            for rec, page, no, n, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                if no == 0:
                    sha, size = hashlib.sha256(), 0
                sha.update(data)
                size += len(data)
                if no == n - 1:
                    out.append((rec, page, size, sha.hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
                ["rec", "page_id", "payload_bytes", "payload_digest"])

    return chunks.select("rec", "page_id", "chunk_no", "n_chunks", "data").mapInArrow(
        run, "rec string, page_id long, payload_bytes long, payload_digest string")


def plan_records(digests: DataFrame, ws: Workspace, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """One row per distinct ``rec``: whether it revisits, and the page of the response.

    The smallest page_id of a digest is the response (ties: the smallest
    ``rec``); the minimum is combined map-side, so a hot payload is no problem.
    """
    # Both are written: the payloads are read for their digests once, and the
    # join below has plain exchanges, which adaptive execution may split.
    recs = ws.put(digests.distinct(), "records")
    first = (recs.where(F.col("payload_bytes") >= min_bytes)
             .groupBy(F.col("payload_digest").alias("_d"))
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("page_id"),
                                 F.col("rec").alias("rec"))).alias("_f")))
    first = ws.put(first, "first")
    revisit = F.col("_f").isNotNull() & (F.col("_f.rec") != F.col("rec"))
    return (recs.join(first, (recs.payload_digest == first._d) & (recs.payload_bytes >= min_bytes), "left")
            .select("rec", "payload_bytes", "payload_digest", revisit.alias("is_revisit"),
                    F.col("_f").isNotNull().alias("shared"), F.col("_f.page_id").alias("first_page")))


def _header(page, url, kind, refers, size, digest, length, copy) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{url}/{copy}')}>",
             f"WARC-Date: {RECORD_DATE}", f"Content-Length: {length}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if url:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers}")
    else:
        lines.append("Content-Type: text/html; charset=utf-8")
    return "\r\n".join(lines).encode() + CRLF + CRLF


def write_archives(chunks: DataFrame, plan: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Stream ordered chunk rows into one ``.warc.gz`` per task; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out = gz = None
        path, n, before, copy = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, (None, None), 0
        for b in batches:
            for rec, row, page, url, no, n_chunks, data, size, digest, revisit, shared, refers in zip(
                    *(b.column(i).to_pylist() for i in range(b.num_columns))):
                if (rec, row) != before:
                    copy = copy + 1 if rec == before[0] else 0
                    before = (rec, row)
                if copy and shared:     # a repeat of a row refers to the first
                    revisit = True
                    if no:
                        continue
                    n_chunks = 1
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)   # gzip members are our own
                if no == 0:
                    kind = "revisit" if revisit else "response"
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(gz.compress(_header(page, url, kind, refers if revisit else None, size,
                                                  digest, 0 if revisit else size, copy)))
                if not revisit:
                    out.write(gz.compress(data))
                if no == n_chunks - 1:
                    out.write(gz.compress(CRLF + CRLF) + gz.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())],
                                             ["path", "n_records"])

    # Rows of one record meet in one task, in order: records are many and even.
    # A revisit has no payload block: only its first chunk row travels on.
    planned = (chunks.repartition("rec").join(plan, "rec")
               .where(~F.col("is_revisit") | (F.col("chunk_no") == 0))
               .withColumn("n_chunks", F.when(F.col("is_revisit"), F.lit(1)).otherwise(F.col("n_chunks")))
               .sortWithinPartitions("rec", "row", "chunk_no"))
    rows = planned.select("rec", "row", "page_id", "url", "chunk_no", "n_chunks", "data", "payload_bytes",
                          "payload_digest", "is_revisit", "shared", "first_page")
    return rows.mapInArrow(run, MANIFEST)


def _stream(fs, path: str, step: int) -> Iterator[tuple[bytes, bool]]:
    """Decompressed pieces of a file of gzip members; True marks a member's end."""
    with fs.open_input_stream(path, compression=None) as src:
        z, raw = zlib.decompressobj(31), src.read(step)
        while raw:
            piece = z.decompress(raw, step)
            raw = z.unconsumed_tail
            ended = z.eof
            if ended:
                raw, z = z.unused_data, zlib.decompressobj(31)
            if piece or ended:
                yield piece, ended
            if not raw:
                raw = src.read(step)


def _records(fs, path: str, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one archive, holding no more than a chunk and a piece."""
    buf, head, left, no, sha, done = bytearray(), None, 0, 0, None, 0
    for piece, ended in _stream(fs, path, chunk_bytes):
        buf += piece
        if head is None and (end := buf.find(CRLF + CRLF)) >= 0:
            lines = bytes(buf[:end]).decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            del buf[:end + 4]
            left, no, sha, done = int(head["Content-Length"]), 0, hashlib.sha256(), 0
        while head is not None and (len(buf) >= min(left, chunk_bytes)) and (left or no == 0):
            take = min(left, chunk_bytes)
            data = bytes(buf[:take])
            del buf[:take]
            left, done = left - take, done + take
            sha.update(data)
            yield head, no, data, sha.hexdigest(), done, left == 0
            no += 1
        if ended:
            buf, head = bytearray(), None


def read_chunks(manifest: DataFrame, scheme: str, chunk_bytes: int = CHUNK_BYTES,
                payload: bool = True) -> DataFrame:
    """Chunk rows of the archives in a manifest; ``payload=False`` leaves out the
    data and all but the last chunk of a record (digests are of the whole payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(scheme)
        schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()),
                            ("sha256_so_far", pa.string()), ("bytes_so_far", pa.int64()),
                            ("is_last", pa.bool_()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("page_id", pa.int64()),
                            ("declared_bytes", pa.int64()), ("declared_digest", pa.string())])
        number = lambda h, k: int(h[k]) if k in h else None
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for h, no, data, sha, size, last in _records(fs, path, chunk_bytes):
                    if payload or last:
                        rows.append((h["WARC-Record-ID"], no, data if payload else None, sha, size, last,
                                     h["WARC-Type"], number(h, "X-Refers-To-Page-ID"),
                                     number(h, "X-Page-ID"), number(h, "X-Payload-Length"),
                                     h["WARC-Payload-Digest"].removeprefix("sha256:")))
                        held += len(data) if payload else 200
                    if held >= 64 * chunk_bytes:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    # One file per row; a file is what one writer task held, so files are even.
    return manifest.select("path").mapInArrow(run, CHUNKS)


def read_records(manifest: DataFrame, scheme: str) -> DataFrame:
    """One row per record: size and digest as computed while reading; for a
    revisit those its header declares for the payload it refers to.  A response
    whose digest differs from its header fails the job."""
    last = read_chunks(manifest, scheme, payload=False).where("is_last")
    revisit = F.col("record_type") == "revisit"
    intact = revisit | ((F.col("sha256_so_far") == F.col("declared_digest"))
                        & (F.col("bytes_so_far") == F.col("declared_bytes")))
    return last.select(
        "record_id", "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(~intact, F.raise_error(F.lit("payload digest differs from its record header")))
        .when(revisit, F.col("declared_digest")).otherwise(F.col("sha256_so_far")).alias("payload_digest"),
        "record_type", "refers_to")


def archive_pages(spark: SparkSession, pages: DataFrame,
                  chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, str]:
    """Write every row of ``pages`` as a WARC record; returns (manifest, folder)."""
    ws = Workspace(spark, "warc")
    chunks = chunk_table(pages, chunk_bytes)
    plan = plan_records(digest_chunks(chunks), ws)
    folder = ws.path("archives")
    return ws.put(write_archives(chunks, plan, folder), "manifest"), folder
