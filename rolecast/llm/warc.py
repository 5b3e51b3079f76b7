"""WARC archives written and read as a table of payload chunks.

A payload travels as rows (record_id, chunk_no, data) of bounded size. Length and digest are
worked out in the JVM before a payload is cut, since a record's header states them; the
writer streams the chunks into one gzip member per record and checks them against the header
with a running digest. The reader streams archives back into chunk rows, each with the digest
of the payload up to its end, so the last row of a record carries the payload's digest.
Neither side ever holds a whole payload. (The source row itself is one cell of the table.)

An archive file is closed after `archive_bytes`. Every attempt of a task writes files of its
own name; only files in the stored manifest count, so a lost or repeated task leaves at most
unused files.

Records with equal payloads of at least `least` bytes: the smallest record_id is a response,
the others revisit it. Rows that repeat an id and payload are equal and all of one type; null
ids count as larger than all others; a payload of null is empty; an empty table gives no
archive and no rows.
"""

import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecast.llm.common import stored
from rolecast.operators.common import lookup_join, shared_dir

CHUNK = 256 << 10
ARCHIVE = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = ("record_id long, chunk_no long, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, size long, is_last boolean, data binary")


def typed(pages: DataFrame, record_id: str, uri: str, payload: str, least: int = 100) -> DataFrame:
    """(record_id, uri, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(record_id).cast("long").alias("record_id"), F.col(uri).cast("string").alias("uri"),
                        body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.sha2(body, 256).alias("payload_digest"))
    copies = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
              .agg(F.min("record_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    copies = stored(copies.select("payload_digest", "first_id"), "copies")
    rows = lookup_join(rows, copies, ["payload_digest"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return (rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per `chunk` payload bytes, in order inside the partition; a revisit, like an
    empty payload, has one row without data."""
    n = F.when(F.col("record_type") == "revisit", 0).otherwise(
        F.floor((F.col("payload_bytes") - 1) / chunk)).cast("long")
    rows = records.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0)))).alias("chunk_no"))
    data = F.when(F.col("record_type") == "response", F.substr(
        "payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))).otherwise(F.lit(None).cast("binary"))
    return rows.withColumn("data", data).drop("payload")


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _urn(record_id) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def _header(row: dict, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['record_id'])}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
             f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    if row["uri"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["uri"], safe=":/?#[]@!$&'()*+,;=%~"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _writer(folder: str, archive: int, date: str):
    head = ["record_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def write(batches):
        out = deflate = None
        done, n, size, left, digest = [], 0, 0, 0, None

        def put(data: bytes):
            nonlocal size
            size += out.write(data) or 0

        for batch in batches:
            rows = batch.select([*head, "chunk_no"]).to_pylist()
            for row, data in zip(rows, batch.column(batch.schema.get_field_index("data"))):
                if row["chunk_no"] == 0:
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        system, plain = _filesystem(path)
                        system.create_dir(plain.rpartition("/")[0], recursive=True)
                        out, n, size = system.open_output_stream(plain, compression=None), 0, 0
                    deflate, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    put(deflate.compress(_header(row, date)))
                    left = row["payload_bytes"] if row["record_type"] == "response" else 0
                if data.is_valid:
                    piece = data.as_buffer()
                    digest.update(piece)
                    put(deflate.compress(piece))
                    left -= piece.size
                if left < 0:
                    raise ValueError(f"chunks of record {row['record_id']} are out of order")
                if left == 0:
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"chunks of record {row['record_id']} differ from its digest")
                    put(deflate.compress(b"\r\n\r\n") + deflate.flush())
                    n, left = n + 1, -1
                    if size >= archive:
                        out.close()
                        done.append((path, n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_bytes"), map(list, zip(*done)))))

    return write


def write_archives(records: DataFrame, folder: str | None = None, chunk: int = CHUNK,
                   archive_bytes: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Write typed records; the stored manifest (path, n_records, n_bytes) of the archives.
    `folder` must be one that all executors reach by the same path or URI."""
    folder = folder or f"{shared_dir(records.sparkSession)}/llm/warc-{uuid.uuid4().hex}"
    return stored(chunked(records, chunk).mapInArrow(_writer(folder, archive_bytes, date), MANIFEST), "manifest")


def _reader(chunk: int, with_data: bool):
    def fields(stream) -> dict[str, str] | None:
        line = stream.readline()
        if not line:
            return None
        out = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            out[name.lower()] = value.strip()
        return out

    def rows(path: str):
        system, plain = _filesystem(path)
        with system.open_input_stream(plain, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            while (head := fields(stream)) is not None:
                left = int(head["content-length"])
                while (line := stream.readline()) not in (b"\r\n", b""):  # the HTTP head
                    left -= len(line)
                left -= 2
                number = lambda urn: int(x) if (x := urn[len("<urn:record:"):-1]) else None
                kind, digest, no = head["warc-type"], hashlib.sha256(), 0
                stated = head["warc-payload-digest"].partition(":")[2]
                refers = number(head["warc-refers-to"]) if kind == "revisit" else None
                while True:
                    data = stream.read(min(left, chunk)) if left else b""
                    left -= len(data)
                    if left and not data:
                        raise EOFError(f"{path} ends inside a record")
                    digest.update(data)
                    so_far = stated if kind == "revisit" else digest.copy().hexdigest()
                    if not left and so_far != stated:
                        raise ValueError(f"a record in {path} differs from its digest")
                    yield (number(head["warc-record-id"]), no, kind, refers, int(head["x-payload-length"]), so_far,
                           len(data), not left, data if with_data else None)
                    no += 1
                    if not left:
                        break
                if stream.read(4) != b"\r\n\r\n":
                    raise ValueError(f"a record in {path} does not end where it should")

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(CHUNKS.split(", "), kinds)])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    def read(batches):
        for given in batches:
            for path in given.column(0).to_pylist():
                ready, size = [], 0
                for row in rows(path):
                    ready.append(row)
                    size += 200 + (row[6] if with_data else 0)
                    if size > 16 * chunk:
                        yield batch(ready)
                        ready, size = [], 0
                if ready:
                    yield batch(ready)

    return read


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives. payload_digest is the running digest (a revisit's is
    that of its header); `with_data=False` checks and digests payloads but does not keep them."""
    # Few rows, each a whole archive: one task for each.
    files = manifest.select("path").repartition(max(1, min(100_000, manifest.count())), "path")
    return files.mapInArrow(_reader(chunk, with_data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk."""
    return chunks.where("is_last").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")


SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id
      FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages))"""


def op10_warc(spark, sf_dir):
    from rolecast.llm.common import table

    manifest = write_archives(typed(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return records(read_chunks(manifest, with_data=False)).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
