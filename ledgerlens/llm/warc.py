"""WARC archives: a writer and a chunked reader.

Each task writes one gzip archive (a member per record) to the shared folder through a file system that executors
reach, under a name of its own, and reports it in a manifest that Spark commits; files of lost or repeated attempts
are in no manifest. The reader streams archives and yields a payload as rows (record, chunk number) of bounded size,
carrying the running length and SHA-256, so no record is held whole.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, small_batches, stage

CHUNK = 1 << 16
#: Bytes of a header line that are read; the rest of a longer one is passed over.
LINE = 1 << 20
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
CHUNK_SCHEMA = ("path string, record long, record_id string, record_type string, target_uri string, refers_to string, "
                "chunk_no long, last boolean, data binary, payload_bytes long, payload_digest string")
_ARROW = pa.schema([tuple(c.split()) for c in CHUNK_SCHEMA.replace("long", "int64").replace("boolean", "bool").split(", ")])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _id(name: str) -> str:
    uri = f"<urn:x-page:{name}>"
    if len(uri) > LINE - 100:
        raise ValueError("a page's id is too long for a header line")
    return uri


def _name(key: Column) -> Column:
    """An id as part of a header: percent-encoded, so that no letter of it ends the line or the URI; a null id is a lone %."""
    return F.coalesce(F.url_encode(key.cast("string")), F.lit("%"))


def _key(uri: Column) -> Column:
    """The id as text of a header's URI; null for a null id."""
    name = F.regexp_extract(uri, r"^<urn:x-page:([^>]*)>$", 1)
    return F.when(name != "%", F.url_decode(name))


def _record(kind: str, key: str, url: str, refers: str | None, digest: str, payload: memoryview) -> Iterator[bytes]:
    block = len(_HTTP) + (len(payload) if kind == "response" else 0)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(key)}", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    yield ("\r\n".join(head) + "\r\n\r\n").encode()
    yield _HTTP
    if kind == "response":
        for i in range(0, len(payload), CHUNK):
            yield bytes(payload[i : i + CHUNK])
    yield b"\r\n\r\n"


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    out, path, n = None, f"{root}/{uuid.uuid4().hex}.warc.gz", 0
    for batch in batches:
        key, url, payload, digest, kind, refers = batch.columns
        for i in range(batch.num_rows):
            if out is None:
                out = fs.open_output_stream(path, compression=None)
            body = memoryview(payload[i].as_buffer() or b"")
            gz = zlib.compressobj(1, zlib.DEFLATED, 31)
            for part in _record(kind[i].as_py(), key[i].as_py(), url[i].as_py(), refers[i].as_py(), digest[i].as_py(), body):
                out.write(gz.compress(part))
            out.write(gz.flush())
            n += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """key, url, payload, digest, kind and refers of the record of each page.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, that with the smallest id is a response and the others
    revisit it. A null payload is empty, a null url an empty one. A null id comes after all others and counts as equal
    to another null; rows that repeat the smallest id are all responses, those that repeat another are all revisits.
    Ids go into headers percent-encoded: line breaks, brackets, any text come back; one of more than about 1 MB encoded
    raises an error. Other columns are ignored and empty tables give no records. Only ids and digests meet by digest, so neither a very
    long nor a very frequent payload makes a task large.
    """
    payload = F.coalesce(pages[payload_col], F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"[\r\n]+", " ")
    p = pages.select(pages[id_col].alias("key"), url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    keys = stage(pages.where(F.octet_length(payload) >= LEAST_REVISIT).select(pages[id_col].alias("k"), F.sha2(payload, 256).alias("d")), "warc-keys")
    # staged, so that the join is of plain exchanges and a hot digest can be split
    first = stage(keys.groupBy("d").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("first")).where("c > 1").select(F.col("d").alias("fd"), "first"), "warc-first")
    again = keys.join(first, F.col("d") == F.col("fd")).where(~F.col("k").eqNullSafe(F.col("first"))).select("k", "d", "first")
    again = stage(again.dropDuplicates(["k", "d"]), "warc-again")
    j = p.join(again, p["key"].eqNullSafe(again["k"]) & (p["digest"] == again["d"]), "left")
    return j.select(_name(F.col("key")).alias("key"), "url", "payload", "digest",
                    F.when(F.col("d").isNotNull(), "revisit").otherwise("response").alias("kind"), F.when(F.col("d").isNotNull(), _name(F.col("first"))).alias("refers"))


def write_warc(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write plan_records' rows as archives below `folder` (default: the shared one); returns the manifest (path, records)."""
    spark = records.sparkSession
    small_batches(spark)
    folder = folder or new_dir(spark, "warc")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    manifest = records.mapInArrow(lambda b: _write_batches(b, folder), "path string, records long")
    return stage(manifest.withColumn("folder", F.lit(folder)), "warc-manifest")


class _Members(io.RawIOBase):
    """The inflated bytes of a gzip file of many members, read forward in bounded pieces."""

    def __init__(self, source):
        self.source, self.z, self.left = source, zlib.decompressobj(31), b""

    def readinto(self, into) -> int:
        while True:
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
            fed = self.left or self.z.unconsumed_tail or self.source.read(CHUNK)
            self.left = b""
            if not fed:
                return 0
            got = self.z.decompress(fed, len(into))
            if got:
                into[: len(got)] = got
                self.left = self.z.unconsumed_tail if not self.z.eof else b""
                return len(got)
            self.left = self.z.unconsumed_tail if not self.z.eof else b""

    def readable(self) -> bool:
        return True


def _line(f: io.BufferedReader, most: int | None = None) -> tuple[bytes, int]:
    """The start of the next line and the whole line's length; at most `most` bytes are read, LINE are kept."""
    line = f.readline(LINE if most is None else min(LINE, most))
    size, part = len(line), line
    while part and not part.endswith(b"\n") and (most is None or size < most):
        part = f.readline(LINE if most is None else min(LINE, most - size))
        size += len(part)
    return line, size


def _head(f: io.BufferedReader) -> dict[str, str] | None:
    """The next header; None at the end."""
    line, _ = _line(f)
    while line in (b"\r\n", b"\n"):
        line, _ = _line(f)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head = {}
    while (line := _line(f)[0]) not in (b"\r\n", b"\n", b""):
        k, _, v = line.decode("utf-8", "replace").partition(":")
        head[k.strip().lower()] = v.strip()
    return head


def chunks_of(f: io.BufferedReader, path: str, data: bool) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA for each record of a stream of WARC records; every record has at least its last chunk."""
    n = 0
    while (head := _head(f)) is not None:
        kind, left = head.get("warc-type", ""), int(head.get("content-length", 0))
        if "http" in head.get("content-type", ""):
            while left:
                line, size = _line(f, left)
                left -= size
                if line in (b"\r\n", b"\n", b""):
                    break
        own = (path, n, head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-refers-to"))
        sha, size, no = hashlib.sha256(), 0, 0
        if kind == "revisit":
            while left and (part := f.read(min(left, CHUNK))):
                left -= len(part)
            yield *own, 0, True, None, int(head.get("x-payload-length", -1)), head.get("warc-payload-digest", "").removeprefix("sha256:")
        else:
            while True:
                part = f.read(min(left, CHUNK))
                if left and not part:
                    raise ValueError(f"{path}: record {n} is cut off")
                left -= len(part)
                size += len(part)
                sha.update(part)
                if not left or data:
                    yield *own, no, not left, part if data else None, size, sha.hexdigest()
                no += 1
                if not left:
                    break
        n += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _read_batches(batches: Iterator[pa.RecordBatch], data: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, _ = pafs.FileSystem.from_uri(folder)
            with fs.open_input_stream(path, compression=None) as source:
                rows, held = [], 0
                for row in chunks_of(io.BufferedReader(_Members(source), CHUNK), path, data):
                    rows.append(row)
                    held += len(row[8] or b"") + 200
                    if held > 4_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)


def read_warc(manifest: DataFrame, data: bool = True) -> DataFrame:
    """Chunk rows of all records of the manifest's archives; without `data` one row a record, its last chunk's.

    payload_bytes and payload_digest of a row are those of the payload up to and including its chunk; a revisit has one
    row, with the length and digest its header states.
    """
    # one task an archive: by number, which is kept as it is, since a row of the manifest stands for a whole archive
    archives = max(1, manifest.count())
    return manifest.select("folder", "path").repartition(archives).mapInArrow(lambda b: _read_batches(b, data), CHUNK_SCHEMA)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row a record of read_warc's chunk rows: length by its chunks (a revisit's by its header), digest by its last one."""
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.coalesce(F.octet_length("data"), F.lit(0)).cast("long"))
    return chunks.groupBy("path", "record").agg(
        F.first("record_id").alias("record_id"), F.first("record_type").alias("record_type"), F.first("target_uri").alias("target_uri"), F.first("refers_to").alias("refers_to"),
        F.count(F.lit(1)).alias("chunks"), F.sum(size).alias("payload_bytes"), F.max(F.when(F.col("last"), F.col("payload_digest"))).alias("payload_digest"))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages, read the archives back as chunk rows: id, payload_bytes, payload_digest, record_type, refers_to of each page.

    Payloads of any length come back as chunks of CHUNK bytes; for other odd inputs see plan_records.
    """
    kind = pages.schema[id_col].dataType
    name = lambda c: _key(c).cast(kind)
    records = record_table(read_warc(write_warc(plan_records(pages, id_col, url_col, payload_col))))
    return records.select(name(F.col("record_id")).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                          name(F.col("refers_to")).alias("refers_to"))
