"""WARC archives as a table of chunks.

Writing: a first pass over the pages keeps digests and sizes alone and finds which payloads repeat; revisits need no more
than that, so a payload is only shuffled where its digest may be a repeated one. What is written goes to Python as rows of
record, chunk number and a bounded piece of the payload. Each task streams its records, compressed one by one, to an
archive in the shared folder and reports the archive's name, so what a lost or repeated attempt wrote is never read.

Reading: archives are streamed into rows of record, chunk number and a bounded piece of the payload, each with the SHA-1
and the byte count of the payload up to there; the last chunk of a record thus carries its digest, which is compared with
the record's header. No Python task holds a record as a whole. The JVM does while it hashes and cuts a page, for a page is
one cell of its table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, map_arrow, maybe_among, table

#: Bytes of a chunk; bytes of an archive after which a task starts another; payloads from this size on are stored once.
CHUNK, ARCHIVE, MIN_REVISIT = 1 << 18, 1 << 28, 1000
CHUNK_ROW = "page_id long, url string, record_type string, refers_to long, chunk long, data binary, sha1 string, bytes long, last boolean"


def _open(uri: str, write: bool):
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "/", 1))
    if write:
        at.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return at.open_output_stream(path, compression=None)
    return at.open_input_stream(path, compression=None)


def payloads(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload (binary), n, sha1, response: for pages stored as a revisit, the page_id that holds the payload.

    Of equal payloads of MIN_REVISIT bytes or more, rows with the largest page_id are responses and the others, null
    page_ids among them, revisit it; a revisit's payload is null here.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    digests = scratch.save(rows.filter(F.col("n") >= MIN_REVISIT).drop("payload"), "digests")
    repeated = digests.groupBy("sha1", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("rows")).filter("rows > 1 and top is not null")
    same = scratch.save(repeated.select("sha1", "n", "top"), "repeated")  # a plain table, so that a join can split a hot payload
    if same.isEmpty():
        return rows.withColumn("response", F.lit(None).cast("long"))
    revisit = F.coalesce(F.col("page_id") < F.col("top"), F.lit(True))
    revisits = digests.join(same, ["sha1", "n"]).filter(revisit).select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "n", "sha1", F.col("top").alias("response"))
    maybe, once = maybe_among(rows, same, "sha1", "n")
    known = maybe.join(same, ["sha1", "n"], "left").filter(F.col("top").isNull() | ~revisit).select(rows.columns)
    return once.unionByName(known).withColumn("response", F.lit(None).cast("long")).unionByName(revisits)


def pieces(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows of ``payloads`` cut in the JVM: k and data for every piece of chunk bytes, in order; one empty piece without a payload."""
    count = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / chunk)).cast("int")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    data = F.coalesce(F.substring("payload", F.col("k") * chunk + 1, F.lit(chunk)), F.lit(b""))
    return each.select("page_id", "url", "n", "sha1", "response", "k", data.alias("data"))


def _header(record: str, page_id, url, n: int, sha1: str, response, date: str) -> bytes:
    """Headers of the record and of the HTTP message in it, up to the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    name = lambda x: "" if x is None else x
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:keyloft:page:{name(page_id)}:{record}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if response is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:keyloft:page:{response}>"]
    lines.append(f"Content-Length: {len(http) + (n if response is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """Writes a record for each row of ``payloads``; returns path, records, bytes of each archive (run it once and keep it).

    A record's id is its page_id with the task and the place of the record there, so that rows of one page_id differ; a
    revisit names the page, whose records' ids start with that name.
    """

    def run(batches):
        task = TaskContext.get()
        mark = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, out, size, records, written, press, held = [], None, 0, 0, 0, None, []

        def put(last: bool):
            nonlocal size, held
            if held and (last or sum(map(len, held)) > chunk):
                raw = b"".join(held)
                out.write(raw)
                size += len(raw)
                held = []

        def end_record():
            nonlocal press
            if press is not None:
                held.extend((press.compress(b"\r\n\r\n"), press.flush()))
                put(True)
                press = None

        def end_archive():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name(), records, size))
                out = None

        def name() -> str:
            return f"{folder}/part-{mark}-{len(done):04d}.warc.gz"

        for batch in batches:
            columns = [batch.column(c) for c in ("k", "page_id", "url", "n", "sha1", "response")]
            data = batch.column("data")
            for i in range(batch.num_rows):
                k, page_id, url, n, sha1, response = (c[i].as_py() for c in columns)
                if k == 0:
                    end_record()
                    if size >= ARCHIVE:
                        end_archive()
                    if out is None:
                        out, size, records = _open(name(), True), 0, 0
                    press = zlib.compressobj(3, zlib.DEFLATED, 31)
                    held.append(press.compress(_header(f"{mark}-{written}", page_id, url, n, sha1, response, date)))
                    records += 1
                    written += 1
                if len(data[i].as_buffer()):
                    held.append(press.compress(memoryview(data[i].as_buffer())))
                    put(False)
        end_record()
        end_archive()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x)) for x in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return map_arrow(pieces(rows, chunk), run, "path string, records long, bytes long")


class _Inflated:
    """Bytes of a file of gzip members, read piece by piece."""

    def __init__(self, source, piece: int):
        self.source, self.piece, self.have, self.rest = source, piece, b"", b""
        self.press = zlib.decompressobj(31)

    def fill(self) -> bool:
        while True:
            if self.press.eof:
                self.rest, self.press = self.press.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.source.read(self.piece)
            self.rest = b""
            if not raw:
                return False
            got = self.press.decompress(raw, self.piece)
            self.rest = self.press.unconsumed_tail
            if got:
                self.have += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.have:
            if not self.fill():
                if self.have:
                    raise ValueError("the archive ends inside a record")
                return None
        head, _, self.have = self.have.partition(mark)
        return head

    def take(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if not self.have and not self.fill():
                raise ValueError("the archive ends inside a record")
            got, self.have = self.have[:n], self.have[n:]
            n -= len(got)
            yield got


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def _chunks(source, chunk: int):
    """Rows of CHUNK_ROW of one archive."""
    number = lambda uri: int(uri.rstrip(">").split(":")[3]) if uri and uri.rstrip(">").split(":")[3] else None
    stream = _Inflated(source, chunk)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        http = stream.until(b"\r\n\r\n")
        rest = int(fields["content-length"]) - len(http) - 4
        declared = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
        url = fields.get("warc-target-uri")
        start = (number(fields["warc-record-id"]), None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), fields["warc-type"], number(fields.get("warc-refers-to")))
        if start[2] == "revisit":
            yield (*start, 0, b"", declared, int(_fields(http)["content-length"]), True)
        else:
            digest, seen, k, held = hashlib.sha1(), 0, 0, b""
            for got in stream.take(rest):
                held += got
                while len(held) > chunk:
                    data, held = held[:chunk], held[chunk:]
                    digest.update(data)
                    seen += len(data)
                    yield (*start, k, data, digest.hexdigest(), seen, False)
                    k += 1
            digest.update(held)
            if digest.hexdigest() != declared:
                raise ValueError(f"payload of record {start[0]} does not match its digest")
            yield (*start, k, held, declared, seen + len(held), True)
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_chunks(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunked record table (CHUNK_ROW) of the archives named in column path."""

    def run(batches):
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("sha1", pa.string()), ("bytes", pa.int64()), ("last", pa.bool_())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with _open(path, False) as source:
                    for row in _chunks(source, chunk):
                        held.append(row)
                        size += len(row[5]) + 200
                        if size > 8 * chunk:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)

    return map_arrow(archives.select("path"), run, CHUNK_ROW)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its last chunk."""
    return chunks.filter("last").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


def archive(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Writes all pages to archives and returns the chunked record table read back from them.

    A null html is an empty payload, a null page_id an empty id; rows are archived each, repeated ones too; other columns
    are ignored. A payload of any length is archived whole, chunk by chunk. An empty table gives no archive and no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    written = scratch.save(write_archives(payloads(pages, scratch), scratch.path("archives"), chunk=chunk), "manifest")
    return read_chunks(written.repartition(max(1, written.count())), chunk)


def op3_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return records(archive(table(spark, sf_dir, "pages")))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to
FROM m
"""
