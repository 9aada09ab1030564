"""Operator 5. WARC archives: written by tasks, read back by a sequential reader.

Every archive begins with a warcinfo record, and every record is one gzip member. The reader goes through an archive once from front to back: it
inflates with zlib piece by piece, frames each record by its Content-Length, and verifies the
payload digest; a damaged or truncated archive raises ``ValueError``. It holds one record at a time. It reads
archives of others too: field names in any case, records of other types (passed over), HTTP heads before
the payload, missing or other digests and page ids (null).

Payloads are deduplicated by digest. Of records with equal payloads of at least ``least_bytes``, that
with the largest page_id is a response and the others are revisits, which hold no payload but its
digest, its length and the response's id. Rows that repeat that page_id and payload are responses
too. Null html counts as an empty payload; a row with a null page_id is kept, and is a revisit where
an equal payload has an id. An empty table gives no archive and no rows. Further columns are ignored.

A task writes files of its own under a new name each time it runs and hands their paths on only
when it ends, so what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, shared_dir

FILE_BYTES = 32 << 20
CHUNK = 256 << 10
#: Bytes that are inflated at a time.
STEP = 4 << 20
#: Records of these types are pages; a reader passes over others.
PAGES = ("response", "revisit")
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _identity(kind: str) -> list[tuple[str, str]]:
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", now)]


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    return _member([*_identity("warcinfo"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as one gzip member. The ids of pages and a revisit's length are in fields of our own."""
    own = [("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    uri = ("WARC-Target-URI", " ".join((url or "").split()))
    fields = [*_identity("revisit" if revisit else "response"), uri, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), *own, ("Content-Type", "text/html")]
    return _member(fields, b"" if revisit else payload)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated piece by piece."""
    inflate, out = zlib.decompressobj(31), bytearray()
    begun = False
    for chunk in chunks:
        while chunk:
            begun = True
            try:
                out += inflate.decompress(chunk, STEP)  # so much at a time, however well it is packed
            except zlib.error as e:
                raise ValueError(f"damaged member: {e}") from e
            chunk = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if not inflate.eof:
                continue
            yield bytes(out)
            inflate, out, begun = zlib.decompressobj(31), bytearray(), False
    if begun:
        raise ValueError("the archive ends within a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record; its framing, and its digest where it has one by SHA-1, verified."""
    end = member.find(b"\r\n\r\n")
    lines = member[:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    pairs = (x.partition(":") for x in lines[1:])
    fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no Content-Length")
    length = int(fields["content-length"])
    block, tail = member[end + 4 : end + 4 + length], member[end + 4 + length :]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    if fields.get("warc-type") == "response" and name.lower() == "sha1" and value.upper() != digest(_payload(fields, block)):
        raise ValueError("the payload does not have its digest")
    return fields, block


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    """The block, less the HTTP head that it begins with where it is a whole HTTP response."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _chunks(uri: str) -> Iterator[bytes]:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def mark(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= least_bytes
    first = rows.filter(large).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("sha", "refers_to")
    first = checkpointed(first)  # so that Spark shuffles both sides of the join itself and can split a payload that many pages have
    revisit = F.coalesce(large & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return rows.join(first, "sha", "left").select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write(marked: DataFrame, folder: str) -> DataFrame:
    """Archives under ``folder`` (a URI); returns (path, records). The writing is over when this returns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        name, stream, size, n = "", None, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                if stream is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(path, recursive=True)
                    stream = fs.open_output_stream(f"{path}/{name}")
                    stream.write(info(name))
                data = record(*row)
                stream.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    stream.close()
                    done.append((f"{folder}/{name}", n))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    return checkpointed(marked.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(each, "path string, records long"))


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives, given their URIs in ``path``: RESULT, and payload if asked for (null for revisits)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, rows[0], strict=False)], names[: len(rows[0])])

        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
        for b in batches:
            for uri in b.column("path").to_pylist():
                rows, size = [], 0
                for member in members(_chunks(uri)):
                    fields, block = parse(member)
                    kind = fields.get("warc-type")
                    if kind not in PAGES:
                        continue
                    if kind == "response":
                        payload = _payload(fields, block)
                        n, sha, to = len(payload), digest(payload), None
                    else:  # what a revisit says of the payload that it does not hold
                        payload, to = None, number(fields.get("x-refers-to-page-id"))
                        n, sha = number(fields.get("x-payload-length")), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                    row = (number(fields.get("x-page-id")), n, sha, kind, to)
                    rows.append((*row, payload) if with_payload else row)
                    size += len(block)
                    if len(rows) >= 2000 or with_payload and size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    # one archive is read by one task
    paths = files.select("path")
    spread = paths.repartitionByRange(max(1, paths.count()), "path")
    return spread.mapInArrow(each, RESULT + ", payload binary" * with_payload)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(write(mark(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
