"""WARC archives whose repeated payloads are revisit records.

Only headers (digest, length, id, URL) are grouped by payload digest; the original of each
repeated payload then meets the pages in a join that Spark may split where one payload is hot.
Each partition of the join writes one archive of gzip members, and archives are read back alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import utf8
from ..sources.scratch import arrow_fs, shared_dir, stored

#: Payloads below this many bytes are always stored.
SMALLEST = 1000
#: Bytes from which an archive is closed and the next begun.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[2]
    return int(page) if page else None


def record(page_id, url, payload: bytes, digest: str, refers_to=None, refers_url=None, date: str = DATE) -> bytes:
    """One record with fresh headers; with ``refers_to`` a revisit, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_line(refers_url)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END * 2 + block + _END * 2


def _line(url: str | None) -> str:
    return " ".join((url or "").split())


def members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream of blocks, inflated one by one."""
    inflate, out, some = zlib.decompressobj(31), [], False
    for block in data:
        while block:
            out.append(inflate.decompress(block))
            some = True
            block = b""
            if inflate.eof:
                yield b"".join(out)
                block, inflate, out, some = inflate.unused_data, zlib.decompressobj(31), [], False
    if some:
        raise ValueError("an archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of a record, its HTTP header and its payload."""
    head, _, rest = data.partition(_END * 2)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(_END * 2)
    return fields, http, payload


def originals(headers: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """For each digest of two or more records of at least ``smallest`` bytes, the record that is
    kept: that with the largest page id."""
    return (
        headers.where(F.col("payload_bytes") >= smallest)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n"))
        .where("n > 1 and kept.page_id is not null")
        .select(F.col("payload_digest").alias("digest"), F.col("kept.page_id").alias("refers_to"), F.col("kept.url").alias("refers_url"))
    )


def write(pages: DataFrame, base: str | None = None, smallest: int = SMALLEST, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` and return the archives: ``file, records``, each closed at
    about ``most_bytes``.  Line breaks of a url become spaces; other columns are ignored.

    A null html is an empty payload.  Equal payloads of at least ``smallest`` bytes: the row with
    the largest page id is the response, all others revisit it.  Rows that repeat that page id
    and payload are each a response; a row without a page id is never one that others revisit.
    An empty table writes no archive.  Writing happens when this is called; an attempt that fails
    leaves a file that the returned table does not name.
    """
    spark = pages.sparkSession
    base = base or shared_dir(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), utf8(html_col).alias("payload")
    ).withColumn("payload_digest", F.sha1("payload"))
    headers = rows.select("page_id", "url", "payload_digest", F.octet_length("payload").alias("payload_bytes"))
    kept = stored(originals(headers, smallest), "warc-originals")
    # written first, so that both sides of the join are plain shuffles and a hot digest can be split
    joined = rows.join(kept, rows.payload_digest == kept.digest, "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), None).otherwise(F.col("refers_to")).alias("refers_to"), "refers_url",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{base}/{name}"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and out.tell() >= most_bytes:
                    yield closed()
                    out, n = None, 0
                if out is None:
                    fs, root = arrow_fs(base)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                out.write(gzip.compress(record(*row), 3, mtime=0))
                n += 1
        if out is not None:
            yield closed()

    return stored(joined.mapInArrow(run, "file string, records bigint"), "warc-files")


def read(files: DataFrame) -> DataFrame:
    """The records of archives: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to``.  The digest and length of a response are those of the payload that was read; a
    revisit's are in its headers.  A response whose payload is not that of its header fails."""
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(url: str) -> Iterator[bytes]:
            fs, path = arrow_fs(url)
            with fs.open_input_stream(path, compression=None) as f:
                while block := f.read(1 << 18):
                    yield block

        for batch in batches:
            for url in batch.column("file").to_pylist():
                rows = []
                for member in members(blocks(url)):
                    f, http, payload = parse(member)
                    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if f["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {url} is not that of its header")
                    to = page_of(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                    rows.append((page_of(f["WARC-Record-ID"]), f["WARC-Target-URI"], size, digest, f["WARC-Type"], to))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.select("file").repartition(n).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
