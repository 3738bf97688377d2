"""Media columns: payloads in tar shards, rows that carry digest, offset and length.

A payload is stored as an 8-bit greyscale PNG, 64 samples a line, so that its size and shape stand
in the first bytes.  :func:`write_shards` is the only step that sees the bytes on their way in;
what follows works on references: :func:`header_columns` reads a few bytes of each object,
:func:`payload_columns` whole objects.  An object is addressed by the digest of its stored bytes, and a
digest has one place, however many rows and tasks have the payload: a task stores what it has not
stored before, and where several have stored the same, all references go to one of them.  Only
references are shuffled for that, never payloads.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import released
from .bpe import utf8
from ..sources.scratch import arrow_fs, drop_stored, shared_dir, stored

WIDTH = 64
HEADER = 72  # bytes that hold the signature, the IHDR chunk and the length chunk
SHARD_BYTES = 1 << 30
LEVEL = 6
#: Objects that a task remembers before it starts anew.
KNOWN = 200_000
#: Stored bytes that one task reads back.
TASK_BYTES = 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
REF = "digest string, shard string, offset bigint, length bigint"


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of ``WIDTH``."""
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes, level: int = LEVEL) -> bytes:
    """PNG of the padded bytes; a private chunk keeps the unpadded length."""
    samples = np.frombuffer(padded(data), "u1").reshape(-1, WIDTH)
    raster = np.zeros((len(samples), WIDTH + 1), "u1")  # each line begins with its filter, 0
    raster[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return b"".join((
        _SIGNATURE, _chunk(b"IHDR", header), _chunk(b"ulEn", struct.pack(">Q", len(data))),
        _chunk(b"IDAT", zlib.compress(raster.tobytes(), level)), _chunk(b"IEND", b""),
    ))


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and unpadded length from the first ``HEADER`` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"ulEn":
        raise ValueError("not an object of this store")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits, struct.unpack(">Q", head[41:49])[0]


def from_png(data: bytes) -> bytes:
    """The padded payload."""
    width, height, _, _ = read_header(data[:HEADER])
    at, body = 8, []
    while at < len(data):
        size = struct.unpack(">I", data[at:at + 4])[0]
        if data[at + 4:at + 8] == b"IDAT":
            body.append(data[at + 8:at + 8 + size])
        at += 12 + size
    raster = np.frombuffer(zlib.decompress(b"".join(body)), "u1").reshape(height, width + 1)
    return raster[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, spread and an 8 x 8 average hash of the samples."""
    image = np.frombuffer(payload, "u1").reshape(-1, WIDTH)
    n = len(image)
    first = np.arange(8) * n // 8
    blocks = np.add.reduceat(image.reshape(n, 8, 8).sum(2, dtype=np.int64), first, axis=0)
    rows = np.maximum(1, np.diff(np.append(first, n)))[:, None]
    bits = np.packbits((blocks / (8 * rows) > image.mean()).ravel()).tobytes().hex()
    return f"{WIDTH}x{n} mean={image.mean():.4f} sd={image.std():.4f} hash={bits}"


class _Shards:
    """Tar files that one task writes; each attempt has its own names."""

    def __init__(self, base: str):
        self.fs, self.root = arrow_fs(base)
        self.base, self.out, self.at = base, None, 0

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            name = f"{uuid.uuid4().hex}.tar"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{name}", buffer_size=1 << 20), 0
            self.url = f"{self.base}/{name}"
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        at = self.at + 512
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        self.at = at + len(data) + -len(data) % 512
        return self.url, at

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: str | None = None) -> DataFrame:
    """Store each whole text's bytes (null: none) and return ``id_col, digest, shard, offset,
    length``.  Equal texts, in rows that repeat or not, have one reference; an empty text is one line
    of zeros; an empty table writes no shard; other columns, whatever their names, are ignored.  The
    references are written to the shared folder when this is called; shards of attempts that
    failed have names that no reference holds."""
    spark = docs.sparkSession
    base = base or shared_dir(spark, "media")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = _Shards(base), {}
        for batch in batches:
            refs = []
            for text in batch.column(1):
                text = text.as_py()
                own = hashlib.sha256(text).digest()
                if own not in known:
                    data = to_png(text)
                    digest = hashlib.sha256(data).hexdigest()
                    if len(known) == KNOWN:
                        known.clear()
                    known[own] = (digest, *shards.add(digest, data), len(data))
                refs.append(known[own])
            cols = list(zip(*refs, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                ["id", "digest", "shard", "offset", "length"],
            )
        shards.close()

    refs = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(lambda b: released(run(b)), f"id {kind}, {REF}")
    refs = stored(refs, "media-refs")
    # both sides are read from written tables and merged, so that Spark can split a hot digest
    place = stored(refs.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("at")), "media-places")
    one = refs.select("id", "digest", "length").hint("merge").join(place, "digest")
    one = stored(one.select("id", "digest", F.col("at.shard").alias("shard"), F.col("at.offset").alias("offset"), "length"), "media-refs")
    drop_stored(refs, place)
    return one.withColumnRenamed("id", id_col)


class _Reader:
    """Range reads; the last file stays open and the last range is kept, so rows in the order of
    their objects read each object once."""

    def __init__(self):
        self.url, self.file, self.last, self.data = None, None, None, b""

    def read(self, url: str, at: int, n: int) -> bytes:
        if self.last != (url, at, n):
            if self.url != url:
                if self.file:
                    self.file.close()
                fs, path = arrow_fs(url)
                self.url, self.file = url, fs.open_input_file(path)
            self.data, self.last = self.file.read_at(n, at), (url, at, n)
        return self.data


def by_object(refs: DataFrame) -> DataFrame:
    """Deal references out in ranges of objects.  The number of tasks follows the bytes they are
    to read, not the size of the references."""
    total = refs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, total // TASK_BYTES + 1, 2 * refs.sparkSession.sparkContext.defaultParallelism)
    return refs.repartitionByRange(int(n), "shard", "offset").sortWithinPartitions("shard", "offset")


def _mapped(refs: DataFrame, added: str, span: Callable[[int], int], derive: Callable[[bytes], tuple]) -> DataFrame:
    """Append columns derived from the first ``span(length)`` bytes of each object."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema) + ", " + added
    names = [f.strip().split(" ")[0] for f in added.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, value = _Reader(), None, ()
        for batch in batches:
            out = []
            for url, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if last != (url, at):
                    value, last = derive(reader.read(url, at, span(n))), (url, at)
                out.append(value)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cols)], [*batch.schema.names, *names])

    return refs.mapInArrow(lambda b: released(run(b)), schema)


def header_columns(refs: DataFrame) -> DataFrame:
    """Fill ``width, height, bits, n_bytes`` from range reads of each object's first bytes."""
    return _mapped(refs, "width bigint, height bigint, bits bigint, n_bytes bigint", lambda n: min(n, HEADER), read_header)


def payload_columns(refs: DataFrame) -> DataFrame:
    """Fill the padded payload's size, digests and a feature from the whole stored objects."""

    def derive(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).hexdigest(), feature(payload)

    return _mapped(refs, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string", lambda n: n, derive)


def members(data: bytes) -> dict[str, bytes]:
    """All members of a shard, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return {m.name: t.extractfile(m).read() for m in t}
