"""Media columns: content-addressed payloads in tar shards, read back by range.

A payload is stored as an 8-bit greyscale PNG (lossless), 576 samples wide, named by its SHA-256 in the
tar shard of the task that saw it. A shard holds a payload once; of the copies that several shards hold,
rows carry one, the same for all (the least shard and offset). Rows carry digest, shard, offset and length.
Metadata columns come from range reads of the first 33 bytes (the PNG's header); payload columns from range
reads of the stored form. Places are dealt by shard for
that, so a task opens few shards, each once, whatever the number of rows.

Shards lie in the folder that all executors share, under any file system that pyarrow opens by URI. A task
writes a shard under a name of its own and its index rows name it; rows of attempts that don't commit are
never seen, so lost executors and repeated attempts do no harm.

Cases: null and empty texts are a payload of one row of 255s. Repeated rows share a payload. No text is
shuffled; joins are on digests of 32 bytes, and copies combine to one index row before they are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import limit_batches, materialize, scratch_path

UNIT, FILLER = 576, 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
_BLOCK = 512


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes([FILLER]) * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = UNIT) -> bytes:
    """Greyscale PNG of depth 8 whose samples are the payload, in rows of `width`."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and depth from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, body = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 64-bit brightness hash: the bits tell which of 64 equal parts are brighter than the next."""
    x = np.frombuffer(payload, np.uint8)
    parts = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64)
    bits = np.packbits(parts > np.roll(parts, -1)).tobytes().hex()
    return f"{x.mean():.4f}|{x.std():.4f}|{bits}"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class _Shard:
    """A tar file that is written through; knows where each member's bytes lie."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        fs, path = file_system(self.uri)
        self.out, self.at, self.seen = fs.open_output_stream(path), 0, {}

    def put(self, digest: str, data: bytes) -> tuple[int, int]:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % _BLOCK))
        self.seen[digest] = (self.at + len(head), len(data))
        self.at += len(head) + len(data) + -len(data) % _BLOCK
        return self.seen[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * _BLOCK))
        self.out.close()


_STORED = "doc_id bigint, n_bytes bigint, digest string, shard string, at bigint, media_bytes bigint"


def store_payloads(docs: DataFrame, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; the index has a row per input row: doc_id, n_bytes, digest, shard, at, media_bytes."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "media")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("at", pa.int64()), ("media_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                shard = shard or _Shard(folder)
                place = shard.seen.get(digest) or shard.put(digest, to_png(payload))
                rows.append((doc, len(data), digest, shard.uri, *place))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if shard:
            shard.close()

    limit_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, _STORED), "media-index")


def _ranges(read):
    """Runs read(open file, at, length) over rows of (digest, shard, at, media_bytes); a shard stays open while rows name it."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    if source:
                        source.close()
                    fs, path = file_system(shard)
                    name, source = shard, fs.open_input_file(path)
                rows.append((digest, *read(source, at, length)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if source:
            source.close()

    return run


def one_place(index: DataFrame) -> DataFrame:
    """One stored copy of each digest, dealt by shard and in the order of offsets, so that a task opens few shards and reads on."""
    best = index.groupBy("digest").agg(F.min(F.struct("shard", "at", "media_bytes")).alias("p")).select("digest", "p.*")
    return best.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")


def media_metadata(places: DataFrame) -> DataFrame:
    """digest, width, height, depth from header-only range reads."""
    schema = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32())])
    run = _ranges(lambda f, at, n: png_header(f.read_at(HEADER_BYTES, at)))
    return places.select("digest", "shard", "at", "media_bytes").mapInArrow(lambda b: run(b, schema), "digest string, width int, height int, depth int")


def payload_columns(places: DataFrame) -> DataFrame:
    """What the stored bytes say: the payload's size and checksums, the stored form's digest, the feature."""
    schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def read(f, at: int, length: int) -> tuple:
        data = f.read_at(length, at)
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(data).hexdigest(), feature(payload)

    run = _ranges(read)
    return places.select("digest", "shard", "at", "media_bytes").mapInArrow(lambda b: run(b, schema), "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all payloads, reads them back and gives each row its columns."""
    index = store_payloads(docs, id_col=id_col, text_col=text_col)
    places = materialize(one_place(index), "media-places")
    known = payload_columns(places).join(media_metadata(places), "digest").join(places, "digest")
    return index.select("doc_id", "n_bytes", "digest").join(known, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", F.col("shard"), F.col("at").alias("offset"), "width", "height")
