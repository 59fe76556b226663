"""Media columns: content-addressed payloads in tar shards.

A row of the media table carries no payload, only its address: digest, shard, offset and length.  Each task
packs its payloads into tar shards in the shared folder and stores a payload it has met before only once
(`digest` names the tar member).  A shard gets a name of its own for every attempt, and only rows of attempts
that Spark commits reach the manifest, so a lost executor or a second attempt leaves at most a shard that no
row points at.  Nothing is shuffled: equal payloads of different tasks have equal digests and equal bytes, and
lie once in each of those tasks' shards; `compact()` gives each digest one address where that is wanted.

Payloads are 8-bit grey samples, 64 to a line, in PNG: lossless, and readable by any image tool.  Metadata
columns come from range reads of the 33 header bytes alone; samples are read only when features are asked for.

Null text is an empty payload, which is stored as one line of zeros.  Repeated rows share a payload.  Extra
columns are ignored.  An empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import Scratch, with_clear_names

WIDTH = 64
SHARD_BYTES = 64 << 20
STRETCH, READ_BYTES = 2 << 20, 128 << 20  # of stored payloads: what is read in one go, and by one task at most
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # the signature and the IHDR chunk


def pad(payload: bytes, unit: int = WIDTH) -> bytes:
    """Zeros up to a positive multiple of unit."""
    return payload + b"\0" * ((-len(payload)) % unit if payload else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey 8-bit PNG; every line is stored unfiltered."""
    lines = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    raw = np.zeros((len(lines), width + 1), dtype=np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    """What the first HEADER bytes tell."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG of this store")
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head[16:29])
    if zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("damaged header")
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 6: 4}[colour]}


def decode_png(stored: bytes) -> bytes:
    """The samples of a PNG that encode_png() wrote."""
    at, body, width = 8, [], read_header(stored[:HEADER])["width"]
    while at < len(stored):
        size, kind = struct.unpack(">I", stored[at : at + 4])[0], stored[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + size])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered lines")
    return raw[:, 1:].tobytes()


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return (pafs.LocalFileSystem(), root) if root.startswith("/") else pafs.FileSystem.from_uri(root)


class ShardWriter:
    """Appends members to tar shards and tells where each body lies."""

    def __init__(self, root: str, limit: int = SHARD_BYTES):
        self.fs, self.base = _store(root)
        self.limit, self.out, self.name, self.size = limit, None, "", 0
        self.fs.create_dir(self.base, recursive=True)

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self.out is None or self.size > self.limit:
            self.close()
            self.name, self.size = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(body)
        self.out.write(b"\0" * (-len(body) % 512))
        at = self.size + len(head)
        self.size = at + len(body) + (-len(body) % 512)
        return self.name, at, len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


MANIFEST = "doc_id long, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"


def write_shards(docs: DataFrame, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores each text's payload under root; one manifest row a document.  Not yet run: write the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seen = None, {}
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"")
                payload = pad(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    writer = writer or ShardWriter(root, shard_bytes)
                    seen[digest] = writer.add(f"{digest}.png", encode_png(payload))
                rows.append((doc, len(raw), len(payload), digest, *seen[digest]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)], names)
        if writer:
            writer.close()

    return with_clear_names(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, MANIFEST)


def compact(manifest: DataFrame) -> DataFrame:
    """The manifest with one address for each digest: the first by shard and offset."""
    one = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return manifest.drop("shard", "offset", "length").join(one, "digest").select(*[c for c in manifest.columns if c not in ("shard", "offset", "length")], "at.*")


def by_bytes(manifest: DataFrame) -> DataFrame:
    """The manifest dealt out by stored bytes, each task's rows in the order of their shards.

    Addresses are cumulative, so an address divided by STRETCH tells which stretch of its shard a row is in; stretches go
    to tasks of READ_BYTES or less, and to some for every core.  Only rows of the manifest move.
    """
    total = manifest.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // READ_BYTES), 4 * manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(tasks, "shard", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("shard", "offset")


def _ranges(batch: pa.RecordBatch, root: str, size: int | None):
    """The stored bytes of each row, or their first size bytes; rows of a shard share one open file."""
    fs, base = _store(root)
    name, handle = None, None
    for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
        if shard != name:
            if handle:
                handle.close()
            name, handle = shard, fs.open_input_file(f"{base}/{shard}")
        yield handle.read_at(min(size or length, length), offset)
    if handle:
        handle.close()


def fill_metadata(manifest: DataFrame, root: str) -> DataFrame:
    """Adds width, height, bit_depth and channels, from range reads of the headers alone."""
    kinds = {"width": pa.int32(), "height": pa.int32(), "bit_depth": pa.int32(), "channels": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_header(x) for x in _ranges(batch, root, HEADER)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([h[k] for h in heads], t) for k, t in kinds.items()]], [*batch.schema.names, *kinds])

    return manifest.mapInArrow(run, MANIFEST + "".join(f", {k} int" for k in kinds))


def feature(samples: bytes, width: int = WIDTH) -> str:
    """Size, mean, deviation, entropy in bits, and a 64-bit difference hash of the mean of each of 64 x 9 cells' columns."""
    lines = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(lines, minlength=256) / len(lines)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    edges = np.linspace(0, len(lines), 66).astype(np.int64)
    total = np.append(0, np.cumsum(lines, dtype=np.int64))
    means = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(edges[1:] - edges[:-1], 1)
    bits = int("".join("1" if b else "0" for b in means[1:] > means[:-1]), 2)
    return f"{width}x{len(lines) // width};mean={lines.mean():.4f};sd={lines.std():.4f};entropy={entropy:.4f};dhash={bits:016x}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width int, height int"


def read_features(manifest: DataFrame, root: str) -> DataFrame:
    """Reads each stored payload back and describes what was read; a payload whose digest differs is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in FEATURES.split(", ")))
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]
        known: dict[tuple, tuple] = {}
        for batch in batches:
            rows = []
            for at, stored in zip(batch.to_pylist(), _ranges(batch, root, None)):
                if (key := (at["shard"], at["offset"])) not in known:
                    samples = decode_png(stored)
                    digest = hashlib.sha256(samples).hexdigest()
                    if digest != at["digest"]:
                        raise ValueError(f"{at['shard']}: the bytes at {at['offset']} are not those of {at['digest']}")
                    known[key] = (len(samples), digest, zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples))
                    if len(known) > 10_000:
                        known = {key: known[key]}
                size, digest, tail, media, media_digest, told = known[key]
                rows.append((at["doc_id"], at["n_bytes"], size, digest, tail, media, media_digest, told, at["shard"], at["offset"], at["width"], at["height"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.mapInArrow(run, FEATURES)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    root = f"{scratch.root}/shards"  # the rows that are returned point into it, so it stays
    manifest = scratch.save(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), root), "manifest")
    return read_features(fill_metadata(by_bytes(manifest), root), root)
