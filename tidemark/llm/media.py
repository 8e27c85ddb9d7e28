"""Media columns: payloads in tar shards by content address; rows carry digest, shard, offset and length.

A payload is a text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, and is stored without loss
as a grey PNG image of 8 bits a sample, 576 samples a row, named by the SHA-256 of its payload. A task writes one
shard and stores each payload once in it; of payloads that several tasks met, all rows point to one place.

Nulls: a null text counts as empty (one row of 255); a null doc_id is passed through. Repeated rows point to
the same place. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, filesystem, fresh_path, id_and_text, written

SAMPLES_A_ROW = 576
FILL = 255
#: Bytes of stored payloads that one task reads back, about, and such tasks at most.
PART_BYTES, MOST_READERS = 8 << 20, 50_000
#: Bytes before the first chunk of samples: the signature and the header chunk.
HEADER_BYTES = 33
#: Fixed value: the signature of a PNG file.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text filled up to a positive multiple of SAMPLES_A_ROW."""
    return text + bytes([FILL]) * (-len(text) % SAMPLES_A_ROW if text else SAMPLES_A_ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_of(payload: bytes, level: int = 3) -> bytes:
    """A grey PNG of the payload."""
    rows = len(payload) // SAMPLES_A_ROW
    lines = np.zeros((rows, SAMPLES_A_ROW + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, SAMPLES_A_ROW)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", SAMPLES_A_ROW, rows, 8, 0, 0, 0, 0))
    packed = zlib.compress(lines.tobytes(), level)
    data = b"".join(_chunk(b"IDAT", packed[i : i + (1 << 30)]) for i in range(0, len(packed), 1 << 30))
    return PNG_SIGNATURE + head + data + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def samples_of(png: bytes) -> bytes:
    """The payload of a PNG that `png_of` made."""
    width, height, _ = png_header(png)
    at, parts = 8, []
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter other than 0")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean grey of 24 bands of 24 columns over all rows, as hexadecimal bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 24, 24)
    return (rows.sum(axis=(0, 2), dtype=np.int64) // (24 * len(rows))).astype(np.uint8).tobytes().hex()


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """Write every payload to tar shards under `path`; returns doc_id, n_bytes, digest, shard, offset, length for every row.

    A shard gets its final name when it is whole, a name of its own for every attempt; the table that is returned is
    written by Spark's committer and names only attempts that count.
    """

    def run(batches):
        system, folder = filesystem(path)
        system.create_dir(folder, recursive=True)
        name = f"media-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.tar"
        out, at = None, 0
        placed: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            texts, rows = Texts(b.column(1)), []
            for i in range(b.num_rows):
                raw = texts.row(i).tobytes()
                payload = payload_of(raw)
                digest = hashlib.sha256(payload).digest()
                if digest not in placed:
                    if out is None:
                        out = system.open_output_stream(f"{folder}/_{name}", buffer_size=1 << 20)
                    png = png_of(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.PAX_FORMAT)
                    out.write(head)
                    out.write(png)
                    out.write(bytes(-len(png) % 512))
                    placed[digest] = at + len(head), len(png)
                    at += len(head) + len(png) + -len(png) % 512
                rows.append((len(raw), digest, *placed[digest]))
            n, d, o, k = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(n, pa.int64()), "digest": pa.array(d, pa.binary()), "shard": pa.array([name] * len(n), pa.string()), "offset": pa.array(o, pa.int64()), "length": pa.array(k, pa.int64())})
        if out is not None:
            out.write(bytes(1024))
            out.close()
            system.move(f"{folder}/_{name}", f"{folder}/{name}")

    return written(id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "media-rows")


def places(rows: DataFrame) -> DataFrame:
    """One place for each digest: the first by shard and offset. Sums up within tasks first, so a hot payload is one row a task."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def media_headers(places: DataFrame, path: str) -> DataFrame:
    """digest, width, height, bits: read from the first HEADER_BYTES of each payload, no more."""

    def run(batches):
        system, folder = filesystem(path)
        files: dict = {}
        for b in batches:
            found = [png_header(_open(system, folder, s, files).read_at(HEADER_BYTES, o)) for s, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            w, h, k = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({"digest": b.column(0), "width": pa.array(w, pa.int64()), "height": pa.array(h, pa.int64()), "bits": pa.array(k, pa.int32())})

    return places.select("digest", "shard", "offset").mapInArrow(run, "digest binary, width long, height long, bits int")


def _open(system, folder: str, shard: str, files: dict):
    if shard not in files:
        if len(files) >= 16:
            files.pop(next(iter(files))).close()
        files[shard] = system.open_input_file(f"{folder}/{shard}")
    return files[shard]


def media_features(places: DataFrame, path: str) -> DataFrame:
    """What takes the whole stored bytes of each digest: sizes, digests and the feature."""
    schema = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        system, folder = filesystem(path)
        files: dict = {}
        for b in batches:
            rows = []
            for shard, offset, length in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                png = _open(system, folder, shard, files).read_at(length, offset)
                payload = samples_of(png)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch({"digest": b.column(0)} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return places.select("digest", "shard", "offset", "length").mapInArrow(run, schema)


def media_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store all documents, fill metadata columns from the stored headers, read every stored payload once, and give each row where its payload
    lies (digest, shard, offset, length) and what it holds.

    Places are dealt in the shards' order, so many to a task that each reads about PART_BYTES.
    """
    path = fresh_path(spark, "media")
    rows = store_media(docs, path)
    at = written(places(rows), "places")
    size = at.agg(F.sum("length")).first()[0] or 0
    at = at.repartitionByRange(max(1, min(MOST_READERS, size // PART_BYTES + 1)), "shard", "offset").sortWithinPartitions("shard", "offset")
    found = at.join(media_headers(at, path), "digest").join(media_features(at, path), "digest")
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").withColumn("digest", F.lower(F.hex("digest")))
