"""Helpers shared by the training-data operators: the shared folder, files in it, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The code points with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_P1 = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`; set only where unset, and then only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def for_this_run(spark: SparkSession, path: str, make: bool = False) -> str:
    """The path, of which whatever stands there goes when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        system.mkdirs(p)
    system.deleteOnExit(p)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return for_this_run(spark, f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}", make=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for_this_run(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table from which executors are asked to give their free heap back; smaller tables don't fill it.
RELEASE_BYTES = 32 << 20


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table, as the planner knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def released(df: DataFrame) -> DataFrame:
    """`df`, after executors gave the free part of their heap back to the system, by a full collection in a task for each core.

    The JVM keeps what a step let go of, up to its largest heap, and Python workers need the rest of an executor's memory. A call
    between steps costs some tenths of a second, whatever the table's size. It is a request: what stays does no harm but takes room.
    """
    spark = df.sparkSession
    if table_bytes(df) >= RELEASE_BYTES:
        cores = max(1, spark.sparkContext.defaultParallelism)
        spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    return df


def trimmed(batches):
    """The batches; at their end the memory that the worker has freed goes back to the system, as workers live on."""
    try:
        yield from batches
    finally:
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()  # Arrow's allocator keeps what was freed, too
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def filesystem(uri: str):
    """pyarrow file system and path of a URI, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def is_latin1(text: str) -> bool:
    """Whether all characters lie below U+0100, found out at the speed of a copy."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty); clashing extra columns are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ----------------------------------------------------------------------------------------------- words as hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64; grown on demand by `powers`."""
    inv = pow(base, -1, 1 << 64)
    return np.array([1, base], np.uint64), np.array([1, inv], np.uint64)


_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F}
_POWERS = {k: _tables(v) for k, v in _BASES.items()}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    up, down = _POWERS[which]
    with np.errstate(over="ignore"):
        while len(up) < n:
            k = len(up)
            bu, bd = np.uint64(pow(_BASES[which], k, 1 << 64)), np.uint64(pow(pow(_BASES[which], -1, 1 << 64), k, 1 << 64))
            up, down = np.concatenate([up, up * bu]), np.concatenate([down, down * bd])
            _POWERS[which] = up, down
    return up[:n], down[:n]


#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
WORD_BREAKS = bytes([0x20, *range(0x09, 0x0E)])

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_BREAKS)] = False
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P1))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words `[^\\x20\\x09-\\x0D]+` in UTF-8 bytes."""
    inside = _IS_WORD[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if inside[-1]:
        edge = np.concatenate([edge, [len(data)]])
    return edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]


#: Bytes, or words, that are hashed together: temporaries stay within a processor's cache.
_BLOCK = 1 << 18


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from a running polynomial sum over the bytes; words in order, block by block."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
            part = data[low : int(ends[j - 1])]
            up, down = powers(len(part) + 1, which)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE_VALUE[part] * up[: len(part)], out=total[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix64(((total[b] - total[a]) * down[a]) ^ ((b - a).astype(np.uint64) * np.uint64(_P1)))
            i = j
    return out


def run_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; the last k-1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, n, _BLOCK):
            part = words[i : i + _BLOCK + k - 1]
            up, down = powers(len(part) + 1, which)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(part * up[: len(part)], out=total[1:])
            m = len(part) - k + 1
            out[i : i + m] = mix64((total[k:] - total[:-k]) * down[:m])
    return out


class Texts:
    """The UTF-8 bytes of an Arrow string column, without a copy: `data`, and row i at `offsets[i]:offsets[i+1]`."""

    def __init__(self, column) -> None:
        import pyarrow as pa

        if hasattr(column, "combine_chunks"):
            column = column.combine_chunks()
        large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        buffers = column.buffers()
        width = np.int64 if large else np.int32
        self.offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)

    def pieces(self, most: int):
        """Runs of rows (first, last) of at most `most` bytes together, but one row at least."""
        n, i = len(self.offsets) - 1, 0
        while i < n:
            j = int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1
            j = min(max(j, i + 1), n)
            yield i, j
            i = j

    def row(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]
