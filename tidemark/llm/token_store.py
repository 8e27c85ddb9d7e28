"""Token ids on disk: each document compressed on its own with a shared zstandard dictionary, and an index for access.

A store is a folder with one `dictionary` and shard files. A shard file is

    magic (8) | SHA-256 of the dictionary (32) | one zstandard frame for each document | index | n (8) | index at (8) | magic (8)

where a frame holds ids as little-endian unsigned 32-bit integers and an index entry is doc_id (int64), has_id (int64),
offset, length and number of ids (uint64 each), 40 bytes, so one document costs three short range reads.

Order: ascending doc_id, null first; rows that share a doc_id by how their text begins, and within a shard by the text. Nulls: a null text is empty and holds
the end id alone. Empty tables give an empty store. Repeated rows are stored again. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import _classes
from tidemark.llm.common import WHITE_SPACE, filesystem, fresh_path, id_and_text, is_latin1, written

MAGIC = b"TMTOKS01"
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n", "<u8")])
#: Documents from which the dictionary is trained at most, and its size in bytes.
DICTIONARY_DOCS, DICTIONARY_BYTES = 2000, 64 << 10
#: Ids of one document that train the dictionary at most; documents count whole in everything else.
DICTIONARY_IDS = 16_384
#: Bytes of a shard that one task reads back, about, and such tasks at most.
PART_BYTES, MOST_READERS = 8 << 20, 50_000
#: Words whose ids a worker remembers, in each of two generations. It changes speed, never results.
CACHED_WORDS = 650_000

#: Fixed value: the code point after the Latin blocks, all of whose letters NFC leaves alone.
PLAIN_BEFORE = "\u0250"

_WORD = re.compile(f"[^{WHITE_SPACE}]+")


class _Known(dict):
    """Ids by piece, in two generations; pieces that neither has are noted in `new` and stand for nothing meanwhile."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            self.new.append(word)
            return b""
        self[word] = ids
        return ids

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


class WordIds:
    """Ids of texts by the tokenizers library, which sees each distinct piece of text once.

    Only for tokenizers that drop white space and whose normalizer and pre-tokenizer are those of word_bpe_49k.json: NFC,
    lower case, then contractions, runs of letters, single numbers and runs of other signs. Texts in plain Latin
    letters, which NFC leaves alone and where lower case is by the letter, are split into these pieces here; all
    others into runs without white space, of which the library makes the pieces.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = _Known()
        tokens, suffix = self.tokenizer.get_vocab(with_added_tokens=True), json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max(tokens.values()), bool)
        self.ends[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
        letter, number = _classes(0xFFFF)
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE_SPACE}{letter}{number}]+")

    def split(self, text: str) -> list[str]:
        if text and "<|" not in text and (is_latin1(text) or max(text) < PLAIN_BEFORE):
            return self.pieces.findall(text.lower())
        return _WORD.findall(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.age()
        get, new, out, holes = known.__getitem__, known.new, [], []
        for text in texts:
            words, before = self.split(text), len(new)
            out.append(b"".join(map(get, words)))
            if len(new) > before:
                holes.append((len(out) - 1, words))
        fresh = set(new)
        new.clear()
        odd = [w for w in fresh if "<|" in w]
        known.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in odd)
        plain = list(fresh.difference(odd))
        for at in range(0, len(plain), 16_384):
            known.update(self._encoded(plain[at : at + 16_384]))
        for k, words in holes:
            out[k] = b"".join(map(get, words))
        return out

    def _encoded(self, words: list[str]):
        """Each word's ids: all words as one text, cut where a token says that its piece ends there."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        edge = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        last = np.cumsum([0, *(len(self.pieces.findall(w.lower())) if max(w) < PLAIN_BEFORE else -1 for w in words)])
        if last[-1] == len(edge) - 1 and edge[-1] == len(ids) and (np.diff(last) > 0).all():
            data, cut = ids.tobytes(), (4 * edge[last]).tolist()
            return zip(words, [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True)
        return zip(words, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)), strict=True)


@lru_cache(4)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _ids(tokenizer: str, texts: Iterable[str], end_id: int, most: int = 1 << 20):
    """Ids of the texts in order, each with the end id, about a million characters at a time."""
    end, part, size = struct.pack("<I", end_id), [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield from (x + end for x in _word_ids(tokenizer)(part))
            part, size = [], 0
    yield from (x + end for x in _word_ids(tokenizer)(part))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from the serialized ids of DICTIONARY_DOCS documents with the lowest hashed ids."""
    import zstandard

    picked = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(DICTIONARY_DOCS).select("doc_id")
    rows = docs.join(F.broadcast(picked.distinct()), "doc_id", "left_semi").select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def run(batches):
        for b in batches:
            for x in _ids(tokenizer, b.column(1).to_pylist(), end_id):
                yield pa.record_batch({"ids": pa.array([x[: 4 * DICTIONARY_IDS]], pa.binary())})

    samples = sorted(bytes(r.ids) for r in rows.select("h", "text").mapInArrow(run, "ids binary").limit(4 * DICTIONARY_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: frames then go without
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """Write the store at `path`; returns its shards: shard, number (their order), first, has_first, n_docs, n_tokens, n_bytes.

    Rows are dealt by ranges of doc_id and text, so each task writes one contiguous stretch, also of rows that share an id or have none. A file gets its final name only
    when it is whole, under a name of its own for every attempt; the returned table names those that count.
    """
    rows = id_and_text(docs)
    trained = train_dictionary(rows, tokenizer, end_id)
    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/dictionary") as f:
        f.write(trained)

    def run(batches):
        import zstandard

        extra = {"dict_data": _dictionary(trained)} if trained else {}
        compressor = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False, **extra)
        system, folder = filesystem(path)
        out, name, entries, n_tokens, at = None, f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", [], 0, 40
        for b in batches:
            texts = (x.as_py() for x in b.column(1))
            for doc_id, x in zip(b.column(0).to_pylist(), _ids(tokenizer, texts, end_id), strict=True):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/_{name}", buffer_size=1 << 20)
                    out.write(MAGIC + hashlib.sha256(trained).digest())
                frame = compressor.compress(x)
                out.write(frame)
                entries.append((doc_id or 0, doc_id is not None, at, len(frame), len(x) // 4))
                at += len(frame)
                n_tokens += len(x) // 4
        if out is not None:
            index = np.array(entries, ENTRY)
            out.write(index.tobytes())
            out.write(struct.pack("<QQ", len(index), at) + MAGIC)
            out.close()
            system.move(f"{folder}/_{name}", f"{folder}/{name}")
            yield pa.record_batch({"shard": [name], "number": pa.array([TaskContext.get().partitionId()], pa.int64()), "first": pa.array([entries[0][0]], pa.int64()), "has_first": [bool(entries[0][1])], "n_docs": pa.array([len(entries)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()), "n_bytes": pa.array([at], pa.int64())})

    # rows that share an id are dealt by how their text begins, and equal ones by where they were
    keyed = rows.withColumns({"begin": F.substring("text", 1, 64), "origin": F.spark_partition_id()})
    dealt = keyed.repartitionByRange("doc_id", "begin", "origin").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return written(dealt.mapInArrow(run, "shard string, number long, first long, has_first boolean, n_docs long, n_tokens long, n_bytes long"), "shards")


class Shard:
    """One shard file, read through its index."""

    def __init__(self, path: str, shard: str) -> None:
        system, folder = filesystem(path)
        with system.open_input_stream(f"{folder}/dictionary") as f:
            data = f.read()
        self.file = system.open_input_file(f"{folder}/{shard}")
        head, tail = self.file.read_at(40, 0), self.file.read_at(24, self.file.size() - 24)
        if head[:8] != MAGIC or tail[16:] != MAGIC or head[8:] != hashlib.sha256(data).digest():
            raise ValueError(f"{shard} isn't whole, or belongs to another dictionary")
        n, at = struct.unpack("<QQ", tail[:16])
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), ENTRY)
        import zstandard

        self.decompressor = zstandard.ZstdDecompressor(**({"dict_data": _dictionary(data)} if data else {}))

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document, as stored."""
        entry = self.index[k]
        return self.decompressor.decompress(self.file.read_at(int(entry["length"]), int(entry["offset"])))

    def between(self, since: int, until: int):
        """doc_id, ids of the documents since to until (exclusive) in order, read some MB at a time."""
        k, n = since, min(until, len(self.index))
        ends = self.index["offset"] + self.index["length"]
        while k < n:
            begin = int(self.index["offset"][k])
            stop = min(n, max(k + 1, int(np.searchsorted(ends, begin + (4 << 20), "right"))))
            data = self.file.read_at(int(ends[stop - 1]) - begin, begin)
            for e in self.index[k:stop]:
                at = int(e["offset"]) - begin
                yield (int(e["doc_id"]) if e["has_id"] else None), self.decompressor.decompress(data[at : at + int(e["length"])])
            k = stop

    def __iter__(self):
        return self.between(0, len(self.index))


def read_store(shards: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on wish, ids, from the files.

    One row for each shard goes through a single task to sum up where shards begin. Shards are read in parts of about PART_BYTES, each
    a task's, so that tasks are as many as the files' bytes ask for.
    """
    before = F.sum("n_tokens").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    begun = shards.select("shard", "n_docs", F.coalesce(before, F.lit(0)).alias("start"), F.ceil(F.col("n_bytes") / PART_BYTES).cast("long").alias("parts"))
    begun = written(begun.select("shard", "n_docs", "start", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "starts")
    begun = begun.repartitionByRange(max(1, min(begun.count(), MOST_READERS)), "shard", "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for b in batches:
            for shard, _, start, parts, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, file = [], Shard(path, shard)
                # documents by where they begin
                size = int(file.index["length"].sum()) / parts
                since, until = np.searchsorted(file.index["offset"] - 40, [part * size, (part + 1) * size]).tolist()
                until = until if part < parts - 1 else len(file.index)
                start += int(file.index["n"][:since].sum())

                def batch(rows):
                    cols = list(zip(*rows, strict=True))
                    made = {"doc_id": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "n_tokens": pa.array(cols[2], pa.int64()), "ids_crc32": pa.array(cols[3], pa.int64())}
                    return pa.record_batch(made | ({"ids": pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cols[4]], pa.list_(pa.int64()))} if with_ids else {}))

                for doc_id, x in file.between(since, until):
                    rows.append((doc_id, start, len(x) // 4, zlib.crc32(x), x if with_ids else None))
                    start += len(x) // 4
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return begun.mapInArrow(run, schema)


def token_store_report(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write every document's ids, read all files back, and report what they hold."""
    path = fresh_path(spark, "tokens")
    return read_store(write_store(docs, tokenizer, end_id, path), path)
