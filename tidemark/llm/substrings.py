"""Removal of repeated passages: windows of 20 words that start earlier elsewhere, by super-k-mer partitioning.

Each window of consecutive words has a minimiser: the least, in a hashed order, of its runs of MINIMISER words.
Consecutive windows that share the place of their minimiser travel as one packed string (a super-k-mer) to the bucket of the
minimiser's hash. Equal windows have equal minimisers, so a bucket holds all copies of its windows; sorting the
bucket's windows finds, exactly, each window's first place and all later ones. What is found comes back as spans of
words, which are cut out of the whole texts.

A map task first looks for copies within what it has at hand, and sends on only the first of them: of a passage that
a third of all documents share, a bucket gets one copy for each piece of a map task, not one for each document.
Runs of words that a sample shows to be very frequent come last in the order of minimisers, so that no bucket
gathers all windows around them. Where a passage consists of such runs only, its windows are dealt to several tasks first, which
send on the first copies, so a passage that every map task meets isn't read by one task. A task that has gathered much of one bucket
reduces it to first copies before it reads on. The sample moves work between tasks and can't change a result.

Order of documents: ascending doc_id, null last; rows that share a doc_id but not the text by a digest of the text.
A document is its doc_id and, where rows of one doc_id differ in their text, 120 bits of the text's MD5; such doc_ids are found out first,
and elsewhere nothing but the doc_id travels. Rows that are equal in doc_id and text are one document and get equal
results. A null or empty text has no words. Texts with fewer words than a window lose nothing. Empty tables give empty
results. Other columns are kept as they are, also those named like what is added.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Texts, mix64, run_hashes, trimmed, word_hashes, word_spans, written

#: Words of a window and of the runs that are its minimisers.
WINDOW, MINIMISER = 20, 3
#: Bytes of text that a map task looks at together, and packed bytes it holds back before it sends them on.
PIECE_BYTES, HELD_BYTES = 3 << 20, 24 << 20
#: Packed bytes that a bucket is meant to hold.
BUCKET_BYTES = 6 << 20
#: Documents, about, in the sample for frequent runs, and the share of sampled windows that makes a run frequent.
SAMPLE_DOCS, FREQUENT_SHARE = 4000, 1 / 2000

#: Bytes of super-k-mers of one bucket that a task gathers before it reduces them to first copies.
GATHERED_BYTES = 64 << 20
#: Tasks, for each bucket, among which windows of frequent runs only are dealt first.
SALTS = 64
#: Ids whose rows differ in their text, up to which they are broadcast (16 bytes each); beyond, all documents carry a digest.
AMBIGUOUS_IDS = 200_000

_HEAD = np.dtype([("doc", "<i8"), ("null", "<i8"), ("hi", "<i8"), ("lo", "<i8"), ("start", "<i8"), ("words", "<i4"), ("bytes", "<i4")])
#: What names a document: id (0 for null), whether it is null, and a digest in two halves (0 where the id is enough).
_NAME = ["doc", "null", "hi", "lo"]
#: How the heads of super-k-mers travel: field after field, documents as differences; `bytes` follows from the words.
_TRAVEL = {"doc": "<i8", "null": "<i1", "hi": "<i8", "lo": "<i8", "start": "<i4", "words": "<u2"}


def normal(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words each followed by one space: the bytes, each word's start and end in them, and its start in `data`.

    `data` must end with white space.
    """
    raw = np.frombuffer(data, np.uint8)
    begin, end = word_spans(raw)
    size = end - begin
    stop = np.cumsum(size + 1)
    start = stop - size - 1
    keep = np.zeros(len(raw) + 1, np.int8)
    np.add.at(keep, begin, 1)
    np.add.at(keep, end + 1, -1)
    out = raw[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)].copy()
    out[stop - 1] = 0x20
    return out, start, stop - 1, begin


def sliding_min_place(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each `width` consecutive ones, the leftmost of equals; by doubling."""
    n = len(values) - width + 1
    place = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        span += step
    return place[:n]


class Windows:
    """All windows of words within a list of stretches (documents or super-k-mers), in the documents' order.

    `buffer` holds the words, each followed by a space; stretch s has the words first[s] to first[s+1], and its first
    word is word `start[s]` of the document that heads[s] names.
    """

    def __init__(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, heads: np.ndarray) -> None:
        self.buffer, self.begin, self.end, self.first, self.heads = buffer, begin, end, first, heads
        self.words = word_hashes(buffer, begin, end)
        counts = np.maximum(np.diff(first) - WINDOW + 1, 0)
        self.stretch = np.repeat(np.arange(len(heads)), counts)
        inner = np.arange(len(self.stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = first[:-1][self.stretch] + inner  # index of the first word, for each window
        self.start = heads["start"][self.stretch] + inner  # the same within the document
        self.hash = run_hashes(self.words, WINDOW)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def later_copies(self) -> np.ndarray:
        """Whether each window's words also start at an earlier place."""
        n = len(self.at)
        later = np.zeros(n, bool)
        if not n:
            return later
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        if new.all():
            return later
        group = np.cumsum(new) - 1
        again = order[~new]
        first = order[new][group[~new]]
        if not self._equal(again, first):  # two sequences of words with one hash: by the words themselves
            text = self.buffer.tobytes()
            known: dict[bytes, int] = {}
            first = np.array([known.setdefault(text[self.begin[a] : self.end[a + WINDOW - 1]], i) for i, a in enumerate(self.at.tolist())])
            again = np.arange(n)
        heads = self.heads
        a, b = self.stretch[again], self.stretch[first]
        same = self.start[again] == self.start[first]
        for k in _NAME:
            same &= heads[k][a] == heads[k][b]
        later[again[~same]] = True
        return later

    def _equal(self, again: np.ndarray, first: np.ndarray) -> bool:
        """Whether the windows are equal word for word to those they are taken for; runs of pairs are compared at once."""
        order = np.argsort(again, kind="stable")
        p, q = again[order], first[order]
        if len(p) == 0:
            return True
        joined = (np.diff(p) == 1) & (np.diff(q) == 1) & (np.diff(self.stretch[p]) == 0) & (np.diff(self.stretch[q]) == 0)
        head = np.flatnonzero(np.concatenate([[True], ~joined]))
        last = np.concatenate([head[1:], [len(p)]]) - 1
        a, b = self.begin[self.at[p[head]]].tolist(), self.end[self.at[p[last]] + WINDOW - 1].tolist()
        c, d = self.begin[self.at[q[head]]].tolist(), self.end[self.at[q[last]] + WINDOW - 1].tolist()
        text = self.buffer.tobytes()
        return all(text[i:j] == text[k:m] for i, j, k, m in zip(a, b, c, d, strict=True))

    def spans(self, chosen: np.ndarray) -> pa.RecordBatch | None:
        """The words that the chosen windows cover, as spans of each document."""
        p = np.flatnonzero(chosen)
        if not len(p):
            return None
        s = self.stretch[p]
        cut = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(s) != 0)])
        head = np.flatnonzero(cut)
        last = np.concatenate([head[1:], [len(p)]]) - 1
        heads = self.heads[s[head]]
        return _rows(heads, self.start[p[head]], self.start[p[last]] + WINDOW)

    def stretches(self, p: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, list[int], list[int], np.ndarray]:
        """The windows p as super-k-mers: runs of windows that follow each other (and share the place of their minimiser).

        Returns heads, where each one's bytes begin and end in the buffer, and its first window's number in p.
        """
        s = self.stretch[p]
        new = (np.diff(p) != 1) | (np.diff(s) != 0)
        if place is not None:
            new |= np.diff(place) != 0
        head = np.flatnonzero(np.concatenate([[True], new])) if len(p) else np.zeros(0, np.int64)
        last = np.concatenate([head[1:], [len(p)]]).astype(np.int64)[: len(head)] - 1
        heads = self.heads[s[head]].copy()
        heads["start"] = self.start[p[head]]
        heads["words"] = last - head + WINDOW
        begin, end = self.begin[self.at[p[head]]], self.end[self.at[p[last]] + WINDOW - 1] + 1
        heads["bytes"] = end - begin
        return heads, begin, end, head


_SPAN = [*_NAME, "since", "until"]
_SCHEMA = pa.schema([("bucket", pa.int64()), ("salt", pa.int64()), ("pack", pa.binary()), *((c, pa.int64()) for c in _SPAN)])
_DDL = "bucket long, salt long, pack binary, " + ", ".join(f"{c} long" for c in _SPAN)


def _rows(heads: np.ndarray, since: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
    """Spans as rows of the map stage: dealt by the document, with no pack."""
    n = len(heads)
    with np.errstate(over="ignore"):
        bucket = pa.array(-1 - (mix64(heads["hi"].astype(np.uint64) + mix64(heads["doc"].astype(np.uint64))) >> np.uint64(1)).astype(np.int64))
    cols = [bucket, pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary()), *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in (*(heads[k] for k in _NAME), since, until))]
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def _packs(names: list[tuple[int, int]], packs: list[bytes]) -> pa.RecordBatch:
    """Packs as rows, by bucket and salt."""
    n = len(names)
    cols = [pa.array([k for k, _ in names], pa.int64()), pa.array([s for _, s in names], pa.int64()), pa.array(packs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in _SPAN)]
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def _documents(b: pa.RecordBatch, most: int):
    """Pieces of a batch (doc, null, hi, lo, text), sorted: Windows over whole documents."""
    texts = Texts(b.column(4))
    names = {k: np.asarray(b.column(i)) for i, k in enumerate(_NAME)}
    for i, j in texts.pieces(most):
        order = i + np.lexsort([names[k][i:j] for k in ("lo", "hi", "doc", "null")])
        raw = [texts.row(r).tobytes() for r in order]
        size = np.array([len(x) + 1 for x in raw])
        buffer, begin, end, at = normal(b" ".join(raw) + b" ")
        first = np.searchsorted(at, np.concatenate([[0], np.cumsum(size)]))
        heads = np.zeros(len(order), _HEAD)
        for k in _NAME:
            heads[k] = names[k][order]
        yield Windows(buffer, begin, end, first, heads)


def _minimisers(w: Windows, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and ordering value of each window's minimiser; frequent runs come last."""
    runs = run_hashes(w.words, MINIMISER, 1)
    value = runs >> np.uint64(1)
    if len(frequent):
        value |= np.isin(runs, frequent).astype(np.uint64) << np.uint64(63)
    place = sliding_min_place(value, WINDOW - MINIMISER + 1)[w.at]
    return place, value[place]


def _raw_pack(heads: np.ndarray, words: bytes) -> bytes:
    fields = [np.diff(heads[k], prepend=0) if k == "doc" else heads[k] for k in _TRAVEL]
    parts = [x.astype(t).tobytes() for x, t in zip(fields, _TRAVEL.values(), strict=True)]
    return b"".join([struct.pack("<q", len(heads)), *parts, words])


def _packed(heads: np.ndarray, words: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=4).compress(_raw_pack(heads, words))


def _unpacked(pack: bytes) -> tuple[np.ndarray, bytes]:
    (n,) = struct.unpack_from("<q", pack)
    heads, at = np.zeros(n, _HEAD), 8
    for k, t in _TRAVEL.items():
        x = np.frombuffer(pack, t, n, at)
        heads[k] = np.cumsum(x) if k == "doc" else x
        at += x.nbytes
    words = pack[at:]
    stop = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20) + 1
    ends = stop[np.cumsum(heads["words"], dtype=np.int64) - 1]
    heads["bytes"] = np.diff(ends, prepend=0)
    return heads, words


def named_documents(rows: DataFrame, text, own) -> DataFrame:
    """The rows with doc, null, hi and lo: what names each one's document.

    hi and lo hold a digest of the text only for ids under which different texts stand. These ids are counted first; few are broadcast, and
    of many it's simpler that every row carries its digest.
    """
    digest = F.md5(text)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    ids = {"doc": F.coalesce(own.cast("long"), F.lit(0)), "null": own.isNull().cast("long")}
    seen = rows.select(*[c.alias(k) for k, c in ids.items()], half(1).alias("hi"), half(17).alias("lo")).groupBy("doc", "null")
    seen = seen.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("hi", "lo") for f in (F.min, F.max)])
    shared = written(seen.where("min_hi <> max_hi OR min_lo <> max_lo").select("doc", "null"), "shared-ids")
    n = shared.limit(AMBIGUOUS_IDS + 1).count()
    rows = rows.withColumns(ids)
    if not n:
        return rows.withColumns({"hi": F.lit(0).cast("long"), "lo": F.lit(0).cast("long")})
    if n > AMBIGUOUS_IDS:
        return rows.withColumns({"hi": half(1), "lo": half(17)})
    marked = rows.join(F.broadcast(shared.withColumn("_shared", F.lit(True))), ["doc", "null"], "left")
    return marked.withColumns({k: F.when(F.col("_shared"), half(at)).otherwise(F.lit(0)) for k, at in (("hi", 1), ("lo", 17))}).drop("_shared")


def frequent_runs(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that are the minimiser of at least FREQUENT_SHARE of a sample's windows, at most 1 / FREQUENT_SHARE; and of those
    that still are when the former come last."""
    n = rows.count()
    sampled = rows.where(F.pmod(F.xxhash64("doc", "hi"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)

    def counted(last: np.ndarray) -> np.ndarray:
        def count(batches):
            for b in batches:
                for w in _documents(b, PIECE_BYTES):
                    if len(w.at):
                        place, _ = _minimisers(w, last)
                        v, c = np.unique(run_hashes(w.words, MINIMISER, 1)[place], return_counts=True)
                        many = c >= max(2, FREQUENT_SHARE * len(place) / 4)
                        yield pa.record_batch({"run": pa.array(v[many].astype(np.int64)), "n": pa.array(c[many]), "all": pa.array(np.where(np.arange(int(many.sum())) == 0, len(place), 0))})

        found = sampled.mapInArrow(lambda batches: trimmed(count(batches)), "run long, n long, all long").groupBy("run").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
        found = found.orderBy(F.desc("n"), "run").limit(int(1 / FREQUENT_SHARE)).collect()
        total = sum(r["all"] for r in found)
        return np.sort(np.array([r["run"] for r in found if r["n"] >= FREQUENT_SHARE * total], np.int64).astype(np.uint64))

    frequent = counted(np.zeros(0, np.uint64))
    return frequent, counted(frequent) if len(frequent) else frequent


def _counted(packs: list, again: bool) -> tuple[pa.RecordBatch | None, bytes | None]:
    """The spans of later copies among some packs of a bucket, and again: what is left, in one pack."""
    heads, words = [], []
    for x in packs:
        head, text = _unpacked(x)
        heads.append(head)
        words.append(text)
    heads, text = np.concatenate(heads), b"".join(words)
    from_ = np.cumsum(heads["bytes"], dtype=np.int64) - heads["bytes"]
    order = np.lexsort([heads[k] for k in ("start", "lo", "hi", "doc", "null")])
    heads = heads[order]
    buffer = np.frombuffer(b"".join([text[a : a + n] for a, n in zip(from_[order].tolist(), heads["bytes"].tolist(), strict=True)]), np.uint8)
    end = np.flatnonzero(buffer == 0x20)
    begin = np.concatenate([[0], end[:-1] + 1])
    first = np.concatenate([[0], np.cumsum(heads["words"], dtype=np.int64)])
    w = Windows(buffer, begin, end, first, heads)
    later = w.later_copies()
    if not again:
        return w.spans(later), None
    heads, begin, end, _ = w.stretches(np.flatnonzero(~later))
    text = buffer.tobytes()
    return w.spans(later), _raw_pack(heads, b"".join([text[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans of words (doc, null, hi, lo, since, until) that windows with an earlier copy cover; rows: doc, null, hi, lo, text."""
    frequent, crowded = frequent_runs(rows)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(16, min(1 << 24, 6 * size // BUCKET_BYTES))
    gathered_most = GATHERED_BYTES

    def pack(batches):
        held: dict[tuple[int, int], list] = {}
        weight = 0

        def sent():
            names = sorted(held)
            packs = [_packed(np.concatenate([h for h, _ in held[k]]), b"".join(x for _, x in held[k])) for k in names]
            held.clear()
            return _packs(names, packs)

        for b in batches:
            for w in _documents(b, PIECE_BYTES):
                if not len(w.at):
                    continue
                later = w.later_copies()
                found = w.spans(later)
                if found is not None:
                    yield found
                p = np.flatnonzero(~later)
                place, value = _minimisers(w, frequent)
                place = place[p]
                heads, begin, end, head = w.stretches(p, place)
                bucket = (mix64(value[p[head]]) % np.uint64(buckets)).astype(np.int64)
                hot = np.isin(run_hashes(w.words, MINIMISER, 1)[place[head]], crowded)
                salt = np.where(hot, 1 + (mix64(heads["doc"].astype(np.uint64) ^ heads["hi"].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                order = np.lexsort((salt, bucket))
                text = w.buffer.tobytes()
                names = np.stack([bucket, salt], 1)[order]
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(names, axis=0) != 0).any(axis=1)])).tolist()
                begin, end, heads = begin[order].tolist(), end[order].tolist(), heads[order]
                for i, j in zip(edge, [*edge[1:], len(names)], strict=True):
                    held.setdefault((int(names[i, 0]), int(names[i, 1])), []).append((heads[i:j], b"".join([text[x:y] for x, y in zip(begin[i:j], end[i:j], strict=True)])))
                weight += int(heads["bytes"].sum()) + heads.nbytes
                if weight >= HELD_BYTES:
                    yield sent()
                    weight = 0
        if held:
            yield sent()

    def count(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        now, packs, weight, most = None, [], 0, gathered_most
        for b in batches:
            own = b.column(2).is_valid()
            spans = b.filter(pc.invert(own))
            if spans.num_rows:
                yield spans
            sent = b.filter(own)
            for k, salt, x in zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), sent.column(2), strict=True):
                if (k, salt) != now and packs:
                    yield from done(now, packs)
                    packs, weight, most = [], 0, gathered_most
                now = k, salt
                packs.append(z.decompress(x.as_buffer()))
                weight += len(packs[-1])
                if weight > most and len(packs) > 1:
                    found, left = _counted(packs, True)
                    packs = [left]
                    weight, most = len(left), max(most, 2 * len(left))
                    if found is not None:
                        yield found
        if packs:
            yield from done(now, packs)

    def done(name, packs):
        import zstandard

        found, left = _counted(packs, name[1] > 0)
        if found is not None:
            yield found
        if left is not None:
            yield _packs([(name[0], 0)], [zstandard.ZstdCompressor(level=4).compress(left)])

    packed = rows.mapInArrow(lambda batches: trimmed(pack(batches)), _DDL)
    spans = packed.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(lambda batches: trimmed(count(batches)), _DDL)
    if len(crowded):  # what was dealt by salt meets again, and there is one place for each bucket
        spans = spans.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: trimmed(count(batches)), _DDL)
    return spans.select(*_SPAN)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with whole texts cut: all its columns, then kept_text, n_words and n_removed (also where a column has one of these names)."""
    n = len(docs.columns)
    inner = [f"_{i}" for i in range(n)]
    named = docs.toDF(*inner)
    text, own = (F.col(inner[docs.columns.index(c)]) for c in (text_col, id_col))
    named = named_documents(named, F.coalesce(text.cast("string"), F.lit("")), own)
    spans = repeated_spans(named.select(*_NAME, F.coalesce(text.cast("string"), F.lit("")).alias("text")))
    by_doc = spans.groupBy(*_NAME).agg(F.collect_set(F.struct("since", "until")).alias("spans"))
    joined = named.join(by_doc, _NAME, "left").select(*inner, "spans")
    at = docs.columns.index(text_col)
    added = [T.StructField("_kept_text", T.StringType()), T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())]
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(inner, docs.schema.fields, strict=True)], *added])

    def cut(batches):
        for b in batches:
            spans = b.column(n)
            ends = np.asarray(spans.offsets)
            pairs = spans.values
            since, until = (np.asarray(pairs.field(i)) for i in (0, 1))
            texts, kept, words, removed = Texts(b.column(at).cast(pa.string())), [], [], []
            for i in range(b.num_rows):
                raw = texts.row(i)
                begin, end = word_spans(raw)
                keep = np.ones(len(begin) + 1, np.int64)
                lo, hi = ends[i], ends[i + 1]
                if hi > lo:
                    depth = np.zeros(len(begin) + 1, np.int64)
                    np.add.at(depth, since[lo:hi], 1)
                    np.add.at(depth, until[lo:hi], -1)
                    keep = np.cumsum(depth) == 0
                left = np.flatnonzero(keep[: len(begin)])
                data = raw.tobytes()
                kept.append(b" ".join([data[x:y] for x, y in zip(begin[left].tolist(), end[left].tolist(), strict=True)]).decode())
                words.append(len(begin))
                removed.append(len(begin) - len(left))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(kept, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=[f.name for f in schema])

    return joined.mapInArrow(lambda batches: trimmed(cut(batches)), schema).toDF(*docs.columns, "kept_text", "n_words", "n_removed")
