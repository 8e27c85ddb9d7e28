"""Near-duplicate groups by n-gram Jaccard similarity: a universe-partition pigeonhole join.

A document's set holds its distinct word shingles. Two sets whose similarity is at least t differ in at most
(1-t)/(1+t) * (|A| + |B|) elements. So for each band of sizes the universe of shingles is dealt by hash into more
segments than two similar sets can differ in, and similar sets agree on some segment: each set is indexed by a hash of
its subset in each segment, and sets that meet at a hash are compared exactly.

Allocation by cost. A segment may count 0 (left out: it is empty, or too many sets share its subset), 1 (its subset
is indexed) or 2 (two segments taken together, indexed by their subset and by all subsets with one element less, so a
difference of one is found too). A set is served when the counts of its segments exceed the differences it may have to
any partner; empty segments are left out beforehand, for there are some to spare. A sample of sets shows for each
band whether counts of 1 or 2 come cheaper.

Exactness in spite of hot segments, in three rounds, each of which knows the components (by links) that the one before has found.

1. In each group of sets that meet at a hash, each set is paired with the group's first one only. These stars join the members of
   a group of near copies, however many they are, with rows as many as index entries. Groups of up to SMALL_GROUP sets are
   kept as lists, each list once, and of these only pairs across components are compared. In larger groups the segment counts 0.
2. A set whose other segments no longer exceed its differences is *hard*. Hard sets are indexed again in a finer universe,
   about one element to a segment, so that what many sets share takes up few segments. A group within one component counts in
   full, for its pairs are joined already; so does one of which at most SMALL_GROUP sets lie outside its largest component: all its pairs
   across components are compared.
3. Sets that are still hard, with nearly nothing of their own, are indexed with their empty segments, and all pairs across components that
   meet and that sketches (see `sketches`) don't rule out are compared; a large group is split into blocks of rows for several tasks.

A link between two sets is found in the round in which either is served, or in the last. Of candidates, each set is first compared with one
partner; then only pairs across components remain, and of these only pairs whose sketches don't rule them out.

Sets that are equal are one class from the start (by a 128-bit hash of the sorted 64-bit hashes of shingles). Words are
`[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; with fewer words than a shingle the whole sequence is one.

Nulls: a null or empty text has an empty set and is linked with nothing. A null doc_id is kept null; a component's id
is its least doc_id that isn't null. Repeated rows are equal sets. Empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, lower_ascii, mix64, released, run_hashes, table_bytes, trimmed, word_hashes, word_spans, written
from tidemark.llm.components import components

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Ratio of the sizes that bound a band.
BAND_RATIO = 1.6
#: Sets that meet at one hash, up to which all pairs across components are compared.
SMALL_GROUP = 8
#: Packed index bytes of a bucket of the last round that one task compares with the whole bucket.
BLOCK_BYTES = 1 << 18
#: Sets in the sample by which each band's allocation is chosen, and the cost of comparing a pair in index entries.
SAMPLE_SETS, PAIR_COST = 300, 40
#: Bytes of text that a map task looks at together, and index bytes it holds back before it sends them on.
PIECE_BYTES, HELD_BYTES = 1 << 20, 20 << 20
#: Buckets of index hashes at least, and index bytes that a bucket is meant to hold.
LEAST_BUCKETS, BUCKET_BYTES = 256, 8 << 20
#: Bytes of an index hash beside its bucket, and of a set's code. What meets by chance is found out by the comparison, and sets
#: that share a code are all compared, so shorter ones cost time and lose nothing.
HASH_BYTES, CODE_BYTES = 5, 5
#: Sets that are compared with one set in one task; more of them are dealt to several tasks.
STAR_SETS = 1000
#: Bytes of sketches that are broadcast; beyond, pairs are joined with their sketches.
SKETCH_BYTES = 48 << 20
#: Sets whose sketches are looked up for a broadcast, and bytes up to which keys (60 bytes each, and 30 for each pair) are broadcast;
#: beyond, a shuffle joins them.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
class Bands:
    """Sizes dealt into bands, and for each band the number of units of its universe and how many are taken in twos."""

    def __init__(self, similar: tuple[int, int] = SIMILAR, fine: bool = False) -> None:
        self.num, self.den = similar
        self.low = [1]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND_RATIO)))
        self.low = np.array(self.low, np.int64)
        self.units = np.array([int(hi) - 1 if fine else self._units(int(hi) - 1) for hi in self.low[1:]], np.int64)
        self.twos = np.zeros(len(self.units), np.int64)

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most elements in which similar sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def need(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """What the segments of a set must count together to find every partner whose size doesn't exceed the band's."""
        return self.differences(size, np.minimum(self.low[band + 1] - 1, size * self.den // self.num)) + 1

    def _units(self, hi: int) -> int:
        """One more than the differences, and what is likely to be empty on top."""
        n = need = int(self.differences(np.int64(hi), np.int64(hi))) + 1
        for _ in range(20):
            empty = n * float(np.exp(-hi / n))
            n = need + int(empty + 3 * empty**0.5 + 1)
        return n

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, band): each set's own band, and the next where a partner's size may lie in it."""
        own = np.searchsorted(self.low, size, "right") - 1
        rows, bands = [np.arange(len(size))], [own]
        step = 1
        while True:
            later = own + step
            reach = self.low[later] * self.num <= size * self.den
            if not reach.any():
                break
            rows.append(np.flatnonzero(reach))
            bands.append(later[reach])
            step += 1
        return np.concatenate(rows), np.concatenate(bands)


def shingle_sets(b: pa.Array, most: int, shingle: int = SHINGLE):
    """For pieces of a text column: sizes of the rows' sets, and all their sorted 64-bit hashes."""
    texts = Texts(b)
    for i, j in texts.pieces(most):
        raw = [texts.row(r).tobytes() for r in range(i, j)]
        data = lower_ascii(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
        begin, end = word_spans(data)
        first = np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]))
        words = word_hashes(data, begin, end)
        runs = run_hashes(words, shingle)
        sizes, sets = np.zeros(j - i, np.int64), []
        for r, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if z - a >= shingle:
                found = np.unique(runs[a : z - shingle + 1])
            elif z > a:
                with np.errstate(over="ignore"):
                    found = mix64(run_hashes(words[a:z], z - a) ^ (_K[z - a & 3] * np.uint64(z - a)))
            else:
                continue
            sizes[r] = len(found)
            sets.append(found)
        yield sizes, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def set_ids(sizes: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, in two halves; empty sets get 0."""
    out = np.zeros((len(sizes), 2), np.uint64)
    at = 0
    for r, n in enumerate(sizes.tolist()):
        if n:
            out[r] = np.frombuffer(hashlib.blake2b(elements[at : at + n].tobytes(), digest_size=16).digest(), "<u8")
            at += n
    return out[:, 0], out[:, 1]


def signatures(bands: Bands, sizes: np.ndarray, elements: np.ndarray, rows: np.ndarray, band: np.ndarray, hard: bool):
    """Index entries of the sets `rows` in their `band`: hash, place in rows, what the segment counts, whether an element less.

    Also what each set's segments count beyond its need. hard: empty segments are indexed too.
    """
    units, size = bands.units[band], sizes[rows]
    twos = bands.twos[band]
    begin = np.cumsum(sizes) - sizes
    element_of = np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    x = elements[element_of]
    with np.errstate(over="ignore"):
        unit = (mix64(x ^ _K[1]) % np.repeat(units, size).astype(np.uint64)).astype(np.int64)
        two = np.repeat(twos, size)
        segment = np.where(unit < 2 * two, unit >> 1, unit - two)
        n_segments = units - twos
        base = np.cumsum(n_segments) - n_segments
        at = np.repeat(base, size) + segment
        value = mix64(x + _K[2])
        total = np.zeros(int(n_segments.sum()), np.uint64)
        np.add.at(total, at, value)
        count = np.bincount(at, minlength=len(total))
        owner = np.repeat(np.arange(len(rows)), n_segments)
        number = np.arange(len(total)) - base[owner]
        salt = mix64((number.astype(np.uint64) + np.uint64(1)) * _K[0] + (band[owner].astype(np.uint64) + np.uint64(1)) * _K[3] + (np.uint64(77) if hard else np.uint64(0)))
        double = number < twos[owner]
        weight = np.where(double & (count > 1), 2, np.minimum(count, 1))
        spare = np.bincount(owner, weight, len(rows)).astype(np.int64) - bands.need(size, band)
        kept = np.ones(len(total), bool) if hard else count > 0
        out = [(mix64(total + salt)[kept], owner[kept], np.maximum(weight, 1)[kept], np.zeros(int(kept.sum()), bool))]
        less = double[at] & (count[at] > (0 if hard else 1))
        if less.any():
            k = at[less]
            out.append((mix64(total[k] - value[less] + salt[k]), owner[k], weight[k], np.ones(len(k), bool)))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), spare


def sketches(bands: Bands, sizes: np.ndarray, elements: np.ndarray) -> list[bytes]:
    """For each set a byte for each of 2^k units of the universe, at least twice as many as two similar sets of its band can differ in.

    A unit's byte is a sum over the set's elements there. Units whose bytes differ hold an element that the sets don't share, so
    their number can't exceed the differences: a bound that loses no similar pair.
    """
    size = np.maximum(sizes, 1)
    units = (1 << np.ceil(np.log2(2 * bands.units[np.searchsorted(bands.low, size, "right") - 1])).astype(np.int64)) * (sizes > 0)
    base = np.cumsum(units) - units
    total = np.zeros(int(units.sum()), np.uint64)
    with np.errstate(over="ignore"):
        unit = (mix64(elements ^ _K[3]) & np.repeat(np.maximum(units, 1) - 1, sizes).astype(np.uint64)).astype(np.int64)
        np.add.at(total, np.repeat(base, sizes) + unit, mix64(elements + _K[0]))
    low = total.astype(np.uint8)
    return [low[b : b + u].tobytes() for b, u in zip(base.tolist(), units.tolist(), strict=True)]


class SketchTable:
    """Sizes and sketches of sets by code, to tell pairs that can't be similar."""

    def __init__(self, bands: Bands, rows: list[tuple[int, int, bytes]]) -> None:
        rows = sorted(rows)
        codes, first, count = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True, return_counts=True)
        self.bands, self.codes, self.single = bands, codes, count == 1
        self.size = np.array([rows[k][1] for k in first.tolist()], np.int64)
        self.units = np.array([len(rows[k][2]) for k in first.tolist()], np.int64)
        self.tables: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(codes), np.int64)
        for u in np.unique(self.units).tolist():
            own = np.flatnonzero(self.units == u)
            self.place[own] = np.arange(len(own))
            self.tables[u] = np.frombuffer(b"".join(rows[k][2] for k in first[own].tolist()), np.uint8).reshape(len(own), u)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False only for pairs of codes whose sets differ in more than similar sets of their sizes can."""
        out = np.ones(len(a), bool)
        if not len(self.codes) or not len(a):
            return out
        i, j = (np.minimum(np.searchsorted(self.codes, x), len(self.codes) - 1) for x in (a, b))
        known = (self.codes[i] == a) & (self.codes[j] == b) & self.single[i] & self.single[j]
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        out[known & (small * self.bands.den < large * self.bands.num)] = False
        most = self.bands.differences(self.size[i], self.size[j])
        u, v = self.units[i], self.units[j]
        swap = u > v
        i, j, u, v = np.where(swap, j, i), np.where(swap, i, j), np.minimum(u, v), np.maximum(u, v)
        for x, y in {*zip(u[known].tolist(), v[known].tolist(), strict=True)}:
            rows = np.flatnonzero(known & out & (u == x) & (v == y))
            step = max(1, (1 << 22) // y)
            for at in range(0, len(rows), step):
                k = rows[at : at + step]
                left, right = self.tables[x][self.place[i[k]]], self.tables[y][self.place[j[k]]]
                if y > x:  # the finer sketch's units add up to the coarser one's
                    right = right.reshape(len(k), y // x, x).sum(axis=1, dtype=np.uint8)
                out[k] = (left != right).sum(axis=1) <= most[k]
        return out


def sketch_table(some: DataFrame, wanted: DataFrame, bands: Bands):
    """The sketches of the wanted sets (code), broadcast; None if they are too many for that."""
    codes = written(wanted.select("code").distinct(), "codes")
    if codes.count() > BROADCAST_ROWS:
        return None
    known = some.join(F.broadcast(codes), "code", "left_semi")  # the sketches themselves aren't shuffled
    if (known.agg(F.sum(F.octet_length("sketch") + 64)).first()[0] or 0) > SKETCH_BYTES:
        return None
    rows = {bytes(r["set_id"]): (r["code"], r["n_shingles"], bytes(r["sketch"])) for r in known.select("set_id", "code", "n_shingles", "sketch").coalesce(4).toLocalIterator()}
    return some.sparkSession.sparkContext.broadcast(SketchTable(bands, list(rows.values())))


def sifted(pairs: DataFrame, some: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of set ids that sketches don't rule out, where these are too many to be broadcast."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    known = some.select("set_id", "n_shingles", "sketch").join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])
    left, right = (known.select(F.col("set_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")

    def run(batches):
        for b in batches:
            n = b.num_rows
            sets = [*zip(b.column(4).to_pylist(), b.column(2).to_pylist(), strict=True), *zip(b.column(5).to_pylist(), b.column(3).to_pylist(), strict=True)]
            table = SketchTable(bands, [(k, size, sketch) for k, (size, sketch) in enumerate(sets)])
            yield b.select(["a", "b"]).filter(pa.array(table.may_link(np.arange(n), np.arange(n, 2 * n)) if n else np.zeros(0, bool)))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(lambda batches: trimmed(run(batches)), "a binary, b binary")


def unrelated(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of a sample without those that share a fifth with an earlier one: what meets among the rest meets by chance."""
    owner: dict[int, list[int]] = {}
    kept: list[np.ndarray] = []
    for s in sets:
        shared: dict[int, int] = {}
        for x in s.tolist():
            for k in owner.get(x, ()):
                shared[k] = shared.get(k, 0) + 1
        if all(5 * n < len(s) and 5 * n < len(kept[k]) for k, n in shared.items()):
            for x in s.tolist():
                owner.setdefault(x, []).append(len(kept))
            kept.append(s)
    return kept


def chosen_bands(docs: DataFrame, similar: tuple[int, int], shingle: int) -> Bands:
    """Bands whose allocation costs least by a sample: entries to be indexed, and pairs to be compared that meet by chance."""
    bands = Bands(similar)
    n = docs.count()
    step = max(1, n // SAMPLE_SETS)

    def run(batches):
        for b in batches:
            for sizes, elements in shingle_sets(b.column(0), PIECE_BYTES, shingle):
                at = 0
                for s in sizes.tolist():
                    if s:
                        yield pa.record_batch({"x": pa.array([elements[at : at + s].astype("<u8").tobytes()], pa.binary())})
                    at += s

    picked = docs.where(F.pmod("key", F.lit(step)) == 0).select("text").mapInArrow(run, "x binary").distinct().limit(2 * SAMPLE_SETS).collect()
    sets = unrelated(sorted((np.frombuffer(r.x, "<u8") for r in picked), key=lambda x: (len(x), x[0])))
    if len(sets) < 50:
        return bands
    sizes, elements = np.array([len(s) for s in sets]), np.concatenate(sets)
    rows, band = bands.of(sizes)
    cost = {}
    for kind in (0, 1):
        bands.twos = bands.units // 2 * kind
        sig, owner, _, _, _ = signatures(bands, sizes, elements, rows, band, False)
        _, inverse, met = np.unique(sig, return_inverse=True, return_counts=True)
        entries = np.bincount(band[owner], minlength=len(bands.units)) * float(step)
        pairs = np.bincount(band[owner], (met[inverse] - 1) / 2, minlength=len(bands.units)) * float(step) ** 2
        cost[kind] = entries + PAIR_COST * np.minimum(pairs, entries * SMALL_GROUP)
    bands.twos = np.where(cost[1] < cost[0], bands.units // 2, 0)
    return bands


def _ids(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    raw = np.stack([hi, lo], 1).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _codes(hi: np.ndarray) -> np.ndarray:
    """The codes of sets, from the first halves of their ids."""
    return (hi.astype("<u8").byteswap() >> np.uint64(64 - 8 * CODE_BYTES)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, all first bytes first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
    return wide.view("<u8")[:, 0]


def indexed(rows: DataFrame, bands: Bands, buckets: int, turn: int, shingle: int) -> DataFrame:
    """(bucket, pack): index entries of every set in round `turn`; rows: text, and from the second round `joined`, a hash of the component so far.

    An entry is the hash, the set's code, what its segments count beyond the need, and a mark: what this segment counts, whether
    an element is left out, and which of the set's bands it is.
    """

    def run(batches):
        import zstandard

        z, held, weight = zstandard.ZstdCompressor(level=1), {}, 0

        def sent():
            names = sorted(held)
            packs = [z.compress(b"".join(held[k])) for k in names]
            held.clear()
            return pa.record_batch({"bucket": pa.array(names, pa.int64()), "pack": pa.array(packs, pa.binary())})

        for b in batches:
            joined = np.asarray(b.column(1)).astype(np.uint64) if turn > 1 else None
            r0 = 0
            for sizes, elements in shingle_sets(b.column(0), PIECE_BYTES, shingle):
                hi, lo = set_ids(sizes, elements)
                once = np.zeros(len(sizes), bool)
                once[np.unique(hi, return_index=True)[1]] = True  # equal sets of a piece count once
                once |= ~np.isin(lo, lo[once])
                some = np.flatnonzero((sizes > 0) & once)
                mine, band = bands.of(sizes[some])
                mine = some[mine]
                which = band - (np.searchsorted(bands.low, sizes[mine], "right") - 1)
                sig, owner, count, less, spare = signatures(bands, sizes, elements, mine, band, turn == 3)
                bucket = (sig % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, owner, bucket = sig[order] // np.uint64(buckets), owner[order], bucket[order]
                mark = (count[order] | less[order].astype(np.int64) << 2 | which[owner] << 3).astype(np.uint8)
                over, code = np.clip(spare + 1, 0, 65535)[owner].astype(np.uint64), _codes(hi)[mine][owner].astype(np.uint64)
                root = joined[r0 + mine][owner] if turn > 1 else None
                r0 += len(sizes)
                edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])).tolist() if len(bucket) else []
                for i, j in zip(edge, [*edge[1:], len(bucket)], strict=False):
                    part = struct.pack("<q", j - i) + _planes(sig[i:j], HASH_BYTES) + _planes(code[i:j], CODE_BYTES) + _planes(over[i:j], 2) + mark[i:j].tobytes() + (_planes(root[i:j], 8) if turn > 1 else b"")
                    held.setdefault(int(bucket[i]), []).append(part)
                    weight += len(part)
                if weight >= HELD_BYTES:
                    yield sent()
                    weight = 0
        if held:
            yield sent()

    return rows.select("text", *(["joined"] if turn > 1 else [])).mapInArrow(lambda batches: trimmed(run(batches)), "bucket long, pack binary")


def _unpacked(packs, rooted: bool):
    import zstandard

    z = zstandard.ZstdDecompressor()
    cols = [[], [], [], [], []]
    for x in packs:
        data, at = z.decompress(x), 0
        while at < len(data):
            (n,) = struct.unpack_from("<q", data, at)
            at += 8
            for col, width in zip(cols, (HASH_BYTES, CODE_BYTES, 2, 1, 8 if rooted else 0), strict=True):
                if width:
                    col.append(np.frombuffer(data, np.uint8, n, at) if width == 1 else _from_planes(data, at, n, width))
                at += width * n
    return [np.concatenate(c) if c else None for c in cols]


#: Pairs and the like that a task holds before it settles them and sends them on.
MANY = 1 << 20


class Met:
    """What has met in some buckets: pairs of codes to be compared, lists of the members of small groups, and what crowded segments count.

    A list holds the number of its whole subsets, which stand first, and the codes. hot: rows (code, band, spare, hot), see `_summed`.
    """

    def __init__(self, sketched=None) -> None:
        self.sketched = sketched
        self.pairs: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        self.lists: dict[int, list[np.ndarray]] = {}
        self.hot: list[np.ndarray] = [np.zeros((0, 4), np.int64)]

    def add_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        fit = a != b
        self.pairs.append(np.stack([np.minimum(a, b)[fit], np.maximum(a, b)[fit]], 1))

    def settle(self) -> None:
        """Everything once, and of the pairs only those that sketches don't rule out."""
        pairs = np.unique(np.concatenate(self.pairs), axis=0)
        self.pairs = [pairs if self.sketched is None else pairs[self.sketched.value.may_link(pairs[:, 0], pairs[:, 1])]]
        self.lists = {n: [np.unique(np.concatenate(x), axis=0)] for n, x in self.lists.items()}
        self.hot = [_summed(np.concatenate(self.hot))]

    def weight(self) -> int:
        return sum(map(len, self.pairs)) + sum(n * len(x) for n, xs in self.lists.items() for x in xs) + sum(map(len, self.hot))

    def tables(self) -> list[np.ndarray]:
        self.settle()
        return [*self.pairs, *self.hot, *(self.lists[n][0] for n in sorted(self.lists))]

    @staticmethod
    def dumped(tables: list[np.ndarray]) -> bytes:
        heads = [struct.pack("<qq", *t.shape) for t in tables]
        return struct.pack("<q", len(tables)) + b"".join(heads) + b"".join(np.ascontiguousarray(t.T).astype("<i8").tobytes() for t in tables)

    def load(self, data: bytes) -> None:
        (n,) = struct.unpack_from("<q", data)
        at = 8 + 16 * n
        for k in range(n):
            rows, width = struct.unpack_from("<qq", data, 8 + 16 * k)
            table = np.frombuffer(data, "<i8", rows * width, at).reshape(width, rows).T
            at += 8 * rows * width
            (self.pairs if k == 0 else self.hot if k == 1 else self.lists.setdefault(width, [])).append(table)


def _met(packs, turn: int, small: int, out: Met, block: tuple[int, int] | None = None):
    """Adds what meets in one bucket to `out`, and yields whenever that has become much; block (k, n): of the last round's pairs only those
    whose one end is in the k-th of n blocks.
    """
    sig, code, over, mark, root = _unpacked(packs, turn > 1)
    if block is None or block[0] == 0:
        short = np.flatnonzero(over == 0)  # sets whose segments count too little by themselves
        lacking = np.unique(np.stack([code[short].astype(np.int64), (mark[short] >> 3).astype(np.int64)], 1), axis=0)
        out.hot.append(np.column_stack([lacking, np.full(len(lacking), -1), np.zeros(len(lacking), np.int64)]))
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    less = mark >> 2 & 1
    order = order[np.lexsort((code[order], less[order], sig[order]))]  # in a group the whole subsets come first
    sig, code, over, mark, less = sig[order], code[order], over[order], mark[order], less[order]
    keep = np.ones(len(sig), bool)  # equal sets from several tasks are one
    keep[1:] = (sig[1:] != sig[:-1]) | (code[1:] != code[:-1]) | (less[1:] != less[:-1])
    if turn > 1:
        root = root[order]
        keep[1:] |= root[1:] != root[:-1]
        root = root[keep]
    sig, code, over, mark, less = sig[keep], code[keep].astype(np.int64), over[keep], mark[keep], less[keep]
    if not len(sig):
        yield
        return
    edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(edge, len(sig)))
    n_whole = np.add.reduceat(1 - less.astype(np.int64), edge)
    use = (length > 1) & (n_whole > 0)
    if turn > 1:  # what lies within one component is joined already
        use &= np.maximum.reduceat(root, edge) != np.minimum.reduceat(root, edge)
    edge, length, n_whole = edge[use], length[use], n_whole[use]

    def crowded(member: np.ndarray) -> None:
        out.hot.append(np.stack([code[member], (mark[member] >> 3).astype(np.int64), over[member].astype(np.int64) - 1, (mark[member] & 3).astype(np.int64)], 1))

    if turn == 1:
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        member = np.repeat(edge, length) + inner
        out.add_pairs(code[np.repeat(edge, length)[inner > 0]], code[member[inner > 0]])
        for n in range(3, small + 1):
            e, w = edge[length == n], n_whole[length == n]
            if len(e):
                out.lists.setdefault(n + 1, []).append(np.unique(np.column_stack([w, code[e[:, None] + np.arange(n)]]), axis=0))
        big = np.repeat(length > small, length)
        crowded(member[big])
        yield
        return
    waiting = 0
    for e, n, w in zip(edge.tolist(), length.tolist(), n_whole.tolist(), strict=True):
        _, name, many = np.unique(root[e : e + n], return_inverse=True, return_counts=True)
        largest = int(np.argmax(many))
        at, outside = np.arange(n), np.flatnonzero(name != largest)  # every pair across components has an end outside the largest
        if turn == 2 and len(outside) > small:
            out.add_pairs(np.full(len(outside), code[e + int(np.argmax(name == largest))]), code[e + outside])
            crowded(e + at)
            continue
        if block is not None:
            outside = outside[(code[e + outside] // 7) % block[1] == block[0]]
        for i in outside.tolist():
            other = at[(name != name[i]) & ((at < w) | (i < w))]
            out.add_pairs(np.full(len(other), code[e + i]), code[e + other])
            waiting += len(other)
            if waiting > MANY:
                yield
                waiting = 0
    yield


def _summed(busy: np.ndarray) -> np.ndarray:
    """(code, band, spare, hot) rows with the least spare and the sum of hot for each code and band."""
    name, inverse = np.unique(busy[:, :2], axis=0, return_inverse=True)
    spare = np.full(len(name), 65535)
    np.minimum.at(spare, inverse.ravel(), busy[:, 2])
    return np.column_stack([name, spare, np.bincount(inverse.ravel(), busy[:, 3], len(name)).astype(np.int64)])


def meetings(index: DataFrame, turn: int, parts: int, sketched=None) -> DataFrame:
    """What meets, each thing once: rows (a, b) of codes, pairs to be compared; rows with `members`, a small group's list; rows with `hot`, what
    the crowded segments of set a count in a band.

    A pair meets in many buckets. Tasks send what they found as packed arrays to `parts` places by code, where each pair is kept
    once and counts are summed. sketched: a broadcast SketchTable; pairs that it rules out aren't sent on.
    """
    small = SMALL_GROUP

    def find(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        now, packs, met = None, [], Met(sketched)

        def sent():
            nonlocal met
            pairs, hot, *lists = met.tables()
            met = Met(sketched)
            tables = [pairs, hot, *lists]
            place = [mix64(t[:, 0 if k < 2 else 1].astype(np.uint64)) % np.uint64(parts) for k, t in enumerate(tables)]
            names = np.unique(np.concatenate(place)).astype(np.int64).tolist()
            order = [np.argsort(p, kind="stable") for p in place]
            cut = [np.searchsorted(p[o], np.append(np.array(names, np.uint64), np.uint64(parts))) for p, o in zip(place, order, strict=True)]
            packed = [z.compress(Met.dumped([t[o[c[k] : c[k + 1]]] for t, o, c in zip(tables, order, cut, strict=True)])) for k in range(len(names))]
            return pa.record_batch({"part": pa.array(names, pa.int64()), "pack": pa.array(packed, pa.binary())})

        def found():
            for _ in _met(packs, turn, small, met, now[1:] if len(now) > 1 else None):
                if met.weight() > MANY:
                    met.settle()
                    if met.weight() > MANY // 2:
                        yield sent()
            packs.clear()

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1)), strict=True)
            for k, x in zip(keys, batch.column(batch.num_columns - 1), strict=True):
                if k != now and packs:
                    yield from found()
                now = k
                packs.append(x.as_buffer())
        if packs:
            yield from found()
        if met.weight():
            yield sent()

    def merge(batches):
        import zstandard

        z, now, met = zstandard.ZstdDecompressor(), None, None
        names = ["a", "b", "band", "spare", "hot", "members"]

        def merged():
            pairs, hot, *lists = met.tables()
            none = lambda n, kind=None: pa.nulls(n, kind or pa.int64())
            of = lambda t, k: pa.array(np.ascontiguousarray(t[:, k]))
            array = pa.list_(pa.int64())
            n, m = len(pairs), len(hot)
            yield pa.RecordBatch.from_arrays([of(pairs, 0), of(pairs, 1), none(n), none(n), none(n), none(n, array)], names=names)
            yield pa.RecordBatch.from_arrays([of(hot, 0), none(m), *(of(hot, k) for k in (1, 2, 3)), none(m, array)], names=names)
            for t in lists:
                n, width = t.shape
                members = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(t).ravel()))
                yield pa.RecordBatch.from_arrays([*(none(n) for _ in range(5)), members], names=names)

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now and met is not None:
                    yield from merged()
                    met = None
                met = Met() if met is None else met
                now = k
                met.load(z.decompress(x.as_buffer()))
        if met is not None:
            yield from merged()

    key = [c for c in index.columns if c != "pack"]
    packed = index.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: trimmed(find(batches)), "part long, pack binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: trimmed(merge(batches)), "a long, b long, band long, spare long, hot long, members array<long>")


def _of_codes(pairs: DataFrame, some: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of codes as pairs of set ids (a < b) whose sizes are close enough."""
    known = some.select("set_id", "code", "n_shingles").distinct()
    left, right = (known.select(F.col("set_id").alias(k), F.col("code").alias(f"code_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "ab")
    both = pairs.select(F.col("a").alias("code_a"), F.col("b").alias("code_b")).join(left, "code_a").join(right, "code_b")
    fit = (F.least("n_a", "n_b") * bands.den >= F.greatest("n_a", "n_b") * bands.num) & (F.col("a") != F.col("b"))
    return both.where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose (doc, null, key) are wanted, with the other columns of `wanted`; the latter is broadcast while its bytes are few."""
    pairs = F.sum(F.size("to")) if "to" in wanted.columns else F.lit(0)
    n, pairs = wanted.agg(F.count("*"), F.coalesce(pairs, F.lit(0))).first()
    if 60 * n + 30 * pairs <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, ["doc", "null", "key"])


def _compared(docs: DataFrame, some: DataFrame, pairs: DataFrame, bands: Bands, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of set ids that are similar, by the 64-bit hashes of their whole sets.

    Each pair's sets meet at a's place: b's set travels there once for each pair, a's once; a place with very many pairs is
    dealt to several tasks, and so are the trips of a set that travels to very many places. A task holds one set at a time.
    """
    places = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / STAR_SETS).cast("int"))
    to = pairs.join(places, "a").select("a", F.col("b").alias("set_id"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("turn"))
    own = places.select("a", F.col("a").alias("set_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"))
    trips = written(to.unionByName(own), "trips")
    loads = trips.groupBy("set_id").agg(F.count("*").alias("n")).select("set_id", F.ceil(F.col("n") / STAR_SETS).cast("int").alias("loads"))
    trips = trips.join(loads, "set_id").withColumn("load", F.pmod(F.xxhash64("a", "salt"), F.col("loads")))
    trips = trips.groupBy("set_id", "load").agg(F.collect_list(F.struct("a", "salt", "turn")).alias("to"))
    at = some.groupBy("set_id").agg(F.min(F.struct("doc", "null", "key")).alias("at"))
    wanted = written(trips.join(at, "set_id").select("set_id", "at.*", "to"), "wanted")

    def sets(batches):
        for b in batches:
            r0 = 0
            for sizes, elements in shingle_sets(b.column(1), PIECE_BYTES, shingle):
                ends = np.cumsum(sizes)
                data = [elements[e - s : e].astype("<u8").tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                to = b.column(2).slice(r0, len(sizes))
                count = np.diff(np.asarray(to.offsets))
                row = np.repeat(np.arange(len(sizes)), count)
                flat = to.flatten()
                ids = b.column(0).slice(r0, len(sizes))
                weight = np.cumsum(8 * sizes[row])
                cuts = [0, *np.searchsorted(weight, np.arange(PIECE_BYTES, int(weight[-1]) if len(weight) else 0, PIECE_BYTES)).tolist(), len(row)]
                for i, j in zip(cuts, cuts[1:], strict=False):  # few bytes at a time, however far a set travels
                    if j > i:
                        part = flat.slice(i, j - i)
                        yield pa.RecordBatch.from_arrays([part.field(0), part.field(1), part.field(2), ids.take(pa.array(row[i:j])), pa.array([data[r] for r in row[i:j].tolist()], pa.binary())], names=["a", "salt", "turn", "b", "elements"])
                r0 += len(sizes)

    sent = _fetched(docs, wanted).select("set_id", "text", "to").mapInArrow(lambda batches: trimmed(sets(batches)), "a binary, salt int, turn int, b binary, elements binary")

    def compare(batches):
        center, one = None, None
        for batch in batches:
            a, b = [], []
            for x, turn, y, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if turn == 0:
                    center, one = x, np.frombuffer(data, "<u8")
                    continue
                if center != x:
                    raise ValueError("a set's place is missing")
                all_ = np.concatenate([one, np.frombuffer(data, "<u8")])
                all_.sort(kind="stable")
                shared = int((all_[1:] == all_[:-1]).sum())
                if shared * bands.den >= (len(all_) - shared) * bands.num:
                    a.append(x)
                    b.append(y)
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "turn").mapInArrow(lambda batches: trimmed(compare(batches)), "a binary, b binary")


def _code(column: str):
    return F.conv(F.hex(F.substring(column, 1, CODE_BYTES)), 16, 10).cast("long")


def _sifted_compared(docs: DataFrame, some: DataFrame, rest: DataFrame, links: DataFrame, bands: Bands, shingle: int) -> DataFrame:
    """The links and those among the pairs `rest`, which sketches sift first."""
    if not rest.limit(1).count():
        return links
    table = sketch_table(some, rest.select(_code("a").alias("code")).unionByName(rest.select(_code("b").alias("code"))), bands)
    if table is not None:

        def sift(batches):
            for b in batches:
                yield b.select(["a", "b"]).filter(pa.array(table.value.may_link(np.asarray(b.column(2)), np.asarray(b.column(3)))))

        rest = rest.select("a", "b", _code("a").alias("code_a"), _code("b").alias("code_b")).mapInArrow(lambda batches: trimmed(sift(batches)), "a binary, b binary")
    else:
        rest = sifted(rest.select("a", "b"), some, bands)
    rest = written(rest, "rest")
    return links.unionByName(written(_compared(docs, some, rest, bands, shingle), "links")) if rest.limit(1).count() else links


def _linked(docs: DataFrame, some: DataFrame, pairs: DataFrame, links: DataFrame | None, bands: Bands, shingle: int) -> DataFrame:
    """The links so far and those among the pairs, but for pairs that links join already.

    First each set is compared with its least partner only; most groups are then joined, and of the other pairs only those across
    components remain.
    """
    pairs = written(pairs, "pairs")
    released(docs)
    star = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
    new = written(_compared(docs, some, star, bands, shingle), "links")
    links = new if links is None else links.unionByName(new)
    roots = components(links, "a", "b")
    rest = pairs.join(star, ["a", "b"], "left_anti")
    rest = rest.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    rest = written(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    released(docs)
    return _sifted_compared(docs, some, rest, links, bands, shingle)


def _across(lists: DataFrame, some: DataFrame, roots: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of set ids across components, of sets that stand in one list and are close enough in size."""
    sets = some.select("set_id", "code", "n_shingles").distinct()
    sets = sets.join(roots, F.col("set_id") == F.col("node"), "left").select("code", "set_id", F.col("n_shingles").alias("n"), F.coalesce("root", "set_id").alias("root"))
    # the first entry of a list is the number of whole subsets in it, which stand first
    places = lists.select(F.xxhash64("members").alias("list"), F.element_at("members", 1).alias("whole"), F.posexplode(F.slice("members", F.lit(2), F.size("members") - 1)).alias("pos", "code"))
    met = places.join(sets, "code").groupBy("list", "whole").agg(F.collect_list(F.struct("pos", "set_id", "n", "root")).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))

    def fit(x, y, whole):
        close = F.least(x["n"], y["n"]) * bands.den >= F.greatest(x["n"], y["n"]) * bands.num
        return (x["pos"] < y["pos"]) & (x["pos"] < whole) & (x["root"] != y["root"]) & close

    both = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: fit(x, y, F.col("whole"))), lambda y: F.struct(F.least(x["set_id"], y["set_id"]).alias("a"), F.greatest(x["set_id"], y["set_id"]).alias("b")))))
    return met.where("low <> high").select(F.explode(both).alias("p")).select("p.a", "p.b").distinct()


def _hard(met: DataFrame, some: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, null, key, joined, code): the place of each set that its round doesn't serve, and a hash of its component so far."""
    hard = met.where("hot > spare").select(F.col("a").alias("code")).distinct()
    joined = some.join(hard, "code").groupBy("set_id", "code").agg(F.min(F.struct("doc", "null", "key")).alias("at")).join(roots, F.col("set_id") == F.col("node"), "left")
    return written(joined.select("at.*", F.xxhash64(F.coalesce("root", "set_id")).alias("joined"), "code"), "wanted")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """doc, null, key, n_shingles, set_id, root, component_id for every row.

    doc, null and key are the id (0 for null), whether it is null, and a hash of the text; root names the component (null for empty sets).
    """
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    rows = docs.select(F.coalesce(own.cast("long"), F.lit(0)).alias("doc"), own.isNull().cast("long").alias("null"), F.xxhash64(text).alias("key"), text.alias("text"))
    bands = chosen_bands(rows, similar, shingle)
    buckets = max(LEAST_BUCKETS, min(1 << 24, 2 * table_bytes(rows) // BUCKET_BYTES))

    def identify(batches):
        for b in batches:
            r0 = 0
            for sizes, elements in shingle_sets(b.column(3), PIECE_BYTES, shingle):
                hi, lo = set_ids(sizes, elements)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(r0, n) for i in range(3)), pa.array(sizes, pa.int64()), _ids(hi, lo), pa.array(_codes(hi)), pa.array(sketches(bands, sizes, elements), pa.binary())], names=["doc", "null", "key", "n_shingles", "set_id", "code", "sketch"])
                r0 += n

    sets = written(rows.mapInArrow(lambda batches: trimmed(identify(batches)), "doc long, null long, key long, n_shingles long, set_id binary, code long, sketch binary"), "set-ids")
    some = sets.where("n_shingles > 0")

    parts = buckets // 4
    released(rows)
    met = written(meetings(indexed(rows, bands, buckets, 1, shingle), 1, parts), "meetings")
    shared = some.groupBy("code").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select(F.col("code").alias("a"), F.col("code").alias("b"))
    pairs = _of_codes(met.where("b is not null").select("a", "b").unionByName(shared), some, bands)
    links = _linked(rows, some, pairs, None, bands, shingle)
    roots = components(links, "a", "b")
    across = written(_across(met.where("members is not null").select("members"), some, roots, bands), "across")
    if across.limit(1).count():
        links = _linked(rows, some, across, links, bands, shingle)
        roots = components(links, "a", "b")

    # sets that a round doesn't serve: too many of their segments are crowded, or too few hold anything
    fine = Bands(similar, fine=True)
    for turn, own in ((2, fine), (3, bands)):
        hard = _hard(met, some, roots)
        if not hard.limit(1).count():
            break
        released(rows)
        index = indexed(_fetched(rows, hard.drop("code")), own, buckets, turn, shingle)
        table = None
        if turn == 3:
            table = sketch_table(some, hard, bands)
            index = written(index, "index")
            blocks = index.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("pack")) / BLOCK_BYTES).cast("long").alias("blocks"))
            index = index.join(blocks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", "pack")
        met = written(meetings(index, turn, parts, table), "meetings")
        more = _of_codes(met.where("b is not null").select("a", "b"), some, bands)
        links = _linked(rows, some, more, links, bands, shingle)
        roots = components(links, "a", "b")

    released(rows)
    least = some.groupBy("set_id").agg(F.min(F.when(F.col("null") == 0, F.col("doc"))).alias("least"))
    named = least.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(by_root, "root").select("set_id", "root", "component_id")
    own_id = F.when(F.col("null") == 0, F.col("doc"))
    least = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(own_id)
    return sets.join(classes, "set_id", "left").select("doc", "null", "key", "n_shingles", "set_id", "root", least.alias("component_id"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id for every row; rows of one set_id have equal sets."""
    return labelled(docs, **how).select(F.when(F.col("null") == 0, F.col("doc")).alias("doc_id"), "n_shingles", "component_id", "set_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component with all its columns: the one of the least id (null last), and of these the least hash of the text.

    Documents without words stay. Of rows that are equal in id and text one stays.
    """
    names = docs.columns
    inner = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own, text = F.col(f"_{names.index(id_col)}"), F.col(f"_{names.index(text_col)}")
    keyed = inner.withColumns({"doc": F.coalesce(own.cast("long"), F.lit(0)), "null": own.isNull().cast("long"), "key": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    labels = written(labelled(inner.select(own.alias("doc_id"), text.alias("text"))), "labelled")
    some = labels.where("n_shingles > 0")
    chosen = some.groupBy("root").agg(F.min(F.struct("null", "doc", "key")).alias("at")).select("at.*")
    gone = written(some.select("null", "doc", "key").distinct().join(chosen, ["null", "doc", "key"], "left_anti"), "gone")
    # what goes is less than what stays: while its bytes are few it's broadcast, and texts pass without a shuffle
    kept = keyed.join(F.broadcast(gone) if 60 * gone.count() <= BROADCAST_BYTES else gone, ["doc", "null", "key"], "left_anti")
    if some.groupBy("doc", "null", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        wordless = ~text.rlike(r"[^\x20\x09-\x0D]") | text.isNull()
        kept = kept.where(wordless).unionByName(kept.where(~wordless).dropDuplicates(["doc", "null", "key"]))
    return kept.select(*inner.columns).toDF(*names)
