"""Benchmark decontamination: near copies of benchmark items inside documents, by a random-walk embedding and sampling.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a sequence of words: output place j shows the word
under the pointer, and a random bit of (j, word) says whether the pointer moves on. Walks over sequences at a
small edit distance fall into step again, so their outputs differ in few places, and hashing a few sampled places brings
them together. Each item is cut into windows near its own size, from every offset; each window of a document of the
same size takes the same walks; windows that agree on all sampled places of a table are candidates; one whose first sampled places no
item's window shows is let go on its way. The
number of tables is raised until simulated edits at the distance sought are found with the target recall. A candidate
counts only if the exact edit distance (in words) between the whole item and its best place in the document is
at most `max_edit` of the item's words.

Windows with more unknown words than the longest item of their size may have edits take no walks: a count, which loses
nothing, as a stretch within that distance holds no more words that no item has. Copies are simulated with scattered edits
and with one replaced block, and tables are added until each kind reaches the target recall.
Items are taken in blocks of a bounded size, each broadcast for one pass over all documents, so any number of items works.

Words are runs of letters, digits and other bytes beyond ASCII, after lower-casing; signs don't count. Nulls: a null
text is empty, a null doc_id is kept, an item that is null or has no word matches nothing. Repeated documents and
items give repeated results. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, id_and_text, mix64, trimmed, word_hashes, written

#: Words of an item that may differ, as a share; recall that simulated copies at this distance must reach.
MAX_EDIT, TARGET_RECALL = 0.2, 0.95
#: Places that a table samples, and tables that are tried for the target together.
SAMPLED, MOST_TABLES = 5, 24
#: Share of an item's words that its windows take, at most, and the sizes that windows may have.
WINDOW_SHARE = 0.75
#: Bytes of item index that are broadcast together.
BLOCK_BYTES = 32 << 20
#: Blocks of items that filter rows one after another in one pass.
CHAINED = 4
#: Bytes of text that a task looks at together.
PIECE_BYTES = 2 << 20
_BITMAP = 1 << 20
#: Sampled places, from the first, after which windows that no item knows are let go, and places of a bitmap for each hash in it.
SIEVES, SIEVE_ROOM = 3, 4
#: Windows that walk together; their pointers stay within a processor's cache.
_AT_ONCE = 1 << 14

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], _INSIDE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return word_hashes(data, *_spans(data))


def window_size(m: int) -> int:
    """The window for items of m words: the largest of a geometric row of sizes within WINDOW_SHARE of m, 4 at least."""
    if m <= 5:
        return m
    size = 4
    while size * 4 // 3 + 1 <= m * WINDOW_SHARE:
        size = size * 4 // 3 + 1
    return size


class Walks:
    """The random choices of one window size: steps, and for each table a multiplier for each step and the places it samples."""

    def __init__(self, size: int, tables: int, seed: int = 7) -> None:
        self.size, self.tables, self.steps = size, tables, 2 * size
        own = [np.random.default_rng([seed, size, t]) for t in range(tables)]  # a table is the same, however many there are
        self.bits = np.array([r.integers(0, 1 << 62, self.steps) for r in own]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        k = min(SAMPLED, size)
        self.places = np.array([np.sort(r.choice(self.steps, k, replace=False)) for r in own])

    def hashes(self, words: np.ndarray, starts: np.ndarray, table: int) -> np.ndarray:
        """One table's hash of the window at each start; beyond its end a window shows blanks."""
        return self.sieved(words, starts, table, ())[1]

    def sieved(self, words: np.ndarray, starts: np.ndarray, table: int, sieves: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The starts whose windows pass the sieves, and one table's hashes of these windows.

        Sieve k knows the hashes that windows of items have after k + 1 of the sampled places; a window that it doesn't know ends in none of theirs.
        """
        parts = [self._walked(words, starts[i : i + _AT_ONCE], table, sieves) for i in range(0, len(starts), _AT_ONCE)]
        if not parts:
            return starts, np.zeros(0, np.uint64)
        return np.concatenate([a for a, _ in parts]), np.concatenate([h for _, h in parts])

    def _walked(self, words: np.ndarray, starts: np.ndarray, table: int, sieves: tuple) -> tuple[np.ndarray, np.ndarray]:
        at, out = starts.copy(), np.full(len(starts), np.uint64(0x1234567 + table))
        places, k, last = self.places[table], 0, len(words) - 1
        with np.errstate(over="ignore"):
            for j in range(int(places[-1]) + 1):
                if j < self.size:  # a window's end can't be reached in fewer steps than it has words
                    w = words[at]
                else:
                    w = np.where(at < starts + self.size, words[np.minimum(at, last)], np.uint64(1))
                if j == places[k]:
                    out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + w)
                    if k < len(sieves):
                        left = np.flatnonzero(sieves[k][sieve_place(out, sieves[k])])
                        starts, at, out, w = starts[left], at[left], out[left], w[left]
                        if not len(left):
                            break
                    k += 1
                w = w * self.bits[table, j]
                w >>= np.uint64(63)
                at += w.view(np.int64)
        return starts, out

    def sieves(self, words: np.ndarray, starts: np.ndarray, table: int) -> tuple:
        """What the windows at these starts pass: for each of the first sampled places a bitmap of their hashes so far."""
        made: list[np.ndarray] = []
        whole = self.places
        for k in range(min(SIEVES, len(whole[table]))):
            self.places = whole[:, : k + 1]
            so_far = np.unique(self.hashes(words, starts, table))
            sieve = np.zeros(1 << max(6, int(SIEVE_ROOM * len(so_far) - 1).bit_length()), bool)
            sieve[sieve_place(so_far, sieve)] = True
            made.append(sieve)
        self.places = whole
        return tuple(made)


def sieve_place(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Where a hash stands in a sieve, whose size is a power of two."""
    return (hashes & np.uint64(len(sieve) - 1)).view(np.int64)


def edit_places(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of the text, and the word after the first such stretch.

    Bit-parallel (Myers, 1999), over words.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for k, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        if score < best:
            best, end = score, k + 1
    return best, end


def known_words(items: list[np.ndarray]) -> np.ndarray:
    """A bitmap of the items' words."""
    known = np.zeros(_BITMAP, bool)
    for w in items:
        known[(w % np.uint64(_BITMAP)).astype(np.int64)] = True
    return known


def known_before(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many known words stand before each place, and in all."""
    return np.concatenate([[0], np.cumsum(known[(words % np.uint64(_BITMAP)).astype(np.int64)])])


def near_enough(before: np.ndarray, size: int, most: int) -> np.ndarray:
    """Whether the window at each place has at most `most` unknown words, the edits that its longest item may have.

    The bound is of the item, not of the window: all of an item's edits may stand in one window.
    """
    return before[size:] - before[:-size] >= size - most


def simulated(item: np.ndarray, kind: str, edits: int, r: np.random.Generator) -> np.ndarray:
    """The item with so many edits, scattered or as one block of other words, among other words."""
    copy, new = item.tolist(), lambda n: r.integers(0, 1 << 62, n).tolist()
    if kind == "scattered":
        for _ in range(edits):
            i, one = int(r.integers(0, len(copy))), int(r.integers(0, 3))
            copy[i : i + 1] = [] if one == 0 and len(copy) > 1 else [*new(1), copy[i]] if one == 1 else new(1)
    else:
        i = (len(copy) - edits) // 2 if kind == "middle" else int(r.integers(0, len(copy) - edits + 1))
        copy[i : i + edits] = new(edits)
    return np.array([*new(len(item)), *copy, *new(len(item))], np.uint64)


def tables_for(items: list[np.ndarray], size: int, max_edit: float, target: float) -> int:
    """The number of tables with which simulated copies of the items at the distance sought reach the target recall, each kind by itself.

    Copies take the whole way to a candidate: the count of known words, and the walks. An error if the target is out of reach.
    """
    r, known, most = np.random.default_rng(11), known_words(items), max(int(max_edit * len(w)) for w in items)
    kinds, each = ("scattered", "block", "middle"), 60
    tried = [items[int(i)] for i in r.integers(0, len(items), len(kinds) * each)]
    copies = [simulated(item, kinds[t // each], int(max_edit * len(item)), r) for t, item in enumerate(tried)]
    own = [np.arange(len(item) - size + 1) for item in tried]
    seen = [np.flatnonzero(near_enough(known_before(known, c), size, most)) for c in copies]

    def laid(texts, starts):  # one after another: words, starts of windows, and a salt for each text
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        salt = mix64(np.repeat(np.arange(len(texts)), [len(x) for x in starts]).astype(np.uint64) + np.uint64(1))
        return np.concatenate(texts), np.concatenate([b + x for b, x in zip(begin, starts, strict=True)]), salt

    (a, at_a, salt_a), (b, at_b, salt_b) = laid(tried, own), laid(copies, seen)
    trial = np.repeat(np.arange(len(copies)), [len(x) for x in seen])
    found, recall, k = np.zeros(len(tried), bool), 0.0, 0
    while k < 16 * MOST_TABLES:
        if k % MOST_TABLES == 0:
            walks = Walks(size, k + MOST_TABLES)
        found[trial[np.isin(walks.hashes(b, at_b, k) ^ salt_b, walks.hashes(a, at_a, k) ^ salt_a)]] = True
        recall, k = found.reshape(len(kinds), each).mean(axis=1).min(), k + 1
        if recall >= target:
            return k
    raise ValueError(f"windows of {size} words reach a recall of {recall:.3f} with {k} tables, {target} is sought")


class Index:
    """Items of one block: their words, and for each window size and table the hashes of all their windows."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], max_edit: float, tables: dict[int, int]) -> None:
        self.ids, self.words, self.max_edit = [i for i, _ in items], [w for _, w in items], max_edit
        self.most = [int(max_edit * len(w)) for w in self.words]
        self.known = known_words(self.words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by_size.setdefault(window_size(len(w)), []).append(k)
        self.sizes = []
        for size, members in sorted(by_size.items()):
            walks = Walks(size, tables[size])
            words = np.concatenate([self.words[k] for k in members])
            begin = np.cumsum([0, *(len(self.words[k]) for k in members)])
            starts = np.concatenate([np.arange(b, b + len(self.words[k]) - size + 1) for b, k in zip(begin[:-1], members, strict=True)])
            owner = np.repeat(members, [len(self.words[k]) - size + 1 for k in members])
            offset = np.concatenate([np.arange(len(self.words[k]) - size + 1) for k in members])
            entries = []
            for t in range(walks.tables):
                h = walks.hashes(words, starts, t)
                order = np.argsort(h, kind="stable")
                entries.append((h[order], owner[order].astype(np.int32), offset[order].astype(np.int32), walks.sieves(words, starts, t)))
            self.sizes.append((walks, entries, max(self.most[k] for k in members)))

    def candidates(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(window start, item, offset in the item) of all windows within rows that meet an item's window."""
        out = [np.zeros((0, 3), np.int64)]
        before = known_before(self.known, words)
        for walks, entries, most in self.sizes:
            n = walks.size
            if len(words) < n:
                continue
            starts = np.flatnonzero(near_enough(before, n, most) & (row[n - 1 :] == row[: len(row) - n + 1]))
            if not len(starts):
                continue
            for t, (hashes, owner, offset, sieves) in enumerate(entries):
                begin, h = walks.sieved(words, starts, t, sieves)
                lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                met = np.flatnonzero(hi > lo)
                if len(met):
                    count = hi[met] - lo[met]
                    at = np.repeat(lo[met] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                    out.append(np.stack([np.repeat(begin[met], count), owner[at], offset[at]], 1))
        return np.unique(np.concatenate(out), axis=0)


def _blocks(items: DataFrame, id_col: str, text_col: str, max_edit: float, target: float):
    """Indexes of at most about BLOCK_BYTES each, items in order of id; one block at a time is on the driver."""
    part, weight, tables = [], 0, {}

    def made():
        by_size: dict[int, list[np.ndarray]] = {}
        for _, w in part:
            by_size.setdefault(window_size(len(w)), []).append(w)
        for size, members in by_size.items():
            if size not in tables:
                tables[size] = tables_for(members, size, max_edit, target)
        return Index(part, max_edit, tables)

    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        w = words_of(r.t)
        if len(w):
            part.append((r.i, w))
            weight += 32 * max(MOST_TABLES, tables.get(window_size(len(w)), 0)) * len(w)
            if weight >= BLOCK_BYTES:
                yield made()
                part, weight = [], 0
    if part:
        yield made()


def _places(index: Index, column: pa.Array):
    """For pieces of a text column: {(row, item): (distance, word after)} of the items that lie in them, each at its best place."""
    texts = Texts(column)
    for i, j in texts.pieces(PIECE_BYTES):
        raw = [texts.row(r).tobytes() for r in range(i, j)]
        raw = [x.lower() if x.isascii() else x.decode().lower().encode() for x in raw]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        begin, end = _spans(data)
        words = word_hashes(data, begin, end)
        first = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        row = np.repeat(np.arange(j - i), np.diff(first))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for start, item, offset in index.candidates(words, row).tolist():
            r, pattern, most = int(row[start]), index.words[item], index.most[item]
            place = (start - offset) // (most + 1)  # candidates of one place are looked at once
            if (r, item, place) in done or best.get((i + r, item), (1, 0))[0] == 0:
                continue
            done.add((r, item, place))
            since = max(int(first[r]), place * (most + 1) - most)
            until = min(int(first[r + 1]), (place + 1) * (most + 1) + len(pattern) + most)
            distance, after = edit_places(pattern, words[since:until])
            if distance <= most and distance < best.get((i + r, item), (most + 1, 0))[0]:
                best[i + r, item] = distance, since + after - int(first[r])
        if best:
            yield best


def contaminated(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT, target_recall: float = TARGET_RECALL, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, edit_distance, item_words, end_word): each item that lies in a document, at its best place."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edit_distance long, item_words long, end_word long"
    rows, found = id_and_text(docs), None

    def search(shared):
        def run(batches):
            index: Index = shared.value
            for b in batches:
                for best in _places(index, b.column(1)):
                    keys = sorted(best)
                    yield pa.record_batch({"doc_id": b.column(0).take(pa.array([r for r, _ in keys])), "item_id": pa.array([index.ids[k] for _, k in keys], pa.int64()), "edit_distance": pa.array([best[k][0] for k in keys], pa.int64()), "item_words": pa.array([len(index.words[k]) for _, k in keys], pa.int64()), "end_word": pa.array([best[k][1] for k in keys], pa.int64())})

        return run

    for index in _blocks(items, item_id, item_text, max_edit, target_recall):
        part = rows.mapInArrow(search(spark.sparkContext.broadcast(index)), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminated(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT, target_recall: float = TARGET_RECALL, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item lies, with all their columns.

    Each block of items filters the rows as they pass, so no row is found again by a key; after CHAINED blocks what is left is written.
    Rows without id, repeated rows, null, empty and very long texts and extra columns of any name are judged by their text alone.
    """
    names, spark = docs.columns, docs.sparkSession
    at = names.index("text")
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])

    def keep(shared):
        def run(batches):
            for b in batches:
                text = b.column(at)
                text = text.fill_null("") if text.null_count else text
                hit = np.zeros(b.num_rows, bool)
                for best in _places(shared.value, text):
                    hit[[r for r, _ in best]] = True
                yield b.filter(pa.array(~hit)) if hit.any() else b

        return run

    for k, index in enumerate(_blocks(items, item_id, item_text, max_edit, target_recall)):
        if k and k % CHAINED == 0:
            rows = written(rows, "rows")
        rows = rows.mapInArrow(lambda batches, f=keep(spark.sparkContext.broadcast(index)): trimmed(f(batches)), rows.schema)
    return rows.toDF(*names)
