"""Byte-level BPE as a bounded-lookahead streaming transducer, and its streaming decoder.

The merge list alone fixes a *sufficient lookahead* L: tokens that end L bytes before the end of what has
been read cannot change, whatever follows. (Berglund and van der Merwe, "Formalizing BPE Tokenization",
2023, define the constant; `MergeList.lookahead` computes a bound from chains of merges.) No merge crosses the end of a
pre-token, so there the tokens stand as soon as a few characters show that it has ended. So an encoder emits what is
certain with each piece that it is fed, and holds no more than a window of some L bytes of an open pre-token, however
long that is: memory is constant however long the text is, and a piece of any size gives the same ids. Ids of
pre-tokens up to L characters are remembered, which changes speed only.

Nulls: a null text counts as empty and gives no ids. A null doc_id is passed through. Repeated rows give
repeated results. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import WHITE_SPACE, id_and_text, is_latin1, trimmed

#: Words whose ids a worker remembers; beyond it the memory is emptied. It changes speed, never results.
CACHED_WORDS = 250_000
#: Characters that are handed to an encoder at once.
FEED_CHARS = 1 << 14


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def _classes(top: int) -> tuple[str, str]:
    """Bodies of regular-expression classes for letters and for numbers up to code point `top`."""
    out = []
    for major in "LN":
        spans, begin = [], None
        for cp in range(top + 2):
            has = cp <= top and unicodedata.category(chr(cp))[0] == major
            if has and begin is None:
                begin = cp
            elif not has and begin is not None:
                spans.append(f"{re.escape(chr(begin))}-{re.escape(chr(cp - 1))}")
                begin = None
        out.append("".join(spans))
    return out[0], out[1]


@lru_cache(2)
def pretoken_pattern(top: int) -> re.Pattern:
    """The usual byte-level pre-token pattern: contractions, letters, numbers, other signs, white space."""
    letter, number = _classes(top)
    s = WHITE_SPACE
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{s}{letter}{number}]+|[{s}]+(?![^{s}])|[{s}]+")


_SAFE_CUT = re.compile(rf"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])")
_SPACE = re.compile(rf"[{WHITE_SPACE}]")


class MergeList:
    """Vocabulary and merges of a byte-level BPE tokenizer, from its JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): (rank, ab) for rank, (a, b, ab) in enumerate(self.merges)}
        self.joined = {a << 32 | b: rank << 32 | ab for (a, b), (rank, ab) in self.rank.items()}  # the same as plain numbers
        self.decimal = [str(i) for i in range(size)]

    @property
    def lookahead(self) -> int:
        """Bytes beyond a token's end that decide whether the token stands.

        Two texts with a common prefix agree, merge by merge, on the tokens left of a frontier, at first the
        prefix's end. Merge (a, b) moves the frontier only if a ends there, and then by len(a); the token that now
        starts at the frontier has a on its left spine. So the frontier moves along chains of ever later merges
        (a1, b1), (a2, b2), ... with a1 on b2's left spine and so on, and the heaviest chain, by the lengths of the
        a's, bounds the way it goes. One pass from the last merge to the first finds it.
        """
        if not hasattr(self, "_lookahead"):
            left: dict[int, list[int]] = {}
            for a, _, ab in self.merges:
                left.setdefault(ab, []).append(a)

            def spine(token: int) -> set[int]:
                seen, todo = set(), [token]
                while todo:
                    t = todo.pop()
                    if t not in seen:
                        seen.add(t)
                        todo += left.get(t, ())
                return seen

            best: dict[int, int] = {}
            most = 0
            for a, b, _ in reversed(self.merges):
                weight = len(self.token_bytes[a]) + best.get(a, 0)
                most = max(most, weight)
                for t in spine(b):
                    if best.get(t, 0) < weight:
                        best[t] = weight
            self._lookahead = most
        return self._lookahead

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of a byte string by the merges alone; the best merge first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 48:
            return self._encode_long(ids)
        get, none = self.joined.get, 1 << 64
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of merges over a linked list, for long windows."""
        n, rank = len(ids), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, ab = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = ab, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if found := rank.get((ab, ids[after[i]])):
                    heapq.heappush(queue, (found[0], i, ab, ids[after[i]], found[1]))
            if before[i] >= 0 and (found := rank.get((ids[before[i]], ab))):
                heapq.heappush(queue, (found[0], before[i], ids[before[i]], ab, found[1]))
        return [t for t in ids if t >= 0]


class BytesTransducer:
    """Bytes of one pre-token in, stable ids out; holds a window of a few lookaheads."""

    def __init__(self, merges: MergeList) -> None:
        self.merges, self.held = merges, b""
        self.window = max(64, 4 * merges.lookahead)

    def feed(self, data: bytes) -> Iterator[int]:
        # a window at a time, so that the buffer never holds more than a window and its lookahead
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) >= self.window:
                stable = len(self.held) - self.merges.lookahead
                done = 0
                for token in self.merges.encode_bytes(self.held):
                    end = done + len(self.merges.token_bytes[token])
                    if end > stable:
                        break
                    yield token
                    done = end
                self.held = self.held[done:]

    def finish(self) -> list[int]:
        out, self.held = self.merges.encode_bytes(self.held), b""
        return out


class _Words(dict):
    """Ids of the words met so far, emptied when it holds CACHED_WORDS."""

    def __init__(self, merges: MergeList) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(word) > self.merges.lookahead:
            whole = BytesTransducer(self.merges)
            data = word.encode()
            return (*whole.feed(data), *whole.finish())
        ids = tuple(self.merges.encode_bytes(word.encode()))
        if len(word) < 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class StreamingEncoder:
    """Text in pieces in, ids out: `feed` returns the ids that are certain, `finish` the rest.

    Held between calls: less than a special token's length, and of the pre-token that may go on a lookahead's characters, or if it
    is longer its transducer's window.
    """

    def __init__(self, merges: MergeList, words: _Words | None = None) -> None:
        self.merges, self.words = merges, _Words(merges) if words is None else words
        self.special = re.compile("|".join(map(re.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None
        self.longest = max(map(len, merges.specials), default=1)
        self.tail = ""  # may be the start of a special token
        self.open = ""  # plain text whose pre-tokens aren't certain
        self.run: tuple[BytesTransducer, re.Pattern, bool] | None = None  # a long pre-token that goes on
        self.long = max(8, merges.lookahead)

    @property
    def held(self) -> int:
        """Characters, or bytes of a long pre-token, that wait for what follows."""
        return len(self.tail) + len(self.open) + (len(self.run[0].held) if self.run else 0)

    def feed(self, text: str) -> list[int]:
        if self.special is None:
            return self._plain(text)
        text, out, at = self.tail + text, [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out += self._end()
            out.append(self.merges.specials[m[0]])
            at = m.end()
        keep = next((k for k in range(min(self.longest - 1, len(text) - at), 0, -1) if any(s.startswith(text[len(text) - k :]) for s in self.merges.specials)), 0)
        self.tail = text[len(text) - keep :]
        out += self._plain(text[at : len(text) - keep])
        return out

    def finish(self) -> list[int]:
        tail, self.tail = self.tail, ""
        return [*self._plain(tail), *self._end()]

    def _pretokens(self, text: str) -> list[str]:
        return pretoken_pattern(0xFFFF if is_latin1(text) or max(text) <= "\uffff" else 0x10FFFF).findall(text)

    def _ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self._pretokens(text)))) if text else []

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        if self.run is not None:
            text, self.open = self.open + text, ""
            transducer, more, spaces = self.run
            end = more.match(text).end()
            if end == len(text):  # of white space the last character may belong to what follows
                keep = 1 if spaces and end else 0
                self.open = text[end - keep :]
                return [*transducer.feed(text[: end - keep].encode())]
            if spaces:  # the run's last character stands alone or before what follows
                self.open = ""
                if end:
                    out += transducer.feed(text[: end - 1].encode())
                    end -= 1
            else:
                out += transducer.feed(text[:end].encode())
            out += transducer.finish()
            self.run, text = None, text[end:]
        self.open += text
        cut = self._last_cut()
        out += self._ids(self.open[:cut])
        self.open = self.open[cut:]
        if len(self.open) > self.long:
            out += self._long()
        return out

    def _last_cut(self) -> int:
        """The end of the last sign that white space follows; looked for from the end, in growing pieces."""
        size, n = 64, len(self.open)
        while True:
            begin = max(0, n - size)
            found = [m.end() for m in _SAFE_CUT.finditer(self.open, begin)]
            if found or not begin:
                return found[-1] if found else 0
            size *= 8

    def _long(self) -> list[int]:
        """Pre-tokens of `open` that have surely ended; then one that goes on, if it is long, through its transducer."""
        out, at, text = [], 0, self.open
        pattern = pretoken_pattern(0x10FFFF if max(text) > "\uffff" else 0xFFFF)
        for m in pattern.finditer(text):
            if m.end() > len(text) - 3:
                break
            out += self.words[m[0]]
            at = m.end()
        self.open = text[at:]
        if len(self.open) > self.long:
            letter, number = _classes(0x10FFFF)
            body = self.open[1:] if self.open[0] == " " and not _SPACE.match(self.open[1]) else self.open
            major = unicodedata.category(body[0])[0]
            spaces = bool(_SPACE.match(body[0]))
            kind = f"[{WHITE_SPACE}]*" if spaces else f"[{letter}]*" if major == "L" else f"[{number}]*" if major == "N" else f"[^{WHITE_SPACE}{letter}{number}]*"
            more = re.compile(kind)
            end = len(self.open) - len(body) + more.match(body).end()
            if end >= len(self.open) - 3 and end > self.long:
                end -= 3  # a few characters stay, for they may yet belong to the next pre-token
                transducer = BytesTransducer(self.merges)
                self.run = (transducer, more, spaces)
                out += transducer.feed(self.open[:end].encode())
                self.open = self.open[end:]
        return out

    def _end(self) -> list[int]:
        out: list[int] = []
        if self.run is not None:
            transducer, more, _ = self.run
            end = more.match(self.open).end()
            out += transducer.feed(self.open[:end].encode())
            out += transducer.finish()
            self.run, self.open = None, self.open[end:]
        out += self._ids(self.open)
        self.open = ""
        return out


class StreamingDecoder:
    """Ids in pieces in, text out. Its state is the bytes of one unfinished character; bytes that form none give U+FFFD."""

    def __init__(self, merges: MergeList) -> None:
        self.bytes_of = merges.token_bytes.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(4)
def load_merges(path: str) -> tuple[MergeList, _Words]:
    """The tokenizer at `path` and its words, once for each worker."""
    merges = MergeList(path)
    return merges, _Words(merges)


def encode_text(path: str, text: str) -> list[int]:
    merges, words = load_merges(path)
    stream, out = StreamingEncoder(merges, words), []
    for at in range(0, len(text), FEED_CHARS):
        out += stream.feed(text[at : at + FEED_CHARS])
    return out + stream.finish()


def bpe_encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "ids": pa.array([encode_text(tokenizer, t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))})

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of every array of ids (null: empty)."""

    def run(batches):
        merges, _ = load_merges(tokenizer)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                d = StreamingDecoder(merges)
                texts.append(d.feed(ids or ()) + d.finish())
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text in one pass, feed by feed, keeping only counts and digests, and on wish the ids.

    Without the ids, neither these nor the decoded text of a document are ever held whole.
    """

    def digests(merges: MergeList, words: _Words, text: str) -> tuple:
        encoder, decoder = StreamingEncoder(merges, words), StreamingDecoder(merges)
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        kept = array("i")
        decimal = merges.decimal.__getitem__

        def take(ids: list[int]) -> None:
            nonlocal n
            if ids:
                ids_hash.update(("," * bool(n) + ",".join(map(decimal, ids))).encode())
                text_hash.update(decoder.feed(ids).encode())
                n += len(ids)
                if with_ids:
                    kept.extend(ids)

        for at in range(0, len(text), FEED_CHARS):
            take(encoder.feed(text[at : at + FEED_CHARS]))
        take(encoder.finish())
        text_hash.update(decoder.finish().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest(), kept

    def run(batches):
        merges, words = load_merges(tokenizer)
        for b in batches:
            rows = [digests(merges, words, t) for t in b.column(1).to_pylist()]
            n, i, d, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(i, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
            if with_ids:
                ends = pa.array([0, *accumulate(n)], pa.int32())
                made["ids"] = pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.Array.from_buffers(pa.int32(), len(k), [None, pa.py_buffer(k)]) for k in kept] or [pa.array([], pa.int32())]))
            yield pa.record_batch(made)

    return id_and_text(docs).mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
