"""Documents scored by masked pseudo-likelihood: a small network predicts every word from the words on both sides.

The vocabulary is the FREQUENT most frequent words of the corpus, counted exactly over all documents, and a group of other words for
each four values of a word's first byte. For each place the network sees the words up to SIDE places to the left and to the right, not the word
itself: their embeddings, one after another, go through a hyperbolic tangent, and the word or group is predicted along its path
in a Huffman tree by exact counts, one logistic decision at each node. A word beyond the vocabulary is then spelled: its first
byte within the group, and each further byte, or the word's end, from the byte before, by exact counts over all documents. So
each score is of the word itself, whatever the size of the corpus, and the probabilities of all words at a place add up to one, or to
slightly less, as frequent words could be spelled too. A document's score is the sum over all its places of the log-probability of the word
that stands there.

Training is in numpy, within the tasks that read the corpus: each takes its own share of places through stochastic
gradient steps from common weights, and the weights are averaged, weighted by places (two rounds). A hash of the place
says in which round it is learned, so that the rounds take every place of every document once. The averages are formed in two steps by key, so that
the driver gets one set of weights, whatever the number of tasks; counts, too, are summed by key, and only the
vocabulary and a table of byte pairs reach the driver.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Nulls: a null or empty text has no place and scores 0; a null doc_id is
kept. Repeated rows count again. Ties among words go to the lower hash. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BREAKS, Texts, id_and_text, lower_ascii, mix64, word_hashes, word_spans, written

FREQUENT, GROUPS = 32_704, 64
SIDE, WIDTH, HIDDEN = 2, 8, 8
ROUNDS = 2
BATCH, RATE = 4096, 0.1
PIECE_BYTES = 1 << 20
#: Distinct words that a counting task holds before it sends its counts on, and buckets of words; the last key is of byte pairs.
HELD_WORDS, BUCKETS = 1 << 20, 64
#: Groups in which weights of tasks are averaged first.
AVERAGE_GROUPS = 64
#: The rarest node of the tree counts at least this share of the most frequent word, which bounds the depth.
LEAST_SHARE = 2.0**-22

_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[list(WORD_BREAKS)] = 0x20


class Piece:
    """The words of the rows i to j: hashes, first bytes, where each row's words begin, and the bytes with single spaces for white space."""

    def __init__(self, texts: Texts, i: int, j: int) -> None:
        raw = [texts.row(r).tobytes() for r in range(i, j)]
        self.data = _BLANKED[lower_ascii(np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8))]
        self.begin, self.end = word_spans(self.data)
        self.hashes = word_hashes(self.data, self.begin, self.end)
        self.lead = self.data[self.begin]
        self.first = np.searchsorted(self.begin, np.cumsum([1, *(len(x) + 1 for x in raw)]))

    def pairs(self) -> np.ndarray:
        """How often each byte follows each other within words, a space standing before and after each word."""
        code = self.data[:-1].astype(np.int64) << 8 | self.data[1:]
        out = np.bincount(code, minlength=1 << 16)
        out[0x2020] = 0
        return out


# ------------------------------------------------------------------------------------------------- vocabulary


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n, pairs): exact counts of the most frequent word hashes, FREQUENT of each bucket at most, and one row with the counts of byte
    pairs; rows: doc_id, text."""

    def count(batches):
        words, counts, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(1 << 16, np.int64)

        def merged():
            w, inverse = np.unique(np.concatenate(words), return_inverse=True)
            return w, np.bincount(inverse, np.concatenate(counts), len(w)).astype(np.int64)

        def sent(w, c):
            bucket = (w % np.uint64(BUCKETS)).astype(np.int64)
            for k in np.unique(bucket).tolist():
                own = bucket == k
                yield pa.record_batch({"bucket": pa.array([k], pa.int64()), "pack": pa.array([struct.pack("<q", int(own.sum())) + w[own].astype("<u8").tobytes() + c[own].astype("<u4").tobytes()], pa.binary())})

        for b in batches:
            texts = Texts(b.column(1))
            for i, j in texts.pieces(PIECE_BYTES):
                piece = Piece(texts, i, j)
                pairs += piece.pairs()
                w, c = np.unique(piece.hashes, return_counts=True)
                words.append(w)
                counts.append(c)
                if len(words) > 16:
                    w, c = merged()
                    words, counts = [w], [c]
                    if len(w) > HELD_WORDS:
                        yield from sent(w, c)
                        words, counts = [w[:0]], [c[:0]]
        yield from sent(*merged())
        if pairs.any():
            at = np.flatnonzero(pairs)
            yield pa.record_batch({"bucket": pa.array([BUCKETS], pa.int64()), "pack": pa.array([struct.pack("<q", len(at)) + at.astype("<u8").tobytes() + pairs[at].astype("<u8").tobytes()], pa.binary())})

    def add(batches):
        now, words, counts = None, [], []

        def settled():
            w, inverse = np.unique(np.concatenate(words), return_inverse=True)
            return w, np.bincount(inverse, np.concatenate(counts), len(w)).astype(np.int64)

        def best():
            w, n = settled()
            if now == BUCKETS:
                whole = np.zeros(1 << 16, "<i8")
                whole[w.astype(np.int64)] = n
                return pa.record_batch({"word": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "pairs": pa.array([whole.tobytes()], pa.binary())})
            top = np.lexsort((w, -n))[:FREQUENT]
            return pa.record_batch({"word": pa.array(w[top].astype(np.int64)), "n": pa.array(n[top]), "pairs": pa.nulls(len(top), pa.binary())})

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != now and words:
                    yield best()
                    words, counts = [], []
                now, data = k, x.as_py()
                (n,) = struct.unpack_from("<q", data)
                words.append(np.frombuffer(data, "<u8", n, 8))
                counts.append(np.frombuffer(data, "<u8" if k == BUCKETS else "<u4", n, 8 + 8 * n).astype(np.int64))
                if len(words) > 64:
                    w, c = settled()
                    words, counts = [w], [c]
        if words:
            yield best()

    sent = rows.mapInArrow(count, "bucket long, pack binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "word long, n long, pairs binary")


class Tree:
    """A Huffman tree over tokens by their counts: for each token its inner nodes from the root's side, and the branch taken at each."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        weight = np.maximum(counts.astype(float), max(1.0, float(counts.max())) * LEAST_SHARE)
        order = np.argsort(weight, kind="stable")
        total = np.concatenate([weight, np.zeros(n - 1)])
        parent, branch = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        leaves, leaf, inner = order.tolist(), 0, n
        mass = total.tolist()
        for made in range(n, 2 * n - 1):  # leaves and merged nodes both come in ascending weight
            two = []
            for _ in range(2):
                if leaf < n and (inner >= made or mass[leaves[leaf]] <= mass[inner]):
                    two.append(leaves[leaf])
                    leaf += 1
                else:
                    two.append(inner)
                    inner += 1
            parent[two] = made
            branch[two[1]] = 1
            mass[made] = mass[two[0]] + mass[two[1]]
        self.n_nodes = n - 1
        below = np.zeros((2 * n - 1, 2))
        np.add.at(below, (parent[: 2 * n - 2], branch[: 2 * n - 2]), np.array(mass[: 2 * n - 2]))
        self.bias = np.log(below[n:, 1] / below[n:, 0]).astype(np.float32)
        token, node, bit, at = [], [], [], np.arange(n)
        own = np.arange(n)
        while len(own):
            token.append(own)
            node.append(parent[at] - n)
            bit.append(branch[at])
            at = parent[at]
            own, at = own[at != 2 * n - 2], at[at != 2 * n - 2]
        token, node, bit = (np.concatenate(x) for x in (token, node, bit))
        order = np.argsort(token, kind="stable")
        self.nodes, self.bits = node[order], bit[order].astype(np.float32)
        self.depth = np.bincount(token, minlength=n)
        self.offset = np.cumsum(self.depth) - self.depth

    def paths(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node and branch of every step of the tokens' paths, the steps of each token, and where they begin."""
        count = self.depth[tokens]
        begin = np.cumsum(count) - count
        flat = np.repeat(self.offset[tokens] - begin, count) + np.arange(int(count.sum()))
        return self.nodes[flat], self.bits[flat], count, begin


class Vocabulary:
    """Words to tokens: frequent words by rank, others by their first byte; the tree over tokens, and how other words are spelled."""

    def __init__(self, words: list[int], counts: list[int], pairs: np.ndarray) -> None:
        self.by_rank = np.array(words, np.int64).astype(np.uint64)
        self.order = np.argsort(self.by_rank)
        self.sorted = self.by_rank[self.order]
        self.counts = np.array(counts, np.int64)
        self.n = len(words) + GROUPS
        self.blank = self.n  # what stands beyond a document's ends
        pairs = pairs.reshape(256, 256).astype(float)
        possible = np.ones(256)
        possible[list(WORD_BREAKS)] = 0
        lead = (pairs[0x20] + 0.5) * possible
        by_group = lead.reshape(GROUPS, -1).sum(axis=1)
        self.lead = np.log(np.maximum(lead, 1e-300) / np.repeat(np.maximum(by_group, 1e-300), 256 // GROUPS))
        possible[0x20] = 1  # the word's end
        follow = (pairs + 0.5) * possible
        self.follow = np.log(np.maximum(follow, 1e-300) / follow.sum(axis=1, keepdims=True)).ravel()
        others = max(1.0, pairs[0x20].sum() - self.counts.sum())
        self.tree = Tree(np.concatenate([self.counts, others * by_group / by_group.sum() + 1]))

    def __call__(self, hashes: np.ndarray, lead: np.ndarray) -> np.ndarray:
        other = len(self.sorted) + (lead.astype(np.int64) * GROUPS >> 8)
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], other)

    def spelled(self, piece: Piece, tokens: np.ndarray) -> np.ndarray:
        """Log-probability of each word beyond the vocabulary within its group; 0 for frequent words."""
        steps = np.concatenate([[0.0], np.cumsum(self.follow[piece.data[:-1].astype(np.int64) << 8 | piece.data[1:]])])
        own = self.lead[piece.lead] + steps[piece.end] - steps[piece.begin]
        return np.where(tokens >= len(self.sorted), own, 0.0)


def vocabulary(rows: DataFrame) -> Vocabulary:
    """The FREQUENT most frequent words and the byte pairs of all."""
    counted = written(count_words(rows), "words")
    top = counted.where("word is not null").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "n").toArrow()
    pairs = counted.where("pairs is not null").select("pairs").collect()
    return Vocabulary(top["word"].to_pylist(), top["n"].to_pylist(), np.frombuffer(pairs[0]["pairs"], "<i8") if pairs else np.zeros(1 << 16, np.int64))


# --------------------------------------------------------------------------------------------------- network


def shapes(vocab: Vocabulary) -> dict[str, tuple[int, ...]]:
    return {"embed": (vocab.n + 1, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "bias": (HIDDEN,), "node": (vocab.tree.n_nodes, HIDDEN), "node_bias": (vocab.tree.n_nodes,)}


def first_weights(vocab: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random embeddings, and nodes that predict words by their frequency alone."""
    r = np.random.default_rng(seed)
    s = shapes(vocab)
    w = {k: np.zeros(v, np.float32) for k, v in s.items()}
    w["embed"] = (r.normal(size=s["embed"]) * 0.3).astype(np.float32)
    w["inner"] = (r.normal(size=s["inner"]) / np.sqrt(s["inner"][0])).astype(np.float32)
    w["node_bias"] = vocab.tree.bias.copy()
    return w


def contexts(tokens: np.ndarray, first: np.ndarray, blank: int) -> np.ndarray:
    """The 2 * SIDE words around each place, blank beyond the ends of its document."""
    n = len(tokens)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * SIDE), blank, np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = np.arange(max(0, -step), min(n, n - step))
        same = doc[at] == doc[at + step]
        out[at[same], k] = tokens[at[same] + step]
    return out


def _hidden(w: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = w["embed"][context].reshape(len(context), -1)
    return e, np.tanh(e @ w["inner"] + w["bias"])


def _steps(w: dict, tree: Tree, h: np.ndarray, tokens: np.ndarray):
    """What each step of the tokens' paths has: node, branch, the hidden state, the node's weights, their sum of products."""
    node, bit, count, begin = tree.paths(tokens)
    across, down = np.repeat(h, count, axis=0), np.take(w["node"], node, axis=0)
    return node, bit, begin, across, down, np.einsum("ij,ij->i", across, down) + w["node_bias"][node]


def _surprise(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """-log P(branch) for each step."""
    z = z * (1 - 2 * bit)
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def log_probabilities(w: dict, tree: Tree, context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Log-probability of each token in its context."""
    out = np.empty(len(tokens), np.float64)
    for a in range(0, len(tokens), BATCH):
        t = tokens[a : a + BATCH]
        _, h = _hidden(w, context[a : a + BATCH])
        _, bit, begin, _, _, z = _steps(w, tree, h, t)
        out[a : a + BATCH] = -np.add.reduceat(_surprise(z, bit), begin)
    return out


def loss(w: dict, tree: Tree, context: np.ndarray, tokens: np.ndarray) -> float:
    """Mean negative log-likelihood of the tokens."""
    _, h = _hidden(w, context)
    _, bit, _, _, _, z = _steps(w, tree, h, tokens)
    return float(_surprise(z, bit).sum() / len(tokens))


def gradient(w: dict, tree: Tree, context: np.ndarray, tokens: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of `loss`."""
    n = len(tokens)
    e, h = _hidden(w, context)
    node, bit, begin, across, down, z = _steps(w, tree, h, tokens)
    d = (1 / (1 + np.exp(-z)) - bit) / n
    g = {"node": np.empty((tree.n_nodes, across.shape[1])), "node_bias": np.bincount(node, d, tree.n_nodes)}
    across *= d[:, None]
    for k in range(across.shape[1]):
        g["node"][:, k] = np.bincount(node, across[:, k], tree.n_nodes)
    down *= d[:, None]
    d_h = np.add.reduceat(down, begin, axis=0)
    d_in = d_h * (1 - h * h)
    g["inner"], g["bias"] = e.T @ d_in, d_in.sum(axis=0)
    d_e = (d_in @ w["inner"].T).reshape(-1, WIDTH)
    flat = context.ravel()
    g["embed"] = np.array([np.bincount(flat, d_e[:, k], len(w["embed"])) for k in range(WIDTH)]).T
    return g


class Trainer:
    """Adagrad from common weights; only what a batch has touched is moved."""

    def __init__(self, weights: dict[str, np.ndarray], tree: Tree, rate: float = RATE) -> None:
        self.w, self.tree, self.rate, self.seen = {k: v.copy() for k, v in weights.items()}, tree, rate, 0
        self.sums = {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    def learn(self, context: np.ndarray, tokens: np.ndarray) -> None:
        for a in range(0, len(tokens), BATCH):
            part = tokens[a : a + BATCH]
            g = gradient(self.w, self.tree, context[a : a + BATCH], part)
            self.seen += len(part)
            nodes, words = np.flatnonzero(g["node_bias"]), np.flatnonzero(g["embed"][:, 0])
            for k, at in (("inner", ...), ("bias", ...), ("node_bias", nodes), ("node", nodes), ("embed", words)):
                x = g[k][at].astype(np.float32)
                total = self.sums[k][at] + x * x
                self.sums[k][at] = total
                self.w[k][at] -= self.rate * x / np.sqrt(total)


def packed(w: dict) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in ("embed", "inner", "bias", "node", "node_bias"))


def unpacked(data: bytes, of: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in of.items():
        n = int(np.prod(s))
        out[k] = np.frombuffer(data, "<f4", n, at).reshape(s).copy()
        at += 4 * n
    return out


def _averaged(parts: DataFrame, key: str) -> DataFrame:
    """(key, weight, data): the weighted mean of the packed weights of each key, one row in hand at a time."""

    def run(batches):
        now, total, weight = None, None, 0.0

        def row():
            return pa.record_batch({key: pa.array([now], pa.int64()), "weight": pa.array([weight]), "data": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())})

        for b in batches:
            for k, x, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now and now is not None:
                    yield row()
                    total, weight = None, 0.0
                now = k
                own = np.frombuffer(data, "<f4").astype(np.float64) * x
                total = own if total is None else total + own
                weight += x
        if now is not None:
            yield row()

    return parts.select(key, "weight", "data").repartition(key).sortWithinPartitions(key, "weight", "data").mapInArrow(run, f"{key} long, weight double, data binary")


def train(rows: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """The network's weights after ROUNDS rounds over the corpus; rows: doc_id, text."""
    context, weights = rows.sparkSession.sparkContext, first_weights(vocab)
    known = context.broadcast(vocab)
    for turn in range(ROUNDS):

        def learn(batches, start=context.broadcast(weights), turn=turn):
            from pyspark import TaskContext

            vocab = known.value
            t = Trainer(start.value, vocab.tree, RATE / (1 + turn))
            for b in batches:
                texts = Texts(b.column(1))
                for i, j in texts.pieces(PIECE_BYTES):
                    piece = Piece(texts, i, j)
                    tokens = vocab(piece.hashes, piece.lead)
                    place = np.arange(len(tokens), dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        mine = np.flatnonzero(mix64(piece.hashes + place * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ROUNDS) == turn)
                    if len(mine):
                        mine = mine[np.argsort(mix64(mine.astype(np.uint64)))]  # neighbours don't follow each other
                        t.learn(contexts(tokens, piece.first, vocab.blank)[mine], tokens[mine])
            if t.seen:
                yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId() % AVERAGE_GROUPS], pa.int64()), "weight": pa.array([float(t.seen)]), "data": pa.array([packed(t.w)], pa.binary())})

        parts = rows.mapInArrow(learn, "part long, weight double, data binary")
        whole = _averaged(_averaged(parts, "part").withColumn("all", F.lit(0).cast("long")), "all").collect()
        if not whole:
            break
        weights = unpacked(bytes(whole[0]["data"]), shapes(vocab))
    return weights


def scored(rows: DataFrame, vocab: Vocabulary, weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_words, log_probability (the sum over all words), mean_log_probability (null without words)."""
    shared = rows.sparkSession.sparkContext.broadcast((vocab, weights))

    def run(batches):
        vocab, weights = shared.value
        for b in batches:
            texts = Texts(b.column(1))
            for i, j in texts.pieces(PIECE_BYTES):
                piece = Piece(texts, i, j)
                tokens = vocab(piece.hashes, piece.lead)
                each = log_probabilities(weights, vocab.tree, contexts(tokens, piece.first, vocab.blank), tokens) + vocab.spelled(piece, tokens)
                total = np.concatenate([[0.0], np.cumsum(each)])
                sums, n = total[piece.first[1:]] - total[piece.first[:-1]], np.diff(piece.first)
                yield pa.record_batch({"doc_id": b.column(0).slice(i, j - i), "n_words": pa.array(n.astype(np.int64)), "log_probability": pa.array(sums)})

    out = rows.mapInArrow(run, "doc_id long, n_words long, log_probability double")
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))


def lm_report(docs: DataFrame) -> DataFrame:
    """Count, train and score over all documents."""
    rows = id_and_text(docs)
    vocab = vocabulary(rows)
    return scored(rows, vocab, train(rows, vocab))
