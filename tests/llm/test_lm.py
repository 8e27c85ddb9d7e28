import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm, queries
from tidemark.llm.common import Texts, id_and_text

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def piece_of(text):
    return lm.Piece(Texts(pa.array([text or ""])), 0, 1)


def spelled(pairs, word):
    """The log-probability of a word's letters within its group, by the counts themselves."""
    allowed = [b for b in range(256) if b not in (0x20, 9, 10, 11, 12, 13)]
    group = [b for b in allowed if b // 4 == word[0] // 4]
    total = math.log((pairs[0x20 << 8 | word[0]] + 0.5) / sum(pairs[0x20 << 8 | b] + 0.5 for b in group))
    for a, b in zip(word, [*word[1:], 0x20], strict=True):
        total += math.log((pairs[a << 8 | b] + 0.5) / sum(pairs[a << 8 | x] + 0.5 for x in [*allowed, 0x20]))
    return total


def brute(vocab, w, text, pairs):
    """The score of a text, word by word and step by step, with plain loops."""
    piece = piece_of(text)
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    numbers = vocab(piece.hashes, piece.lead).tolist()
    total = 0.0
    for i, t in enumerate(numbers):
        around = [numbers[i + k] if 0 <= i + k < len(numbers) else vocab.blank for k in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([w["embed"][a] for a in around]).astype(float) @ w["inner"].astype(float) + w["bias"])
        for step in range(vocab.tree.offset[t], vocab.tree.offset[t] + vocab.tree.depth[t]):
            node, bit = vocab.tree.nodes[step], vocab.tree.bits[step]
            z = float(h @ w["node"][node]) + float(w["node_bias"][node])
            total -= math.log1p(math.exp(-z if bit else z))
        if t >= len(vocab.by_rank):
            total += spelled(pairs, words[i])
    return total


def random_vocabulary(n=40, seed=0):
    r = np.random.default_rng(seed)
    return lm.Vocabulary(np.sort(r.integers(0, 1 << 60, n)).tolist(), sorted(r.integers(1, 1000, n).tolist(), reverse=True), r.integers(0, 50, 1 << 16))


def test_counts_are_exact(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 5000)
    docs = id_and_text(spark.read.parquet(f"{sf}/documents.parquet"))
    counts, pairs = Counter(), Counter()
    for r in docs.collect():
        for word in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), r.text.encode())):
            counts[word] += 1
            pairs.update(zip(b" " + word, word + b" ", strict=True))
    v = lm.vocabulary(docs)
    want = sorted(counts.values(), reverse=True)[: lm.FREQUENT]
    assert v.counts.tolist() == want
    by_hash = {int(piece_of(k.decode()).hashes[0]): n for k, n in counts.most_common(200)}
    assert all(by_hash[int(h)] == n for h, n in zip(v.by_rank[:50].tolist(), v.counts[:50].tolist(), strict=True))
    (row,) = lm.count_words(docs).where("pairs is not null").collect()
    got = np.frombuffer(row.pairs, "<i8")
    assert {(i >> 8, i & 255): n for i, n in enumerate(got.tolist()) if n} == dict(pairs)


def test_probabilities_add_up():
    """Over all tokens at a place, and over all bytes that may follow a byte."""
    v = random_vocabulary()
    r = np.random.default_rng(1)
    w = {k: r.normal(size=x.shape).astype(np.float32) * 0.3 for k, x in lm.first_weights(v).items()}
    context = np.repeat(r.integers(0, v.n + 1, (1, 4)), v.n, axis=0)
    assert np.exp(lm.log_probabilities(w, v.tree, context, np.arange(v.n))).sum() == pytest.approx(1, abs=1e-4)
    follow = np.exp(v.follow.reshape(256, 256))
    assert np.allclose(follow.sum(axis=1), 1) and np.allclose(np.exp(v.lead).reshape(lm.GROUPS, -1).sum(axis=1)[16:], 1)
    plain = np.exp(lm.log_probabilities(lm.first_weights(v), v.tree, context, np.arange(v.n)))  # by frequency alone
    assert np.allclose(plain[:40] / plain[0], v.counts / v.counts[0], rtol=1e-3)


def test_tree_is_short():
    """No worse than Huffman's bound: the mean depth is within one step of the entropy."""
    for seed in range(4):
        counts = np.random.default_rng(seed).pareto(1.0, 300) * 100 + 1
        tree = lm.Tree(counts)
        p = counts / counts.sum()
        assert -(p * np.log2(p)).sum() <= (p * tree.depth).sum() < -(p * np.log2(p)).sum() + 1
        assert tree.depth.max() <= 40 and sum(2.0 ** -tree.depth) == pytest.approx(1)


def test_gradient():
    v = random_vocabulary()
    r = np.random.default_rng(0)
    w = {k: r.normal(size=s) * 0.3 for k, s in lm.shapes(v).items()}
    context, tokens = r.integers(0, v.n + 1, (20, 4)), r.integers(0, v.n, 20)
    g = lm.gradient(w, v.tree, context, tokens)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        e = 1e-5
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += e
        down[k][at] -= e
        assert g[k][at] == pytest.approx((lm.loss(up, v.tree, context, tokens) - lm.loss(down, v.tree, context, tokens)) / (2 * e), rel=1e-3)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 3])
def test_scores_against_brute_force_and_odd_rows(docs_of, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    texts = ["a b c d a b c d e", None, "", " \n", "one", "the cat The CAT the cat", "x " * 30_000, "漢字 é\x00 ~"]
    rows = id_and_text(docs_of([*enumerate(texts), (None, "a b"), (5, texts[5])]))
    vocab = lm.vocabulary(rows)
    weights = lm.train(rows, vocab)
    pairs = np.frombuffer(lm.count_words(rows).where("pairs is not null").first().pairs, "<i8")
    got = lm.scored(rows, vocab, weights).collect()
    assert len(got) == 10
    for r in got:
        text = "a b" if r.doc_id is None else texts[r.doc_id]
        n = len(WORD.findall((text or "").encode()))
        assert r.n_words == n and (r.mean_log_probability is None) == (n == 0)
        if n < 100:
            assert r.log_probability == pytest.approx(brute(vocab, weights, text or "", pairs), abs=1e-3)
    empty = id_and_text(docs_of([]))
    assert lm.lm_report(docs_of([])).count() == 0 and len(lm.vocabulary(empty).counts) == 0


def test_training_helps_on_held_out_documents(spark, sf):
    """Documents that weren't trained on score higher than by frequency alone, and than with their words in another order."""
    docs = id_and_text(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("n_chars > 500"))
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    vocab = lm.vocabulary(train)
    weights = lm.train(train, vocab)
    mean = lambda df, w: np.mean([r.mean_log_probability for r in lm.scored(df, vocab, w).collect()])
    trained, plain = mean(held, weights), mean(held, lm.first_weights(vocab))
    r = np.random.default_rng(0)
    mixed = spark.createDataFrame([(x.doc_id, " ".join(r.permutation(x.text.split()))) for x in held.collect()], "doc_id long, text string")
    assert trained > plain + 0.05
    assert trained > mean(mixed, weights)


def test_every_place_is_learned_once(docs_of, monkeypatch):
    seen, averaged = [], lm._averaged

    def watched(parts, key):
        if key == "part":
            seen.append(sum(r.weight for r in parts.select("weight").collect()))
        return averaged(parts, key)

    monkeypatch.setattr(lm, "_averaged", watched)
    rows = id_and_text(docs_of([(i, " ".join(f"w{i * k % 17}" for k in range(i))) for i in range(60)]))
    lm.train(rows, lm.vocabulary(rows))
    assert len(seen) == lm.ROUNDS and sum(seen) == sum(range(60))


def test_averages(spark):
    v = random_vocabulary()
    w = {k: np.ones(x, np.float32) for k, x in lm.shapes(v).items()}
    parts = spark.createDataFrame([(0, 1.0, bytearray(lm.packed(w))), (1, 3.0, bytearray(lm.packed({k: x * 5 for k, x in w.items()})))], "part long, weight double, data binary")
    from pyspark.sql import functions as F

    whole = lm._averaged(lm._averaged(parts, "part").withColumn("all", F.lit(0).cast("long")), "all").collect()
    assert len(whole) == 1 and whole[0]["weight"] == 4.0
    assert np.allclose(lm.unpacked(bytes(whole[0]["data"]), lm.shapes(v))["embed"], 4.0)


def test_whole_table(spark, sf):
    got = queries.op9_lm_scoring(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_words for r in got} == {k: len(WORD.findall(t.encode())) for k, t in docs.items()}
    assert all(r.log_probability < 0 for r in got if r.n_words)
