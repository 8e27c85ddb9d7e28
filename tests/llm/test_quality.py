import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality as q
from tidemark.llm import queries


def test_held_out_documents_are_told_apart(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op5_quality(spark, sf).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == docs and len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9


GROUPS = [*"*#$%&!|.,;:?'\"-_/()<>=+@[]{}~^\\`", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", "\t\x0b\x0c\r"]


def brute_features(text):
    """What a text's features say, byte by byte, with plain loops."""
    data = text.encode()
    n, out = len(data), []
    if not n:
        return [0.0] * q.N_FEATURES
    kinds = [[ord(c) for c in g] for g in GROUPS] + [range(0x80, 0xC0), range(0xC0, 0x100), [*range(9), *range(14, 32), 127]]
    counts = [sum(b in kind for b in data) for kind in map(set, kinds)]
    out += [c / n for c in counts] + [math.log1p(c) / math.log1p(n) for c in counts]
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    part = [0.0] * 10
    letter = lambda b: b >= 0x80 or chr(b).isalpha()
    if words:
        m, size = len(words), [len(w) for w in words]
        mean = sum(size) / m
        part[:8] = [mean / 10, math.sqrt(sum((x - mean) ** 2 for x in size) / m) / 10, min(1, max(size) / 100), len(set(words)) / m, sum(not letter(w[-1]) for w in words) / m, sum(not letter(w[0]) for w in words) / m, sum(65 <= w[0] <= 90 for w in words) / m, math.log1p(m) / 10]
        part[8] = max(Counter(words).values()) / m
        if m >= 3:
            part[9] = len({tuple(words[i : i + 3]) for i in range(m - 2)}) / (m - 2)
    lines = [x for x in data.split(b"\n") if x]
    tail = [0.0] * 5
    if lines:
        k = len(lines)
        tail = [math.log1p(sum(map(len, lines)) / k) / 10, len(set(lines)) / k, sum(x[-1:] in (b".", b"!", b"?") for x in lines) / k, sum(65 <= x[0] <= 90 for x in lines) / k, math.log1p(k) / 10]
    return out + part + tail + [math.log1p(n)]


def test_whole_table_against_brute_force(spark, sf):
    """Every score of the query, from features and a ranking that plain loops work out again."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    made = {i: np.array(brute_features(t)) for i, t in texts.items()}
    for i, t in texts.items():
        assert q.features(np.frombuffer(t.encode(), np.uint8)) == pytest.approx(made[i], abs=1e-9)
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5)
    m = q.fit_ranking(np.array([made[i] for i, _ in known]), np.array([y for _, y in known]))
    below = sum(y == 0 for _, y in known)
    raw = {i: sum(w * min(8, max(-8, (x - a) / s)) for w, x, a, s in zip(m.weights, made[i], m.mean, m.scale, strict=True)) for i in texts}
    ordered = sorted(raw[i] for i, _ in known)
    cut = (ordered[below - 1] + ordered[below]) / 2
    assert m.cut == pytest.approx(cut)
    for r in queries.op5_quality(spark, sf).collect():
        odds = 0.3 / 0.7 * math.exp(min(30, max(-30, (raw[r.doc_id] - cut) / m.spread)))
        assert r.score == pytest.approx(odds / (1 + odds), abs=1e-6)


def test_gradient():
    r = np.random.default_rng(0)
    d, w = r.normal(size=(30, 5)), r.normal(size=5)
    _, g = q.pair_loss(w, d)
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        assert g[k] == pytest.approx((q.pair_loss(w + e, d)[0] - q.pair_loss(w - e, d)[0]) / 2e-6, abs=1e-5)


def test_bradley_terry_recovers_an_order():
    r = np.random.default_rng(1)
    x = r.normal(size=(800, q.N_FEATURES))
    true = np.zeros(q.N_FEATURES)
    true[:4] = [2, -1, 1.5, 0.5]
    label = (r.random(800) < 1 / (1 + np.exp(-(x @ true)))).astype(int)
    m = q.fit_ranking(x, label)
    y = r.normal(size=(500, q.N_FEATURES))
    assert np.corrcoef(m.raw(y), y @ true)[0, 1] > 0.9
    assert abs((m.score(x) < q.CUT).mean() - (label == 0).mean()) < 0.01


def test_all_pairs_teach():
    """At the learned weights the loss over all pairs is flat, and the cut lies at its rank."""
    r = np.random.default_rng(4)
    x, label = r.normal(size=(900, 6)) * [1, 2, 3, 4, 5, 0], np.arange(900) % 3 % 2
    x[:, 0] += label
    x[:, 1] -= label / 2
    m = q.fit_ranking(x, label)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    pairs = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, 6)
    assert len(pairs) == 180_000 and np.abs(q.pair_loss(m.weights, pairs)[1]).max() < 1e-6
    assert m.cut == pytest.approx(q.quantile_cut(z @ m.weights, 2 / 3), abs=1e-12)


def test_every_labelled_row_teaches(spark, docs_of):
    """More rows than any bound there was: the same as all of them learned in one place."""
    word = lambda i, k: chr(97 + (i * 7 + k) % 26) * (1 + (i + k) % 5)
    texts = [" ".join(word(i, k) for k in range(1 + i % 9)) + "!" * (i % 4 == 0) * (i % 3) for i in range(16_000)]
    label = [int(i % 4 != 0 or i % 5 == 0) for i in range(16_000)]
    docs = docs_of(list(enumerate(texts))).repartition(5)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(label)], "doc_id long, quality int, toxic int")
    got = q.train(q.featured(docs), labels)
    known = [i for i in range(16_000) if zlib.crc32(str(i).encode()) % 5]
    want = q.fit_ranking(np.array([q.features(np.frombuffer(texts[i].encode(), np.uint8)) for i in known]), np.array([label[i] for i in known]))
    assert len(known) > 12_000
    assert got.mean == pytest.approx(want.mean) and got.weights == pytest.approx(want.weights, abs=1e-6)
    assert got.cut == pytest.approx(want.cut, abs=1e-6) and got.spread == pytest.approx(want.spread)


def test_quantile_cut():
    s = np.array([3.0, 1.0, 2.0, 4.0])
    assert [(s < q.quantile_cut(s, k)).sum() for k in (0, 0.25, 0.5, 1)] == [0, 1, 2, 4]


def test_labels_of_the_held_out_fold_teach_nothing(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(q.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, q.quality_report(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n\n "), (None, "x"), (4, "*** !!! ***"), (4, "*** !!! ***"), (5, "word " * 300_000), (6, "é漢字"), (7, "\x00\x01")]
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, None, 1), (None, 1, 0), (99, 1, 1), (5, 1, 0), (5, 7, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_report(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).held_out is False
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.score == pytest.approx(0.3) for r in q.quality_report(docs_of(rows), few).collect())
    assert q.quality_report(docs_of([]), labels).count() == 0


def test_best_share(spark):
    df = spark.createDataFrame([(i, i / 100) for i in range(100)], "doc_id long, score double")
    assert {r.doc_id for r in q.best_share(df, 0.25).collect()} <= set(range(74, 100))
    assert q.best_share(df.limit(0), 0.25).count() == 0
