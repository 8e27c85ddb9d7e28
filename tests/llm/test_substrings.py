import hashlib
import random
import re

import pytest

from tidemark.llm import queries, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, kept words) of every row by a table of all windows."""
    docs = sorted({(i is None, i or 0, x or "") for i, x in rows})
    first: dict = {}
    cut = {}
    import pyspark.sql.functions  # noqa: F401

    order = {}
    for d in docs:
        order.setdefault(d[:2], []).append(d)
    for key in sorted(order):
        for d in order[key]:
            words = WORD.findall(d[2].encode())
            gone = [False] * len(words)
            for s in range(len(words) - window + 1):
                w = tuple(words[s : s + window])
                if w in first:
                    gone[s : s + window] = [True] * window
                else:
                    first[w] = (d, s)
            cut[d] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return [(i, *cut[i is None, i or 0, x or ""]) for i, x in rows]


def run(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in substrings.dedup_substrings(df).collect()), key=str)


def made(n, seed, vocabulary=400):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(vocabulary)] + ["é", "漢字", "The"]
    passages = [[r.choice(words) for _ in range(r.randint(15, 80))] for _ in range(8)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randint(0, 4)):
            out += [r.choice(words) for _ in range(r.randint(0, 60))]
            if r.random() < 0.6:
                p = list(r.choice(passages))
                if r.random() < 0.3:
                    p[r.randrange(len(p))] = "changed"
                out += p
        rows.append((i, "".join(w + r.choice([" ", "  ", "\n", "\t ", "\x0b"]) for w in out)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE_BYTES", 3000)
    rows = made(250, seed)
    random.Random(seed).shuffle(rows)
    assert run(docs_of(rows)) == sorted(brute(rows), key=str)


def test_odd_rows(docs_of):
    again = " ".join(["echo"] * 60)
    long = " ".join(f"u{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "few words"), (5, again), (6, again), (None, again), (None, None), (7, long), (8, long + " end"), (9, "a b"), (9, "a b"), (10, " ".join(map(str, range(20)))), (10, " ".join(map(str, range(20)))), (11, " ".join(map(str, range(-1, 25))))]
    assert run(docs_of(rows)) == sorted(brute(rows), key=str)
    assert run(docs_of([])) == []


def test_hot_buckets_are_reduced_in_steps(docs_of, monkeypatch):
    """Every run of words is taken for a crowded one, and a task reduces what it has gathered after a few hundred bytes."""
    import numpy as np

    rows = made(150, 7, 60)
    runs = [w.words for _, x in rows for w in [_windows(x)] if w is not None]
    crowded = np.unique(np.concatenate([substrings.run_hashes(x, substrings.MINIMISER, 1) for x in runs]))
    monkeypatch.setattr(substrings, "frequent_runs", lambda _: (np.zeros(0, np.uint64), crowded))
    monkeypatch.setattr(substrings, "GATHERED_BYTES", 300)
    monkeypatch.setattr(substrings, "PIECE_BYTES", 2000)
    assert run(docs_of(rows)) == sorted(brute(rows), key=str)


def _windows(text):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0])] * 4 + [pa.array([text])], names=["doc", "null", "hi", "lo", "text"])
    return next(substrings._documents(batch, 1 << 20), None)


@pytest.mark.parametrize("most", [200_000, 0])
def test_rows_of_one_id_are_documents_of_their_own(docs_of, monkeypatch, most):
    """Texts of one id, or of none, are told apart, whether few ids or all rows carry digests; equal rows are one document."""
    monkeypatch.setattr(substrings, "AMBIGUOUS_IDS", most)
    passage = " ".join(f"p{i}" for i in range(25))
    for ids in ((7, 7), (None, None), (7, 8), (8, None)):
        got = run(docs_of([(ids[0], f"one {passage}"), (ids[1], f"two {passage}"), (3, "nothing")]))
        assert sorted(n for _, _, n, _ in got) == [0, 0, 25]
    same = run(docs_of([(7, f"one {passage}"), (7, f"one {passage}"), (7, f"two {passage}")]))
    assert sorted(n for _, _, n, _ in same) in ([0, 0, 25], [0, 25, 25])


def test_other_columns_stay(docs_of):
    got = substrings.dedup_substrings(docs_of([(1, "x", "en", "s")]))
    assert got.columns[-3:] == ["kept_text", "n_words", "n_removed"]
    assert got.first().kind == "clash" and got.first().lang == "en"


def test_columns_named_like_what_is_added(spark):
    """What is added comes last; the pipeline's stage cuts such documents too and keeps their columns."""
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5, "a", 6), (2, text, 7, "b", 8)], "doc_id long, text string, n_words int, kept_text string, n_removed int")
    got = substrings.dedup_substrings(docs)
    assert got.columns == [*docs.columns, "kept_text", "n_words", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, text, 5, "a", 6, text, 30, 0), (2, text, 7, "b", 8, "", 30, 30)]
    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    assert sorted(tuple(r) for r in cut.collect()) == [(1, text, 5, "a", 6), (2, "", 7, "b", 8)]


def test_equal_hashes_are_told_apart(docs_of, monkeypatch):
    """With a hash of few values the words themselves decide."""
    import numpy as np

    w = [(0, " ".join(f"a{i}" for i in range(70))), (1, " ".join(f"b{i}" for i in range(50))), (2, " ".join(f"a{i}" for i in range(30, 60)))]
    b = docs_of(w).select("doc_id").toArrow()
    assert b.num_rows == 3
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 0, 0]), pa.array([5, 6, 7]), pa.array([0, 0, 0]), pa.array([x for _, x in w])], names=["doc", "null", "hi", "lo", "text"])
    (found,) = substrings._documents(batch, 1 << 20)
    want = found.later_copies()
    found.hash = np.zeros_like(found.hash)
    assert (found.later_copies() == want).all() and want.sum() == 11


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(x).hexdigest()) for i, n, k, x in brute(rows)]
    assert sorted(map(tuple, queries.op10_substring_dedup(spark, sf).collect())) == sorted(want)


def test_minimum_places():
    import numpy as np

    v = np.array([5, 3, 3, 9, 1, 1, 7, 8, 2, 2], np.uint64)
    for k in range(1, 9):
        assert substrings.sliding_min_place(v, k).tolist() == [i + int(np.argmin(v[i : i + k])) for i in range(len(v) - k + 1)]
