import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard, queries
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k=5):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    met: dict = {}
    for ids in where.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                met[i, j] = met.get((i, j), 0) + 1
    for (i, j), n in met.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)


def made(n, seed, sizes=(1, 250)):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    line = [r.choice(words) for _ in range(12)]
    bases = [[r.choice(words) for _ in range(int(r.uniform(*sizes)))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(words)], [w[k], r.choice(words)], [w[k].upper()]])
        if r.random() < 0.3:
            k = r.randrange(len(w) + 1)
            w[k:k] = line
        rows.append((i * 7 % n, r.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("seed,sizes,group,twos", [(1, (1, 250), 16, False), (2, (1, 30), 2, False), (3, (20, 90), 2, True), (4, (100, 400), 2, False)])
def test_against_brute_force(docs_of, monkeypatch, seed, sizes, group, twos):
    if seed == 2:
        monkeypatch.setattr(jaccard, "SKETCH_BYTES", 1)  # sketches are joined, not broadcast
    monkeypatch.setattr(jaccard, "SMALL_GROUP", group)
    monkeypatch.setattr(jaccard, "PIECE_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "LEAST_BUCKETS", 5)
    if twos:

        def all_twos(docs, similar, shingle):
            b = jaccard.Bands(similar)
            b.twos = b.units // 2
            return b

        monkeypatch.setattr(jaccard, "chosen_bands", all_twos)
    rows = made(400, seed, sizes)
    assert run(docs_of(rows)) == brute(rows)


def test_odd_rows(docs_of):
    t = " ".join(f"x{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, t), (8, t), (8, t), (9, t + " more"), (10, "é " * 9), (11, " ".join(f"z{i}" for i in range(50_000))), (12, " ".join(f"z{i}" for i in range(49_000)))]
    assert run(docs_of(rows)) == brute(rows)
    assert run(docs_of([])) == []


def test_every_similar_pair_meets_in_one_round_or_the_other():
    """The pigeonhole: similar sets share an index hash unless neither is served, and then share a hard one."""
    r = np.random.default_rng(3)
    bands = jaccard.Bands()
    for _ in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, len(a) // 5)))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 1 << 63, int(r.integers(0, max(1, len(a) // 8)))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        sizes, elements = np.array([len(a), len(b)]), np.concatenate([a, b])
        rows, band = bands.of(sizes)
        common = set(band[rows == 0].tolist()) & set(band[rows == 1].tolist())
        assert common
        met = False
        for kind in ("plain", "twos", "hard"):
            bands.twos = bands.units // 2 if kind == "twos" else np.zeros_like(bands.units)
            sig, owner, _, less, spare = jaccard.signatures(bands, sizes, elements, rows, band, kind == "hard")
            whole = [set(sig[(rows[owner] == k) & ~less].tolist()) for k in (0, 1)]
            any_ = [set(sig[rows[owner] == k].tolist()) for k in (0, 1)]
            met = bool(whole[0] & any_[1] or whole[1] & any_[0])
            larger = max(common)
            served = any(spare[i] >= 0 for i in range(len(rows)) if band[i] == larger)
            assert met or (kind != "hard" and not served)


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(5)
    bands = jaccard.Bands()
    sets, similar = [], []
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 400))).astype(np.uint64))
        drop, more = (int(r.integers(0, 1 + len(a) // 3)) for _ in range(2))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 1 << 63, more).astype(np.uint64)]))
        if not len(b):
            b = a
        both = len(np.intersect1d(a, b))
        sets += [a, b]
        similar.append(5 * both >= 4 * (len(a) + len(b) - both))
    sizes = np.array([len(x) for x in sets])
    data = jaccard.sketches(bands, sizes, np.concatenate(sets))
    table = jaccard.SketchTable(bands, [(10 * k, int(n), x) for k, (n, x) in enumerate(zip(sizes, data, strict=True))])
    a, b = np.arange(0, len(sets), 2) * 10, np.arange(1, len(sets), 2) * 10
    got, want = table.may_link(a, b), np.array(similar)
    assert got[want].all() and got[~want].mean() < 0.5
    assert not table.may_link(a[:-1], b[1:]).any() or table.may_link(a[:-1], b[1:]).mean() < 0.1
    assert table.may_link(np.array([5]), np.array([10])).all()  # unknown sets aren't ruled out
    twice = jaccard.SketchTable(bands, [(1, 5, data[0]), (1, 9, data[1]), (2, 400, data[2])])
    assert twice.may_link(np.array([1]), np.array([2])).all()


def test_set_ids_and_sets():
    got = list(jaccard.shingle_sets(pa.array(["a b c d e f", "A b C d e  f", "", "a b", "b a", None or "", "a"]), 1 << 20))
    (sizes, elements) = got[0]
    assert sizes.tolist() == [2, 2, 0, 1, 1, 0, 1]
    hi, _ = jaccard.set_ids(sizes, elements)
    assert hi[0] == hi[1] and len(set(hi.tolist())) == 5


@pytest.mark.parametrize("most", [0, 500_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr("tidemark.llm.components.ONE_TASK_LINKS", most)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(100, r.randrange(101, 160)) for _ in range(40)] + [(5, 5), (7, None)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    for i in range(1, 60):
        if i % 20 or i in (20, 40):
            assert got[i] == (1 if i <= 20 else 21 if i <= 40 else 41)
    assert {got[k] for k in got if k >= 100} == {100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8_ngram_jaccard(spark, sf).collect()), key=str) == brute(rows)


def test_free_heap_goes_back_between_steps(spark, docs_of, monkeypatch):
    """Executors must not keep what one step let go of while the next one's Python workers need the room: full collections run between steps."""
    from tidemark.llm import common

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = docs_of([(k, " ".join(f"w{k // 2 * 100 + j}" for j in range(40))) for k in range(20)])
    monkeypatch.setattr(common, "RELEASE_BYTES", 0, raising=False)
    before = collections()
    assert {c for _, _, c in run(docs)} == set(range(0, 20, 2))
    assert collections() >= before + 3
