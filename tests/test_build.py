import math

from pyspark.sql import functions as F
from tidemark.operators import build, closed


def test_clean_dataset(spark):
    items = spark.createDataFrame([(1, 1, "A  b"), (2, 2, "a B"), (3, 3, "leak"), (4, 4, "no answer"), (5, 5, "fresh"), (6, 6, "low"), (7, 7, "A b")], "id long, pos int, text string")
    answers = spark.createDataFrame([(1, True, "high", ""), (2, True, "high", None), (3, True, "high", ""), (5, True, "high", ""), (6, True, "low", ""), (7, False, "high", "")], "id long, agrees boolean, confidence string, concern string")
    protected = spark.createDataFrame([("leak", "second", 1), ("leak", "first", 0)], "key string, set_name string, set_rank int")
    blocked = spark.createDataFrame([(5,)], "id long")
    got = {r.id: r.reason for r in build.clean_dataset(items, answers, protected, blocked).collect()}
    assert got == {1: "keep", 2: "duplicate", 3: "dup_first", 4: "unverified", 5: "blocklist", 6: "low_confidence", 7: "solver_disagrees"}
    counts = {r.reason: r.n for r in build.funnel(build.clean_dataset(items, answers, protected, blocked)).collect()}
    assert sum(counts.values()) == 7


def test_processed(spark):
    items = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("subject"), (F.col("id") % 40).cast("string").alias("grp"))
    out = build.processed(items, spark.range(1000), fraction=0.1, ratio=0.25, seed="42", variants=[("a", 0.7), ("b", 0.3)])
    rows = out.collect()
    core = [r for r in rows if r.kind == "core"]
    assert {r.id for r in core} == set(range(400)) and len(core) == 400
    train = sum(r.split == "train" for r in core)
    assert sum(r.kind == "general" for r in rows) == round(train / 3)
    split_of = {}
    for r in core:
        split_of.setdefault((r.id % 3, r.id % 40), set()).add(r.split)
    assert all(len(s) == 1 for s in split_of.values()) and 0 < 400 - train < 100


def test_log(spark, tmp_path):
    row = lambda *r: spark.createDataFrame([r], "event string, run string, at string, pos int, delta double")
    for r in (("run", "x", "2024-01-01", 0, 1.0), ("run", "x", "2024-01-02", 1, 2.0), ("manual_promote", "x", "2024-01-03", 2, 9.0)):
        build.append_run(spark, str(tmp_path / "log"), row(*r))
    assert [r.delta for r in build.current_runs(spark.read.parquet(str(tmp_path / "log"))).collect()] == [2.0]
    a, b = (spark.createDataFrame(x, "path string, sha string") for x in ([("p", "1"), ("q", "2")], [("p", "1"), ("q", "3"), ("r", "4")]))
    assert {(r.path, r.state) for r in build.staleness(a, b).collect()} == {("q", "changed"), ("r", "not_deduplicated")}
    log = spark.createDataFrame([(1, "train", 4.0), (2, "train", 2.0), (2, "eval", 1.0), (3, "train", 1.0), (4, "eval", 0.5), (5, "train", 9.0)], "step int, kind string, loss double")
    assert {(r.step, r.eval_loss, r.train_loss) for r in build.step_means(log).collect()} == {(2, 1.0, 3.0), (4, 0.5, 1.0)}
    s = spark.createDataFrame([(1, "B", -1.0), (1, "A", -1.0), (2, "B", -0.5), (2, "A", -0.7)], "id int, letter string, logprob double")
    assert {(r.id, r.letter) for r in build.predicted_letters(s).collect()} == {(1, "A"), (2, "B")}


def test_closed(spark):
    assert [closed.one_letter(t, "ABCD") for t in ("b.", "Odpowiedź: C", "A) x\nreszta", "A) x\nB) y", "Odpowiedź A, a potem odpowiedź B", None)] == ["B", "C", "A", None, None, None]
    assert closed.verdicts("1. P\n2. fałsz\n3) prawda", 3) == "P,F,P" and closed.verdicts("P F P", 3) == "P,F,P" and closed.verdicts("P F", 3) is None
    assert closed.pairs("1 - B, 2: A", ["1", "2"], "AB") == "1-B,2-A" and closed.pairs("1-B 1-A 2-A", ["1", "2"], "AB") is None and closed.pairs("", [], "AB") == ""
    df = spark.createDataFrame([("a)", 2, ["1"])], "t string, n int, r array<string>")
    got = df.select(closed.extract_choice("t", F.lit("ABCD")).alias("c"), closed.extract_verdicts("t", "n").alias("v"), closed.extract_pairs("t", "r", F.lit("AB")).alias("p")).first()
    assert (got.c, got.v, got.p) == ("A", None, None)


def test_history_dataset(spark):
    w = lambda k: " ".join(f"słowo{k}x{i}" for i in range(12))
    rows = [
        (1, "MHIP-R0_1P-100-2305.pdf", "2023", 1, w(1), "Źródło 1. tekst", "k"), (2, "MHIP-R0_1P-100-2305.pdf", "2023", 2, "Na podstawie źródła 1 " + w(2), "", "k"), (3, "MHIP-R0_1P-100-2305.pdf", "2023", 3, " ", "", "k"),
        (4, "MHIP-R0_1P-100-2305.pdf", "2023", 4, w(4), "", ""), (5, "copy.pdf", "2023", 1, w(1), "Źródło 1. tekst", "k"), (6, "copy.pdf", "2023", 2, "Na podstawie źródła 1 " + w(2), "", "k"), (7, "copy.pdf", "2023", 3, w(4), "", "k"),
        (8, "later.pdf", "2025", 1, w(9), "", "k"), (9, "other.pdf", "2020", 1, w(9), "", "k"), (10, "other.pdf", "2020", 2, "Na podstawie źródła 3 " + w(5), "", "k"), (11, "broken.pdf", "2019", 1, "ascii only " * 200, "", "k"),
    ]
    df = spark.createDataFrame(rows, "id int, paper string, year string, pos int, question string, source string, answer_key string")
    got = {r.id: (r.split, r.reason) for r in build.history_dataset(df).collect()}
    assert got == {
        1: ("train", "keep"), 2: ("train", "keep"), 3: ("train", "empty_question"), 4: ("train", "no_key"), 5: ("train", "copied_paper"), 6: ("train", "copied_paper"), 7: ("train", "copied_paper"),
        8: ("dev", "keep"), 9: ("train", "duplicate_of_dev"), 10: ("train", "missing_source"), 11: ("train", "broken_encoding"),
    }
