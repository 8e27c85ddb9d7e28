"""Golden cases and brute force for operators that SQL doesn't cover."""

import json
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemark.functions import numbers, text
from tidemark.operators import aggregates, cleaning, gates, grading, joins, near, rendering, retrieval, split, validate, windows
from tidemark.sources import files
from tidemark.streaming import latest as stream


def one(spark, column, **values):
    """The value of an expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# ------------------------------------------------------------------------------------------------ near duplicates


def brute_greedy(ids, pairs):
    kept, hit = [], {}
    linked = {frozenset(p) for p in pairs}
    for i in ids:
        first = next((k for k in kept if frozenset((k, i)) in linked), None)
        if first is None:
            kept.append(i)
        else:
            hit[i] = first
    return {i: (i not in hit, hit.get(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_keep_first(spark, seed):
    r = random.Random(seed)
    ids = list(range(60))
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(i, i + 1) for i in range(40, 55)] + [(3, 3)]
    got = near.greedy_keep_first(spark.createDataFrame([(i, i) for i in ids], "id long, pos long"), spark.createDataFrame(pairs, "a long, b long"))
    assert {x.id: (x.kept, x.match_id) for x in got.collect()} == brute_greedy(ids, [p for p in pairs if p[0] != p[1]])


def test_token_set_ratio():
    assert near.token_set_ratio("a b c", "c b a") == 100 and near.token_set_ratio("a b", "a b c d") == 100
    assert near.token_set_ratio("", "a") == 0
    assert near._ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    r = random.Random(3)
    for _ in range(100):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(1, 30))) for _ in range(2))
        assert near._ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_fuzzy_best(spark):
    p = [(1, "the quick brown fox jumps over lazy dogs"), (2, "one two three")]
    c = [(10, "quick the brown fox jumps over lazy dogs"), (11, "nothing like it at all here now"), (12, "one two three"), (13, "the quick brown fax jumps over lazy dogs")]
    got = {r.id: (round(r.score), r.match_id) for r in near.fuzzy_best(spark.createDataFrame(c, "id long, text string"), spark.createDataFrame(p, "id long, text string")).collect()}
    assert got[10] == (100, 1) and got[11] == (0, None) and got[12] == (0, None) and got[13][1] == 1
    assert near.fuzzy_best(spark.createDataFrame(c, "id long, text string"), spark.createDataFrame([], "id long, text string")).where("match_id is null").count() == 4


def test_gram_pairs_against_all_pairs(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    rows = [(i, "".join(x if r.random() > 0.03 else "z" for x in r.choice(base))) for i in range(60)] + [(99, "abc"), (98, "")]
    df = spark.createDataFrame(rows, "id long, text string").select("id", text.char_grams(F.col("text")).alias("grams"))
    sets = {i: {t.replace(" ", "")[k : k + 4] for k in range(len(t.replace(" ", "")) - 3)} for i, t in rows}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(x.query_id, x.ref_id): x.jaccard for x in near.gram_pairs(df, df, 0.5).collect()} == want


def test_cosine_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 40)
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    c = spark.createDataFrame([(10, [3.0, 0.1]), (11, [0.0, 0.0])], "id long, vector array<double>")
    got = {r.id: (r.match_id, r.cosine) for r in near.cosine_top1(c, p).collect()}
    assert got[10][0] == 1 and got[10][1] == pytest.approx(3 / math.hypot(3, 0.1)) and got[11] == (1, 0.0)
    assert {r.cosine for r in near.cosine_top1(c, p.limit(0)).collect()} == {-1.0}


def test_clusters_and_canonical(spark):
    prints = spark.createDataFrame([(g, y, p) for g, y, ps in [("a", 1, "xyz"), ("b", 1, "xyz"), ("c", 1, "xy"), ("d", 2, "xyz"), ("e", 1, "q")] for p in ps], "grp string, year int, print string")
    links = near.overlap_pairs(prints, 0.95)
    assert {(r.a, r.b) for r in links.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r.node: r.root for r in near.components(links).collect()} == {"a": "a", "b": "a", "c": "a"}
    best = near.canonical_members(spark.createDataFrame([(1, "x", 3), (1, "y", 5), (2, "z", 1)], "c int, m string, n int"), "c", [F.desc("n")])
    assert {r.m for r in best.collect()} == {"y", "z"}


def test_two_part_matches(spark):
    rows = [(0.5, 0.4, 10), (0.5, 0.3, 10), (0.7, 0.0, 0), (0.5, 0.0, 0), (0.1, 0.6, 200), (0.1, 0.6, 100)]
    df = spark.createDataFrame(rows, "q_jaccard double, s_jaccard double, s_grams int")
    assert [r.match for r in near.two_part_matches(df, 0.5, 0.4, 0.6, 0.5).collect()] == [True, False, True, False, True, False]


# ------------------------------------------------------------------------------------------------------ windows


def test_next_free_ids(spark):
    r = random.Random(7)
    rows = [(r.choice("ab"), i, r.choice([None, *range(1, 15)])) for i in range(60)]
    taken = [("a", 2), ("a", 3), ("b", 1)]
    got = {x.pos: x.number for x in windows.next_free_ids(spark.createDataFrame(rows, "g string, pos int, want int"), "g", ["pos"], F.col("want"), spark.createDataFrame(taken, "g string, number int")).collect()}
    for g in "ab":
        held, own, rest = {n for k, n in taken if k == g}, {}, []
        for k, pos, want in rows:
            if k == g:
                if want is not None and want not in held:
                    held.add(want)
                    own[pos] = want
                else:
                    rest.append(pos)
        n = 0
        for pos in rest:
            n += 1
            while n in held:
                n += 1
            own[pos] = n
        assert {p: got[p] for p in own} == own


def test_order_operators(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (1, 3, None), (1, 4, None), (2, 5, None)], "k int, pos int, v string")
    assert [r.c for r in windows.carry_forward(df, ["k"], ["pos"], "v", "c").orderBy("pos").collect()] == [None, None, "x", "x", None]
    assert windows.todo(df.select("k", "v"), df.where("pos = 1").select("k", "v"), ["k", "v"]).count() == 2


# ---------------------------------------------------------------------------------------------------- statistics


def test_sign_test(spark):
    rows = [(0, 0), (5, 0), (3, 7), (10, 10), (40, 60), (1, 0)]
    df = spark.createDataFrame(rows, "w int, l int").select("w", "l", aggregates.sign_test(F.col("w"), F.col("l")).alias("a"), aggregates.sign_test_exact(F.col("w"), F.col("l")).alias("b"))
    for r in df.collect():
        n, k = r.w + r.l, min(r.w, r.l)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert r.a == pytest.approx(want) and r.b == pytest.approx(want)


def test_bootstrap(spark):
    rows = [("a", float(i % 3), float((i * 7) % 4)) for i in range(200)] + [("b", 1.0, 1.0)] * 10
    got = {r.k: r for r in aggregates.bootstrap_ci(spark.createDataFrame(rows, "k string, base double, run double"), ["k"], draws=4000).collect()}
    d = np.array([r - b for k, b, r in rows if k == "a"])
    assert got["a"].delta == pytest.approx(d.sum()) and got["a"].n == 200 and (got["b"].low, got["b"].high) == (0, 0)
    draws = np.random.default_rng(1).choice(d, (4000, 200)).sum(axis=1)
    spread = draws.std()
    for have, want in zip((got["a"].low, got["a"].high), np.quantile(draws, [0.025, 0.975]), strict=True):
        assert abs(have - want) < 0.25 * spread


def test_gates(spark):
    m = spark.createDataFrame([("r", "delta", None, 2.0), ("r", "parse_fail_delta", None, 0.0), ("r", "general_nll_ratio", None, 1.05), ("r", "net_wins", None, 0.0), ("r", "lenient_delta", None, 0.0), ("s", "delta", None, 1.9)], "run string, measure string, subject string, value double")
    got = {r.run: (r.passed, r.failed) for r in gates.verdicts(gates.evaluate(m)).collect()}
    assert got["r"] == (True, "") and got["s"] == (False, "1,2,3,6,8")


def test_largest_remainder_and_fraction(spark):
    w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int")
    assert {r.k: r.quota for r in split.largest_remainder(w, "k", "w", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    ids = spark.range(1000).withColumnRenamed("id", "i")
    import hashlib

    want = sorted(range(1000), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())[:125]
    assert {r.i for r in split.select_fraction(ids, "i", 0.125, "s").collect()} == set(want)


# ------------------------------------------------------------------------------------------------------- grading

ITEMS = {"mc": ("ABC", 0, None), "multi": ("ABCD", 0, None), "tf": ("", 3, None), "match": ("ABC", 2, None), "short": ("", 0, None), "numeric": ("", 0, "km")}


def item_of(kind):
    letters, n, unit = ITEMS[kind]
    return grading.item_struct(type=F.lit(kind), letters=F.array(*map(F.lit, letters)).cast("array<string>"), n=F.lit(n), unit=F.lit(unit).cast("string"))


@pytest.mark.parametrize(
    "kind,output,value,reason",
    [
        ("mc", "Odpowiedź: B", "B", ""), ("mc", "x\n  Odpowiedź:  C  \ny", "C", ""), ("mc", "Odpowiedź: D", None, "bad_mc_payload"), ("mc", "B", None, "no_answer_line"), ("mc", " \n", None, "empty_output"),
        ("mc", "Odpowiedź: A\nOdpowiedź: A", "A", ""), ("mc", "Odpowiedź: A\nOdpowiedź: B", None, "conflicting_answer_lines"), ("mc", "Odpowiedź:", None, "empty_payload"),
        ("multi", "Odpowiedź: C, A", "A,C", ""), ("multi", "Odpowiedź: A, A", None, "bad_multi_letters"), ("multi", "Odpowiedź: A B", None, "bad_multi_payload"), ("multi", "Odpowiedź: E", None, "bad_multi_letters"),
        ("tf", "Odpowiedź: P, F,P", "P,F,P", ""), ("tf", "Odpowiedź: P, F", None, "tf_wrong_count"), ("tf", "Odpowiedź: tak", None, "bad_tf_payload"),
        ("match", "Odpowiedź: 2-A, 1-C", "1-C,2-A", ""), ("match", "Odpowiedź: 1-A, 3-C", None, "match_wrong_keys"), ("match", "Odpowiedź: 1A", None, "bad_match_payload"),
        ("short", "Odpowiedź: Mieszko I", "Mieszko I", ""), ("short", "Odpowiedź: " + "x" * 201, None, "short_too_long"),
        ("numeric", "Odpowiedź: 1 234,5 km", "1234.5", ""), ("numeric", "Odpowiedź: około 3", None, "bad_numeric_payload"), ("numeric", "Odpowiedź: −2", "-2.0", ""),
    ],
)
def test_parse_strict(spark, kind, output, value, reason):
    item = item_of(kind)
    got = one(spark, grading.parse_strict(item, F.col("t")), t=output)
    assert (got.ok, got.value, got.reason) == (value is not None, value, reason)


def test_variants(spark):
    item = item_of("mc")
    assert one(spark, grading.parse_strict(item, F.lit(" B "), "payload_only")).value == "B"
    assert one(spark, grading.parse_strict(item, F.lit("why\nOdpowiedź: B\n"), "reason_then_answer")).value == "B"
    assert one(spark, grading.parse_strict(item, F.lit("Odpowiedź: B\nbecause"), "reason_then_answer")).reason == "answer_not_last_line"


@pytest.mark.parametrize(
    "kind,output,value",
    [
        ("mc", "**Odpowiedź:** c) bo tak", "C"), ("mc", "Waham się.\nPrawidłowa odpowiedź to D. Odpowiedź: A", "A"), ("mc", "czwarta", "D"), ("mc", "wiele słów " * 20, None),
        ("mc", "Odpowiedź:\n(B)", "B"), ("mc", "x\n" * 50 + "D) bo\n", "D"), ("mc", "Odpowiedź: nie wiem. " * 9, None),
        ("multi", "DB", "B,D"), ("multi", "B oraz C", "B,C"), ("multi", "żadna", None), ("tf", "fałsz, fałsz, prawda", "F,F,P"), ("tf", "PPF", "P,P,F"), ("tf", "P", None),
        ("match", "2-D 1: A", "1-A,2-D"), ("match", "2-D", None), ("match", "1 → B, 2 → B", "1-B,2-B"),
        ("numeric", "razem 3 400,25 kg", "3400.25"), ("numeric", "nic", None), ("numeric", "było 7, " + "a" * 90 + " jest −8", "-8.0"), ("short", "Gniezno\nzapewne", "Gniezno"), ("short", "", None),
    ],
)
def test_parse_lenient(kind, output, value):
    options = {"A": "pierwsza", "B": "druga", "C": "trzecia", "D": "czwarta"}
    assert grading.Free(list("ABCD"), {"tf": 3, "match": 2}.get(kind, 0), options).read(kind, output) == value


def test_points(spark):
    table = F.array(*[F.struct(F.lit(a).alias("min_correct"), F.lit(b).alias("points")) for a, b in ((2, 1), (3, 2))])
    none = F.lit(None).cast("double")

    def p(kind, value, key, full=4, tolerance=none):
        return one(spark, grading.points(item_of(kind), F.lit(value).cast("string"), F.lit(key), F.lit(full), table, tolerance))

    assert [p("mc", "A", "A"), p("mc", "B", "A"), p("mc", None, "A")] == [4, 0, 0]
    assert [p("tf", "P,F,P", "P,F,P"), p("tf", "P,F,F", "P,F,P"), p("tf", "F,P,P", "P,F,P")] == [4, 1, 0]
    assert [p("multi", "A,B,C", "A,B"), p("multi", "A,B", "A,B,C")] == [0, 1]
    assert [p("numeric", "3.1", "3.0", tolerance=F.lit(0.1)), p("numeric", "3.2", "3.0", tolerance=F.lit(0.1))] == [4, 0]
    assert grading.short_matches("„Mieszko I”.", ["mieszko i"]) and not grading.short_matches("książę Mieszko I", ["Mieszko I"])
    assert grading.short_matches("książę Mieszko I", ["Mieszko I"], True)


def test_numbers(spark):
    assert one(spark, numbers.to_number(F.lit("−1 234,50"))) == -1234.5 and one(spark, numbers.to_number(F.lit("x"))) is None
    assert one(spark, numbers.format_number(F.lit(3.0))) == "3" and one(spark, numbers.format_number(F.lit(2.5))) == "2,5"
    assert one(spark, numbers.numeric_close(F.lit(float("nan")), F.lit(1.0))) is False and one(spark, numbers.numeric_close(F.lit(1.0 + 5e-7), F.lit(1.0))) is True
    assert one(spark, numbers.longest_run(F.array(*map(F.lit, (1, 3, 2, 3, 5, 4))))) == 4
    assert one(spark, numbers.rotate(F.array().cast("array<int>"), 2)) == []


# ------------------------------------------------------------------------------------------- text, validation, files


def test_text(spark):
    assert one(spark, text.canonical_key(F.lit("  Straße ﬁ\n X"))) == "strasse fi x"
    assert one(spark, text.ascii_key(F.lit("Żółć-1"))) == "zo c 1"
    assert one(spark, text.strip_thinking(F.lit("a<think>b</think>c"))) == "ac" and one(spark, text.strip_thinking(F.lit("b</think>c<think>d"))) == "c"
    assert one(spark, text.strip_markdown(F.lit("# T\n- **a**\n\n\n\nb  "))) == "T\na\n\nb"
    assert one(spark, text.visible_text(F.lit("<p>a &amp;lt; b</p><!-- x --><script>y</script>"))) == "a &lt; b"
    assert one(spark, text.utf16_length(F.lit("a😀"))) == 3 and one(spark, text.char_grams(F.lit("abc"))) == []
    assert one(spark, text.cut_at_line(F.lit("abcdefgh\nij"), 10)) == "abcdefgh" and one(spark, text.cut_at_line(F.lit("a\nbcdefghijk"), 10)) == "a\nbcdefghi"
    assert one(spark, validate.loops(F.lit("abcd " * 7))) is True and one(spark, validate.loops(F.lit("xyz\n" * 4))) is True and one(spark, validate.loops(F.lit("one two"))) is False
    phrase = "a phrase of seventy characters that goes on and on without a real end "
    assert one(spark, validate.loops(F.lit(phrase * 6))) is True and one(spark, validate.loops(F.lit("word\n  word word word\tword   word"))) is True
    assert one(spark, validate.loops(F.lit("ab cd " * 50_000))) is True and one(spark, validate.loops(F.lit(phrase * 5))) is False


def test_cleaning(spark):
    assert cleaning.without_sections("a\n== Drop ==\nb\n=== Sub ===\nc\n== Keep ==\nd", frozenset({"drop"})) == "a\n\n## Keep\n\nd"
    assert one(spark, cleaning.clean_article(F.col("t"), ["Drop"], False), t="x\n== Drop ==\ny") == "x"
    assert cleaning.collapsed("eggs eggs eggs eggs eggs eggs end") == "eggs end"
    assert cleaning.collapsed("one line\none line\nother\none line\n\n\nx") == "one line\nother\none line\n\n\nx"
    assert one(spark, cleaning.clean_description(F.lit("<think>a</think># T\n```md\n**b** \n```\n\n\n\nc<think>d"))) == "T\n\nb\n\nc"
    assert one(spark, cleaning.join_enumerators(F.lit("a)\nfirst\n2.\nsecond"))) == "a) first\n2. second"
    assert one(spark, cleaning.drop_lines(F.lit("a\n.....\nb"), r"[.]+")) == "a\nb"
    assert one(spark, cleaning.window_around(F.lit("aaa bbb ccc MARK ddd eee fff"), F.lit("MARK"), 6)) == "ccc MARK ddd"
    got = one(spark, cleaning.split_blocks(F.lit("x\n## 1.2 (3)\ntext\n## 2 (1)\nmore"), r"## ([0-9.]+) \(([0-9]+)\)"))
    assert [(r.id, r.points, r.block) for r in got] == [("1.2", 3, "## 1.2 (3)\ntext"), ("2", 1, "## 2 (1)\nmore")]


def test_item_error(spark):
    base = dict(id="1", subject="s", type="mc", question="q", options={"A": "x", "B": "y"}, answer="A")
    rows = [
        (base, None), ({**base, "answer": "C"}, "answer_not_an_option"), ({**base, "options": {"A": "x"}}, "few_options"), ({**base, "type": "essay"}, "bad_type"), ({**base, "id": " "}, "no_id"), ({**base, "points": 0}, "bad_points"),
        ({**base, "type": "multi", "answer": '["A","A"]'}, "answer_repeats"), ({**base, "type": "multi", "answer": '["A","B"]'}, None), ({**base, "type": "tf", "answer": '["true"]', "statements": ["a", "b"]}, "answer_of_other_length"),
        ({**base, "type": "tf", "answer": '["true","false"]', "statements": ["a", "b"]}, None), ({**base, "type": "match", "left": ["l"], "right": {"A": "r"}, "answer": '{"1":"B"}'}, "answer_not_on_the_right"), ({**base, "type": "numeric", "answer": "x"}, "answer_not_a_number"),
        ({**base, "type": "numeric", "answer": "1.5"}, None), ({**base, "answer": None}, "no_answer"),
    ]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in files.ITEM.fields) for r, _ in rows], files.ITEM)
    assert [x.e for x in df.select(validate.item_error().alias("e")).collect()] == [e for _, e in rows]
    assert [x.n for x in df.select(validate.n_parts().alias("n")).collect()][7:10] == [2, 2, 2]


def test_files(spark, tmp_path):
    good = {"id": "1", "subject": "s", "type": "mc", "question": "q", "options": {"A": "x", "B": "y"}, "answer": "A"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "id": "2"}) + "\nnot json\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({**good, "question": "later"}) + "\n" + json.dumps({**good, "id": "3", "answer": "Z"}) + "\n")
    items, counts = files.load_raw(spark, str(tmp_path / "*.jsonl"))
    assert {(r.id, r.file, r.line) for r in items.collect()} == {("1", "a.jsonl", 1), ("2", "a.jsonl", 3)}
    assert {(r.file, r.n, r.bad, r.repeated) for r in counts.collect()} == {("a.jsonl", 3, 1, 0), ("b.jsonl", 2, 1, 1)}
    with pytest.raises(ValueError, match="no JSON object"):
        files.load_items(spark, str(tmp_path / "a.jsonl"))
    with pytest.raises(ValueError, match="invalid"):
        files.load_items(spark, str(tmp_path / "b.jsonl"))
    schema = T.StructType.fromDDL("title string, text string")
    (tmp_path / "c.txt").write_text('{"title":"t","text":"old"}\n{"title":"t","text":"new"}\n{"title":"u","te')
    assert [(r.title, r.text) for r in files.read_cache(spark, str(tmp_path / "c.txt"), schema, "title").collect()] == [("t", "new")]
    lines = spark.createDataFrame([("a", 1, '{"key":"k","answer":"x"}'), ("a", 2, '{"key":"k","answer":"SKIP"}'), ("b", 1, '{"key":"k","answer":"y"}'), ("b", 2, "{")], "file string, line int, value string")
    filled, counts = files.load_filled(lines)
    assert [tuple(r) for r in filled.collect()] == [("k", "y")] and tuple(counts.first()) == (1, 1, 1)
    assert files.write_jsonl(filled, str(tmp_path / "out"), ["key"]) == 1
    assert files.write_one_file([{"ą": 1}], str(tmp_path / "r" / "one.jsonl")) == 1


def test_loose_json(spark):
    assert files.parse_loose_json('```json\n[{"a":1,},{"b":2}]\n```') == [{"a": 1}, {"b": 2}]
    assert files.parse_loose_json('Here:\n{"a":1},\n{"b":[1,2,],}\nend') == [{"a": 1}, {"b": [1, 2]}]
    assert files.parse_loose_json(None) == [] == files.parse_loose_json("nothing")
    got = files.loose_objects(spark.createDataFrame([(1, '{"a":1}\n{"b":2}'), (2, None)], "id int, t string"), ["id"], "t").collect()
    assert [(r.id, r.n, r.object) for r in got] == [(1, 1, '{"a": 1}'), (1, 2, '{"b": 2}')]


def test_exam_images_titles(spark, tmp_path):
    (tmp_path / "exam.json").write_text(json.dumps({"exam_id": "e", "items": [{"id": "1", "question": "q", "images": [{"path": "a/b.png", "sha256": "x"}]}, {"id": "2", "max_points": 3}]}))
    got = files.read_exam(spark, str(tmp_path / "exam.json")).orderBy("pos").collect()
    assert [(r.id, r.max_points, r.question, len(r.images)) for r in got] == [("1", 0, "q", 1), ("2", 3, "", 0)]
    png = b"\x89PNG\r\n\x1a\n1234"
    assert one(spark, files.image_kind(F.lit(png))) == "image/png" and one(spark, files.data_uri(F.lit(b"\xff\xd8\xff"))).startswith("data:image/jpeg;base64,")
    tree = spark.createDataFrame([("e1", 0, ["A", "B"]), ("e2", 1, ["B", "C"])], "epoch string, epoch_pos int, titles array<string>")
    assert {(r.epoch, r.title) for r in files.titles_of(tree).collect()} == {("e1", "A"), ("e1", "B"), ("e2", "C")}
    known = spark.createDataFrame([("x/a.png", "1"), ("y/a.png", "2"), ("y/b.png", "3")], "path string, description string")
    got = joins.by_path_or_name(spark.createDataFrame([("x/a.png",), ("z/a.png",), ("z/b.png",)], "path string"), known).collect()
    assert {r.path: r.description for r in got} == {"x/a.png": "1", "z/a.png": None, "z/b.png": "3"}


def test_containing_without_an_anchor(spark):
    texts = spark.createDataFrame([(1, "xx one two three four five yy"), (2, "short"), (3, "a  double  blank  is  here now")], "id long, text string")
    needles = spark.createDataFrame([(1, "ne two three four fi"), (2, "hor"), (3, "double  blank  is  here"), (4, ""), (5, "absent words in this place here")], "item_id long, needle string")
    assert {(r.id, r.item_id) for r in joins.containing(texts, needles).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_retrieval(spark):
    p = spark.createDataFrame([(1, "Cats", "", "cats purr"), (2, "Dogs", "", "dogs bark"), (3, "Dogs", "", "dogs bark"), (4, "Dogs", "", "dogs run"), (5, "Dogs", "", "dogs sleep")], "pid long, title string, section string, text string")
    hits = retrieval.Index(p).search(spark.createDataFrame([(1, "dogs bark")], "qid long, query string"), p, k=3, max_per_title=2).orderBy("rank").collect()
    assert [(r.rank, r.pid) for r in hits] == [(1, 2), (2, 4)]
    long = "## One\n" + " ".join(f"w{i}." for i in range(500)) + "\n## Two\n" + "tail words here."
    chunks = retrieval.chunk_text(long)
    assert " ".join(c for _, c in chunks) == " ".join(f"w{i}." for i in range(500)) + " tail words here."
    assert all(len(c.split()) <= 325 for _, c in chunks) and retrieval.chunk_text("") == []
    rows = spark.createDataFrame([([("T", "x " * 300), ("U", "y " * 300)], 900)], "p array<struct<title:string,text:string>>, m int")
    out = rows.select(retrieval.format_passages("p", "m").alias("o")).first().o
    assert out.startswith("[1] T\n") and "[2] U" in out and len(out) <= 900
    assert one(spark, retrieval.build_query(F.lit("a [x] b"), F.lit("c"))) == "a b c"
    stems = one(spark, retrieval.tokens(F.lit("Running 12345678 the cats"), ["the"], ["ning", "s"]))
    assert stems == ["run", "12345678", "cat"]


def test_rendering(spark):
    assert one(spark, rendering.placeholder(F.lit("match"), F.lit(2))) == "1-<litera>, 2-<litera>"
    assert one(spark, rendering.payload(F.lit("match"), F.lit(""), F.array().cast("array<string>"), F.create_map(F.lit("10"), F.lit("A"), F.lit("2"), F.lit("B")), F.lit(0.0))) == "2-B, 10-A"
    assert one(spark, rendering.target(F.lit("A"), F.lit(" "), "reason_then_answer")) is None
    assert one(spark, rendering.numbered(F.array(F.lit("x"), F.lit("y")))) == "1. x\n2. y"
    got = one(spark, rendering.messages(F.lit(""), F.lit("u"), F.lit("a")))
    assert [(m.role, m.content) for m in got] == [("user", "u"), ("assistant", "a")]


def test_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "log"))
    log = stream.read_log(spark, str(tmp_path / "log"), events.schema, 1)
    q = stream.latest(log, ["user_id"], "ts", ["event_id"]).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.user_id: r.event_id for r in events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id").collect()}
    assert {r.user_id: r.event_id for r in spark.table("latest").collect()} == want
