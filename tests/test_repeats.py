"""Texts that loop: as the pattern says, in time that grows with their length."""

import random
import re
import time

from tidemark.functions import repeats as r

LOOP = re.compile(r"(?s)(.{4,80}?)(?:[ \t\n\v\f\r]*\1){5}")


def made(rnd):
    letters = rnd.choice(["ab", "abc", "a", "a\u00e9 \U0001f600", "a ", "a, \n", "abcdefghij"])
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    blank = lambda: "".join(rnd.choice(" \n\t") for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])))
    phrase, same = word(rnd.choice([1, 2, 3, 4, 5, 9, 20, 79, 80, 81])), rnd.choice([blank(), None])
    text = list(word(rnd.randrange(30)) + "".join(phrase + (blank() if same is None else same) for _ in range(rnd.choice([5, 6, 7]))) + word(rnd.randrange(12)))
    if rnd.random() < 0.4:
        text[rnd.randrange(len(text))] = rnd.choice("ax ")
    return "".join(text)


def test_repeats_are_those_of_the_pattern(monkeypatch):
    rnd = random.Random(5)
    texts = ["", "    ", " " * 24 + "a", "a" + " \n\t " * 6, "ab" * 11, "x" * 24, "x" * 23, *(made(rnd) for _ in range(1200))]
    want = [bool(LOOP.search(t)) for t in texts]
    assert 200 < sum(want) < 1000
    assert r.repeats(texts).tolist() == want
    monkeypatch.setattr(r, "CHARACTERS", 300)  # few texts at a time, and few cells
    monkeypatch.setattr(r, "CELLS", 500)
    assert r.repeats(texts).tolist() == want


def test_long_texts_without_a_loop_take_little_time(spark):
    from tidemark.operators import validate

    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(170_000)) for _ in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "abcd " * 6, "abc\u2028" * 4, "abc\r\n" * 3, None])], "id long, text string").repartition(1).cache()
    df.count()
    began = time.time()
    got = {x.id: x.loops for x in df.select("id", validate.loops(df.text).alias("loops")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}
    assert time.time() - began < 6  # 4 million characters; the pattern itself takes several times as long
