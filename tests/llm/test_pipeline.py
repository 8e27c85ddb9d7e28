import hashlib
import sys
from pathlib import Path

import pytest

from tests.llm import test_decontaminate, test_jaccard, test_substrings

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as c

P = pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, sf):
    """Each stage is judged on its own input: what the one before it kept."""
    from tidemark.llm import decontaminate as d
    from tidemark.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in c.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), name))
    for df in kept[:-1]:
        assert df.columns == columns
    rows = [{r.doc_id: r for r in df.collect()} for df in kept]

    # 2: texts are as they were
    assert set(rows[1]) <= set(rows[0]) and all(rows[1][k].text == rows[0][k].text for k in rows[1])
    assert len(rows[1]) >= 0.95 * len(rows[0])
    # 8: the least id of each component
    want = {d for d, _, least in test_jaccard.brute([(k, r.text) for k, r in rows[1].items()]) if d == least}
    assert set(rows[2]) == want
    # 10: words that earlier windows cover are gone, other texts are untouched
    assert set(rows[3]) == set(rows[2])
    for k, n, gone, text in test_substrings.brute([(k, r.text) for k, r in rows[2].items()]):
        assert rows[3][k].text == (text.decode() if gone else rows[2][k].text)
        assert rows[3][k].n_chars == len(rows[3][k].text)
    # 7: documents with an item within the distance go, all others stay
    items = [d.words_of(r.text).tolist() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, r in rows[3].items():
        words = d.words_of(r.text).tolist()
        near = any(test_decontaminate.levenshtein_within(p, words) <= int(0.2 * len(p)) for p in items if set(p) & set(words))
        assert (k in rows[4]) == (not near)
    # 1: the ids decode to the text
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert set(rows[5]) == set(rows[4])
    for k, r in rows[5].items():
        ids = t.encode(rows[4][k].text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(rows[4][k].text.encode()).hexdigest()


def test_run(spark, sf):
    assert c.run(spark, sf).count() > 100


def test_one_of_each_keeps_wordless_and_drops_repeated_rows(docs_of):
    from tidemark.llm.jaccard import one_of_each

    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (1, None), (2, ""), (3, t), (3, t), (4, t + " x"), (None, t), (None, "alone here"), (5, "other words in this one"), (6, " ")]
    got = sorted(((r.doc_id, r.text) for r in one_of_each(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, None), (1, None), (2, ""), (3, t), (None, "alone here"), (5, "other words in this one"), (6, " ")], key=str)


ODD = [(-1, None), (-2, ""), (-3, " \n"), (None, "the and of that with this which was for"), (-4, "123 !! **"), (-6, "long words and the rest of it " * 20_000), (-7, "same the same of the same"), (-7, "same the same of the same"), (-7, "other the other of the other"), (None, None)]


def odd_documents(spark, sf):
    """Some real documents and odd ones, with more columns than `documents` has, some of them named like inner ones."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", "web", None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(real.schema[c].dataType) for c in real.columns])
    return real.unionByName(odd).withColumns({"doc": F.lit("clash"), "key": F.lit(1), "kept": F.lit("clash"), "n_removed": F.lit(2), "said": F.create_map(F.lit("a"), F.col("doc_id"))})


def test_odd_rows_in_every_stage(spark, sf):
    docs = odd_documents(spark, sf)
    for name, stage in c.STAGES:
        got = stage(spark, docs, sf)
        rows = got.where("doc_id < 0 or doc_id is null").collect()
        if name != "encode":
            assert got.columns == docs.columns and got.schema["said"].dataType == docs.schema["said"].dataType, name
            assert all(r.doc == "clash" and r.kept == "clash" and r.n_removed == 2 for r in rows), name
        ids = sorted((r.doc_id or 0 for r in rows), reverse=True)
        if name == "language_id":
            assert {-1, -2, -3, -4} & set(ids) == set() and {0, -6} <= set(ids) and ids.count(-7) in (0, 2, 3)
        elif name == "near_duplicates":
            assert ids == [0, 0, -1, -2, -3, -4, -6, -7, -7]
        else:
            assert ids == [0, 0, -1, -2, -3, -4, -6, -7, -7, -7], name
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in rows if r.doc_id not in (None, -7)}
            assert texts[-1] is None and texts[-2] == "" and texts[-3] == " \n" and len(texts[-6].split()) < 40
        if name == "encode":
            assert {r.doc_id: r.n_tokens for r in rows}[-1] == 0 and sum(r.n_tokens == 0 for r in rows) == 3


def test_empty_tables_in_every_stage(spark, sf, tmp_path):
    docs = odd_documents(spark, sf).limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = odd_documents(spark, sf)
    assert c.decontaminate(spark, whole, str(tmp_path)).count() == whole.count()


def test_run_over_odd_rows(spark, sf, tmp_path):
    """From documents to ids: an odd row goes in the first stage or reaches the last."""
    docs = odd_documents(spark, sf).drop("said")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in c.run(spark, str(tmp_path)).collect()}
    assert {-1, -2, -3, -4} & set(got) == set() and got[None] > 0 and got[-6] > 0
