import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.llm import language as g
from tidemark.llm import queries


def brute(rows, langs):
    """The posterior by the formulas of the module, with dictionaries. rows: (declared, host, said or None)."""
    n = len(langs)

    def norm(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def parts(host):
        if host is None:
            return None, None
        labels = host.split(".")
        return (labels[-1], ".".join(labels[-2:])) if len(labels) > 1 else (None, host)

    sums = {k: {} for k in ("host", "domain", "suffix", "declared")}
    overall = [0.0] * n
    for declared, host, said in rows:
        if said is None:
            continue
        p = norm(said)
        suffix, domain = parts(host)
        for kind, key in (("host", host), ("domain", domain), ("suffix", suffix), ("declared", declared)):
            s = sums[kind].setdefault(key, [0.0] * n)
            for i in range(n):
                s[i] += p[i]
        overall = [a + b for a, b in zip(overall, p, strict=True)]
    smooth = lambda c, p: [(c[i] + 5 * p[i]) / (sum(c) + 5) for i in range(n)]
    out = []
    for declared, host, said in rows:
        if said is None:
            out.append((None, 0.0))
            continue
        suffix, domain = parts(host)
        own = norm(said)  # the row itself is left out of all sums
        rest = lambda kind, key, own=own: [max(0.0, v - o) for v, o in zip(sums[kind][key], own, strict=True)]
        others = [max(0.0, v - o) for v, o in zip(overall, own, strict=True)]
        prior = [(v + 1) / (sum(others) + n) for v in others]
        for kind, key in (("suffix", suffix), ("domain", domain), ("host", host)):
            prior = smooth(rest(kind, key), prior)
        says = [(v + 1) / (o + 1) for v, o in zip(rest("declared", declared), others, strict=True)]
        post = norm([said[i] + math.log(prior[i]) + math.log(says[i]) for i in range(n)])
        best = max(post)
        out.append((langs[post.index(best)] if best >= 0.5 else None, best))
    return out


def test_fusion_against_brute_force(spark):
    r = random.Random(4)
    langs = ["de", "en", "fr"]
    hosts = [None, "a.b.com", "c.b.com", "x.org", "solo", "fr.site.fr"]
    rows = []
    for _ in range(300):
        said = None if r.random() < 0.1 else [0.0 if i == k else -r.random() * 6 for k in [r.randrange(3)] for i in range(3)]
        rows.append((r.choice([None, "de", "en", "fr", "xx"]), r.choice(hosts), said))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "k long, declared string, host string, said array<double>")
    got = sorted(g.fused(df, langs).collect(), key=lambda x: x.k)
    for x, (lang, confidence) in zip(got, brute(rows, langs), strict=True):
        assert x.lang == lang and x.accepted == (lang is not None)
        assert x.confidence == pytest.approx(confidence, abs=1e-9)


def test_text_alone_tells_held_out_documents_apart(spark, sf):
    """Rows whose declaration is taken away are found by the text and the host alone."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = g.document_rows(docs, {"doc_id": F.col("doc_id")})
    held = F.pmod("doc_id", F.lit(4)) == 0
    model = g.fit_text_model(rows.where(~held), ["doc_id"])
    bare = rows.where(held).withColumn("declared", F.lit(None).cast("string"))
    got = g.identify(bare, model).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert sum(r.lang == r.true for r in got) >= 0.98 * len(got)


def test_a_wrong_declaration_gives_way_to_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 300")
    wrong = docs.withColumn("true", F.col("lang")).withColumn("lang", F.when(F.pmod("doc_id", F.lit(9)) == 0, "fr").otherwise(F.col("lang")))
    got = g.documents_identified(wrong).join(wrong.select("doc_id", "true"), "doc_id").collect()
    assert sum(r.lang == r.true for r in got) >= 0.98 * len(got)


def test_odd_rows(docs_of, spark, sf):
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    odd = [(-1, None, "en", "s"), (-2, "", None, None), (-3, "123 !!! ***", "en", "s"), (None, "the and of that with this", None, None), (-4, "the and of " * 100_000, "EN-us", "a.b"), (-5, "the", "", ""), (-5, "the", "", "")]
    got = g.documents_identified(docs_of(real + odd)).collect()
    assert len(got) == len(real) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[k].accepted for k in (-1, -2, -3)] == [False] * 3 and by[-1].lang is None and by[-1].confidence == 0
    assert by[-4].lang == "en" and by[-4].accepted and by[None].lang == "en"
    assert g.documents_identified(docs_of([])).count() == 0
    kept = g.accepted_documents(docs_of(real + odd))
    assert kept.columns == docs_of(odd).columns
    rows = kept.collect()
    assert len(rows) == sum(r.accepted for r in got)
    assert {r.doc_id for r in rows} & {-1, -2, -3} == set() and sum(r.doc_id == -5 for r in rows) == 2


def test_pages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.language_id_pages(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        url = pages[r.page_id].url
        assert r.host == url.split("/")[2].split(":")[0]
        assert r.declared == pages[r.page_id].html.split('lang="')[1][:2]
    assert np.mean([r.lang == r.declared for r in got]) > 0.95


def test_hosts(spark):
    df = spark.createDataFrame([("http://User@Www.A.co.uk:80/x",), ("nothing",), (None,), ("https://h?x",)], "url string")
    assert [r[0] for r in df.select(g.host_of(F.col("url"))).collect()] == ["www.a.co.uk", None, None, "h"]
    s, d = g.host_parts(F.col("url"))
    assert [tuple(r) for r in spark.createDataFrame([("a.b.c",), ("solo",), (None,)], "url string").select(s, d).collect()] == [("c", "b.c"), (None, "solo"), (None, None)]


def test_without_a_model_the_declaration_counts(docs_of):
    rows = [(1, "some words", "en", "s"), (2, "other words", None, "s"), (3, "12 !", "en", "s"), (4, None, "en", "s")]
    got = {r.doc_id: (r.lang, r.accepted) for r in g.documents_identified(docs_of(rows)).collect()}
    assert got == {1: ("en", True), 2: (None, True), 3: (None, False), 4: (None, False)}
    assert sorted(r.doc_id for r in g.accepted_documents(docs_of(rows)).collect()) == [1, 2]


def test_a_rare_language_is_modelled(spark, sf):
    """Ten rows among thousands are counted exactly and all are in the sample."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source")
    word = ["saluton", "kiel", "vi", "fartas", "hodiaŭ", "mi", "estas", "bone", "dankon", "ĉiuj"]
    rare = spark.createDataFrame([(-1 - i, " ".join(word[i * k % 10] for k in range(1, 60)), "eo", "s") for i in range(1, 12)], docs.schema)
    got = {r.doc_id: r.lang for r in g.documents_identified(docs.unionByName(rare)).where("doc_id < 0").collect()}
    assert len(got) == 11 and set(got.values()) == {"eo"}


def test_columns_of_any_type_are_kept(spark, sf):
    """Maps, repeated names of inner columns, and rows that are equal in everything."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("own", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("said", F.lit("x")).withColumn("declared", F.lit("y"))
    got = g.accepted_documents(docs.unionByName(docs))
    assert got.columns == docs.columns and got.schema["own"].dataType == docs.schema["own"].dataType
    plain = g.accepted_documents(docs.drop("own", "said", "declared"))
    assert got.count() >= 2 * plain.count() - 4 and got.where("own['a'] <> doc_id or said <> 'x' or declared <> 'y'").count() == 0
