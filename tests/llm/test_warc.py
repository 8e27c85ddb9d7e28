import hashlib
import re

import pytest

from pyspark.sql import functions as F

from tidemark.llm import queries, warc


def brute_text(page):
    """Another way to the visible text, character by character."""
    import html

    for kind in ("script", "style", "head"):
        page = re.sub(rf"(?is)<{kind}\b.*?</{kind}\s*>", " ", page)
    page = re.sub(r"(?s)<!--.*?-->", " ", page)
    out, i = [], 0
    while i < len(page):
        m = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<![^>]*>").match(page, i) if page[i] == "<" else None
        if m:
            tag = (m[1] or "").lower()
            out.append("" if tag in ("b", "i", "a", "span", "em", "strong", "") else " " if tag in ("td", "th") else "\n")
            i = m.end()
        else:
            out.append(page[i])
            i += 1
    return "\n".join(x for x in (" ".join(y.split()) for y in html.unescape("".join(out)).split("\n")) if x)


def test_plain_text():
    assert warc.plain_text("<html><head><title>t</title></head><body><p>a <b>b</b>c<br>d&amp;e<!-- x --><script>1<2</script></p><td>f</td><td>g</td></body>") == "a bc\nd&e\nf g"
    assert warc.plain_text("") == "" and warc.plain_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert warc.plain_text("a<script>never closed") == "a"


def test_pages_out_of_order():
    """Quoted signs, unclosed elements, tags in tags; and time that grows with the length."""
    import time

    p = warc.Page('<html lang="de-AT"><head><title>A &lt; B</title><a href=x></head><p title="x>y">z</p><A HREF=\'/q?a>b\'>l</A><a name=href>n</a><a href="">e</a>')
    assert (warc.plain_text(p), p.title, p.lang, p.links) == ("z\nlne", "A &lt; B", "de-AT", ["x", "/q?a>b", ""])
    assert warc.plain_text("a<!-- b") == "a" and warc.plain_text("a <b c") == "a" and warc.plain_text("x<head>y") == "x y" and warc.plain_text("<a title='>'>k") == "k"
    assert warc.plain_text("<title>t</title>u <title>v</title>") == "tu v" and warc.plain_text("<p class=a\"b>c") == "c"
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        for part in ("<head>", "<div ", "<title>", "<script", "<!--", "<a href=\"", "<a =\"'", "</", "<td>&"):
            warc.plain_text(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_report(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_warc(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r.page_id]
        assert r.url == p.url and r.refers_to == r.response_id
        assert r.source_payload_digest == warc.digest(p.html.encode())
        text = brute_text(p.html).encode()
        assert r.text_sha256 == hashlib.sha256(text).hexdigest()
        assert r.text_digest == warc.digest(text) and r.text_bytes == len(text)
        assert r.n_links == len(re.findall(r"<a\b[^>]*href", p.html))
    ids = [x for r in got for x in (r.response_id, r.conversion_id, r.metadata_id)]
    assert len(set(ids)) == len(ids)


def test_odd_rows(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (None, None, None), (2, None, ""), (3, "http://b/\r\nWARC-Type: evil", "<p>é " * 100_000), (4, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = sorted(warc.derivative_report(spark, df).collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert [r.page_id for r in got] == [None, 1, 1, 2, 3, 4]
    assert got[1] == got[2] and got[0].url is None and got[0].text_bytes == 0
    assert got[4].url == "http://b/ WARC-Type: evil"
    assert warc.derivative_report(spark, df.limit(0)).count() == 0


def test_files_are_readable_and_damage_is_found(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, f"http://h/{i}", f"<title>T{i}</title><p>text {i}</p><a href='/l'>l</a>") for i in range(20)], "page_id long, url string, html string")
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    index = warc.build_derivatives(warc.write_responses(df, source), source, path)
    seen = 0
    for f in sorted((tmp_path / "out").iterdir()):
        with gzip.open(f) as z:
            data = z.read()
        seen += data.count(b"WARC/1.1\r\nWARC-Type: conversion") + data.count(b"WARC/1.1\r\nWARC-Type: metadata")
        with open(f, "rb") as z:
            for offset, length, raw in warc.members(z, 100):
                headers, _ = warc.parse(raw)
                assert gzip.decompress(f.read_bytes()[offset : offset + length]) == raw and headers["warc-refers-to"]
    assert seen == 40
    r = index.collect()[0]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab")
    assert r.response_id and index.count() == 20
