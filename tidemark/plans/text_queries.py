"""Text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numbers as m
from tidemark.functions import text as x
from tidemark.operators import validate as v
from tidemark.plans.catalogue import query

_WS = "[ \\t\\n\\r\\f\\x0B]"


@query(
    f"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '{_WS}+', ' ', 'g'))) AS text_md5 FROM pages"""
)
def html_strip(t):
    """The visible text of pages, by its hash."""
    return t.pages.select("page_id", F.md5(x.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{N}]', '', 'g')) AS digits, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS distinct_words FROM documents")
def text_profile(t):
    """Counts of letters, digits and words."""
    c = F.col("text")
    return t.documents.select("doc_id", x.count_class(c, r"\p{L}").cast("long").alias("letters"), x.count_class(c, r"\p{N}").cast("long").alias("digits"), F.size(x.words(c)).cast("long").alias("words"), F.size(F.array_distinct(x.words(c))).cast("long").alias("distinct_words"))


@query(
    """WITH d AS (SELECT doc_id, source, list_distinct(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: substr(w, 1, 5))) AS s FROM documents), b AS (SELECT list_distinct(list_transform(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY item_id)), '[\\p{L}\\p{N}]+'), lambda w: substr(w, 1, 5))) AS c FROM benchmark)
    SELECT doc_id, CASE WHEN len(s) > 0 THEN round(len(list_intersect(s, c)) / len(s), 6) ELSE 1.0 END AS overlap FROM d, b"""
)
def key_overlap(t):
    """Share of a document's stems that the benchmark holds."""
    b = t.benchmark.select(F.explode(x.stems(F.col("text"))).alias("s")).agg(F.collect_set("s").alias("c"))  # one row
    return t.documents.select("doc_id", x.stems(F.col("text")).alias("s")).crossJoin(F.broadcast(b)).select("doc_id", F.round(x.coverage(F.col("s"), F.col("c")), 6).alias("overlap"))


@query("SELECT doc_id, substr(sha1(substr(text, 1, 400)), 1, 16) AS print, substr(sha256(text), 1, 16) AS hash, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16 FROM documents")
def fingerprints(t):
    """Hashes of a text and of its beginning, and its length in UTF-16 units."""
    return t.documents.select("doc_id", x.fingerprint(F.col("text"), 400).alias("print"), x.short_hash(F.col("text")).alias("hash"), x.utf16_length(F.col("text")).alias("utf16"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 59)) || '…' ELSE text END AS clip, CASE WHEN length(text) <= 80 THEN text WHEN contains(substr(text, 1, 80), ' ') AND 80 - instr(reverse(substr(text, 1, 80)), ' ') > 48 THEN rtrim(substr(text, 1, 80 - instr(reverse(substr(text, 1, 80)), ' '))) ELSE substr(text, 1, 80) END AS cut FROM documents")
def clipped(t):
    """Texts cut with an ellipsis, and at a word's end (cutting is the operator)."""
    return t.documents.select("doc_id", x.clip(F.col("text"), 60).alias("clip"), x.cut_at_word(F.col("text"), 80).alias("cut"))


@query("SELECT doc_id, lang, CASE WHEN length(replace(text, ' ', '')) >= 4 THEN len(list_distinct(list_transform(range(1, length(replace(text, ' ', '')) - 2), lambda i: substr(replace(text, ' ', ''), i, 4)))) ELSE 0 END AS grams FROM documents")
def gram_counts(t):
    """Distinct character n-grams of every document."""
    return t.documents.select("doc_id", "lang", F.size(x.char_grams(F.col("text"))).cast("long").alias("grams"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE replace(CAST(l_quantity + 0.5 AS VARCHAR), '.', ',') END AS shown, printf('%+.2f', l_tax - l_discount) AS signed, coalesce(round(100.0 * l_discount / nullif(l_tax, 0), 2), 0.0) AS pct, l_quantity + 0.25 AS parsed FROM lineitem")
def number_formats(t):
    """Numbers as text and back."""
    q = F.col("l_quantity")
    shown = m.format_number(F.when(q % 2 == 0, q).otherwise(q + 0.5))
    text = F.concat(F.lit(" "), F.replace((q + 0.25).cast("string"), F.lit("."), F.lit(",")))
    return t.lineitem.select("l_orderkey", "l_linenumber", shown.alias("shown"), m.signed(F.col("l_tax") - F.col("l_discount")).alias("signed"), m.percent(F.col("l_discount"), F.col("l_tax")).alias("pct"), m.to_number(text).alias("parsed"))


@query()
def degenerate_texts(t):
    """Documents that loop (no SQL: back-references)."""
    return t.documents.select("doc_id", v.loops(F.col("text")).alias("loops"), v.table_like(F.col("text")).alias("table_like"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '[*_`]{1,3}', '', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))"


@query(f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '(?s)<think>.*?</think>', '', 'g'), '(?s)^.*</think>', '', 'g'), '(?s)<think>.*$', '', 'g')) AS text FROM conversations")
def markdown_and_thinking(t):
    """Conversation texts without marks."""
    return t.conversations.select("conv_id", "turn", x.strip_thinking(x.strip_markdown(F.col("text"))).alias("text"))


@query()
def chunk_passages(t):
    """Documents packed into passages (no SQL: sequential)."""
    from tidemark.operators.retrieval import chunk_passages as chunk

    return chunk(t.documents.select(F.col("doc_id").cast("string").alias("title"), "text"))
