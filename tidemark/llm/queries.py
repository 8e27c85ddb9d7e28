"""The registered training-data queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import bpe_round_trip

    return bpe_round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import documents_identified

    return documents_identified(_read(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import pages_identified

    return pages_identified(_read(spark, sf_dir, "pages"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.media import media_report

    return media_report(spark, _read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import derivative_report

    return derivative_report(spark, _read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_report

    return quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_store import token_store_report

    return token_store_report(spark, _read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm import lm_report

    return lm_report(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substrings import dedup_substrings

    cut = dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_language_id": op2_language_id, "language_id_pages": language_id_pages, "op3_media": op3_media, "op4_warc": op4_warc, "op5_quality": op5_quality, "op6_token_store": op6_token_store, "op7_decontamination": op7_decontamination, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_lm_scoring": op9_lm_scoring, "op10_substring_dedup": op10_substring_dedup}


_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP10 = f"""WITH l AS (SELECT doc_id, {_WORDS.format('text')} AS x FROM documents), w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS p FROM l),
    k AS (SELECT doc_id, p, string_agg(word, ' ') OVER f AS window_words, count(*) OVER f AS c FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    a AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY window_words ORDER BY doc_id, p) AS r FROM k WHERE c = 20) WHERE r > 1),
    m AS (SELECT w.doc_id, w.p, word, coalesce(max(a.p) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM w LEFT JOIN a ON a.doc_id = w.doc_id AND a.p = w.p),
    g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)"""

_OP8 = f"""WITH RECURSIVE l AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS x FROM documents), w AS (SELECT doc_id, len(x) AS n, unnest(x) AS word, generate_subscripts(x, 1) AS p FROM l),
    k AS (SELECT doc_id, n, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS c, p FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM k WHERE c = 5 OR n < 5 AND p = 1), z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN z za ON za.doc_id = a.doc_id JOIN z zb ON zb.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(za.n) + any_value(zb.n) - count(*))),
    v AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), c AS (SELECT x AS node, x AS root FROM v UNION SELECT v.y, c.root FROM c JOIN v ON v.x = c.node), r AS (SELECT node, min(root) AS root FROM c GROUP BY 1)
    SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN r ON r.node = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the two whose results it can express; the others learn, hash, write files or search."""
    return {"op8_ngram_jaccard": _OP8, "op10_substring_dedup": _OP10}
