"""Item-level operators over rows that are made from the driver's tables, so that SQL can say what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import build, cleaning, exam, grading, joins, near, sheets, validate
from tidemark.operators import split as s
from tidemark.plans.catalogue import query


@query(
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'answer_not_an_option' WHEN 2 THEN 'few_options' WHEN 3 THEN 'answer_repeats' WHEN 4 THEN 'answer_of_other_length' WHEN 5 THEN NULL WHEN 6 THEN 'answer_not_a_number' WHEN 7 THEN 'bad_type' ELSE 'no_question' END AS error,
    CASE p_partkey % 9 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END AS parts FROM part"""
)
def item_errors(t):
    """The first rule that each item breaks, and its number of graded parts."""
    k, none = F.col("p_partkey") % 9, F.lit(None).cast("string")
    two, one = F.create_map(F.lit("A"), F.col("p_name"), F.lit("B"), F.col("p_type")), F.create_map(F.lit("A"), F.col("p_name"))
    kind = F.when(k == 3, "multi").when(k.isin(4, 5), "tf").when(k == 6, "numeric").when(k == 7, "essay").otherwise("mc")
    answer = F.when(k == 1, "C").when(k == 3, '["A","A"]').when(k == 4, '["true"]').when(k == 5, '["true","F"]').when(k == 6, "about 3").otherwise("A")
    statements = F.when(k.isin(4, 5), F.array(F.col("p_name"), F.col("p_type")))
    rows = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("id"), F.lit("history").alias("subject"), kind.alias("type"), F.when(k == 8, " ").otherwise(F.col("p_name")).alias("question"), F.lit(1).alias("points"), F.when(k == 2, one).otherwise(two).alias("options"), answer.alias("answer"), statements.alias("statements"), F.lit(None).cast("array<string>").alias("left"), F.lit(None).cast("map<string,string>").alias("right"), F.lit(None).cast("double").alias("tolerance"), none.alias("unit"))
    return rows.select("p_partkey", validate.item_error().alias("error"), validate.n_parts().cast("int").alias("parts"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS strict, p_partkey % 4 < 3 AS lenient FROM part")
def short_answers(t):
    """Short answers against an accepted form: as it is, with other quotes and signs, within a few words, and another one."""
    k, name = F.col("p_partkey") % 4, F.concat(F.lit("Jan "), F.col("p_name"))
    given = F.when(k == 0, name).when(k == 1, F.concat(F.lit("„"), F.upper(name), F.lit("”. "))).when(k == 2, F.concat(F.lit("król "), name)).otherwise("Stefan")
    accepted = F.array(F.lit("nikt inny"), name)
    return t.part.select("p_partkey", grading.short_match(given, accepted, F.lit(False)).alias("strict"), grading.short_match(given, accepted, F.lit(True)).alias("lenient"))


@query(
    """SELECT p_partkey, CAST(p_size AS INTEGER) AS points, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS missing, CASE WHEN p_partkey % 3 = 0 THEN 'Powód:' ELSE '' END AS lacking, 'a),b)' AS labels FROM part"""
)
def task_texts(t):
    """Points in a header, sources that are cited and not there, labels of the question that an answer lacks, labels of lines."""
    n = F.col("p_size").cast("string")
    header = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Zadanie 4. (0–"), n, F.lit(")"))).otherwise(F.concat(F.lit("Zadanie 4 ("), n, F.lit(" pkt)")))
    missing = exam.missing_source(F.concat(F.lit("Na podstawie źródła "), n, F.lit(" oraz źródła A napisz.")), F.concat(F.lit("Źródło A. tekst\nŹródło "), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(n), F.lit(". tekst")))
    labels = sheets.answer_labels(F.concat(F.lit("Rozwiąż "), F.col("p_name"), F.lit("\nNazwa:\nPowód:")))
    answer = F.concat(F.lit("nazwa: x\n"), F.when(F.col("p_partkey") % 3 == 0, "bo").otherwise("Powód – bo"))
    lacking = F.filter(labels, lambda x: ~sheets.label_present(x, answer))
    return t.part.select("p_partkey", exam.points_in(header).alias("points"), F.array_join(missing, ",").alias("missing"), F.array_join(lacking, ",").alias("lacking"), F.array_join(validate.labels_in(F.lit("a) x\n b) y\na) z")), ",").alias("labels"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || '; ' || p_name WHEN 2 THEN p_name || ' (P); ' || p_type || ' (F)' ELSE p_name || ' -> ' || p_brand || '; ' || p_type || ' -> ' || p_brand END AS answer, chr(CAST(65 + p_size % 4 AS INTEGER)) AS letter, 'src-' || p_partkey AS row_id, p_name || ' ' || p_type AS question FROM part"""
)
def answers_as_text(t):
    """Keys as text, letters of indexes, rows of a blocklist."""
    k, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    kind = F.when(k == 0, "mc").when(k == 1, "multi").when(k == 2, "tf").otherwise("match")
    options = F.create_map(F.lit("A"), F.when(k == 3, F.col("p_brand")).otherwise(F.col("p_name")), F.lit("B"), F.col("p_type"))
    listed = F.when(k == 0, F.array(F.lit("A"))).when(k == 1, F.array(F.lit("B"), F.lit("A"))).when(k == 2, F.array(F.lit("P"), F.lit("F")))
    both = F.array("p_name", "p_type")
    text = exam.answer_text(kind, options, listed, both, both, F.create_map(F.lit("2"), F.lit("A"), F.lit("1"), F.lit("A")), none)
    block = exam.block_row("src", F.col("p_partkey"), F.lit("x"), F.concat(F.lit(" "), F.col("p_name"), F.lit(" \n "), F.col("p_type")), options, text)
    return t.part.select("p_partkey", text.alias("answer"), exam.letter_of((F.col("p_size") % 4 + 1).cast("string"), 1, F.lit(4)).alias("letter"), block["id"].alias("row_id"), block["question"].alias("question"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'bbb MARK ccc' ELSE '' END AS around, p_name || chr(10) || chr(10) || '## Keep' || chr(10) || chr(10) || p_type AS article, '1.2=' || p_size || ';2=1' AS blocks FROM part"""
)
def parts_of_texts(t):
    """A window around a mark, an article without a section, and a document cut at its headers."""
    text = F.concat(F.lit("aaaaaa bbb "), F.when(F.col("p_partkey") % 2 == 0, "MARK").otherwise("x"), F.lit(" ccc dddddd"))
    article = F.concat(F.col("p_name"), F.lit("\n== Przypisy ==\nx\n=== Niżej ===\ny\n== Keep ==\n"), F.col("p_type"))
    blocks = cleaning.split_blocks(F.concat(F.lit("x\n## 1.2 ("), F.col("p_size").cast("string"), F.lit(")\ntext\n## 2 (1)\nmore")), r"## ([0-9.]+) \(([0-9]+)\)")
    shown = F.array_join(F.transform(blocks, lambda b: F.concat(b["id"], F.lit("="), b["points"].cast("string"))), ";")
    return t.part.select("p_partkey", cleaning.window_around(text, F.lit("MARK"), 5).alias("around"), cleaning.clean_article(article, ["Przypisy"]).alias("article"), shown.alias("blocks"))


@query("SELECT l_orderkey AS id, chr(CAST(65 + arg_min(l_linenumber, [-CAST(l_quantity AS DOUBLE), l_linenumber]) AS INTEGER)) AS letter FROM lineitem GROUP BY 1")
def predicted_letters(t):
    """The most probable letter of each item."""
    return build.predicted_letters(t.lineitem.select(F.col("l_orderkey").alias("id"), F.char(65 + F.col("l_linenumber")).alias("letter"), F.col("l_quantity").cast("double").alias("logprob")))


@query("SELECT path, state FROM (SELECT c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'not_deduplicated' WHEN c_custkey % 5 = 0 THEN 'changed' END AS state FROM customer) WHERE state IS NOT NULL")
def stale_files(t):
    """Files whose hash isn't what was recorded."""
    now = t.customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("sha"))
    recorded = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("sha"))
    return build.staleness(recorded, now)


@query(
    """SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type END AS description FROM part"""
)
def images_described(t):
    """Descriptions of images by path, else by the only file of the same name."""
    k, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    wanted = t.part.select("p_partkey", F.concat(F.lit("a/"), n, F.lit(".png")).alias("path"))
    known = t.part.where("p_partkey % 3 = 0").select(F.concat(F.lit("a/"), n, F.lit(".png")).alias("path"), F.col("p_name").alias("description"))
    known = known.unionByName(t.part.where("p_partkey % 3 = 1").select(F.concat(F.lit("b/"), n, F.lit(".png")).alias("path"), F.col("p_type").alias("description")))
    known = known.unionByName(t.part.where("p_partkey % 3 = 2").select(F.explode(F.array(F.concat(F.lit("b/"), n, F.lit(".png")), F.concat(F.lit("c/"), n, F.lit(".png")))).alias("path"), F.lit("twice").alias("description")))
    return joins.by_path_or_name(wanted, known).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("path"), "description")


@query("SELECT c_nationkey AS cluster, arg_min(c_custkey, [-c_custkey % 7, c_custkey]) AS member FROM customer GROUP BY 1")
def canonical_of_cluster(t):
    """The best member of each cluster."""
    return near.canonical_members(t.customer.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("member")), "cluster", [F.desc(F.col("member") % 7), "member"]).select("cluster", "member")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('9:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 37")
def sample_of_documents(t):
    """37 documents, by hash (the number is the operator's)."""
    return s.sample_n(t.documents.select("doc_id"), "doc_id", 37, "9")


@query(
    """WITH a AS (SELECT list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS x, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+')) AS y, p_partkey FROM part)
    SELECT p_partkey, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jaccard, CAST(len(y) AS INTEGER) AS content FROM a"""
)
def word_overlap(t):
    """Jaccard similarity of the words of two texts, and the number of content words."""
    from tidemark.functions import text as x

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    both = F.concat_ws(" ", "p_type", "p_name")
    return t.part.select("p_partkey", F.round(x.jaccard(words(F.col("p_name")), words(both)), 6).alias("jaccard"), F.size(F.array_distinct(x.content_words(both))).alias("content"))
