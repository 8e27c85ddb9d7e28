"""Operators that depend on an order, splits, quotas and samples, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numbers as m
from tidemark.operators import split as s
from tidemark.operators import windows as w
from tidemark.plans.catalogue import query


@query("SELECT doc_id, source || CASE WHEN k > 1 THEN '-dup' || (k - 1) ELSE '' END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def unique_ids_suffix(t):
    """Ids made unique by a suffix on their repeats."""
    return w.unique_ids(t.documents.select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "unique_id")


@query(
    """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run, ts AS "at", event_id AS pos, CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS delta, user_id = 1 AS is_base FROM events),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY run ORDER BY "at" DESC, pos DESC) = 1)
    SELECT run, "at", delta, row_number() OVER (ORDER BY delta DESC NULLS LAST, is_base DESC, "at", run) AS position FROM f"""
)
def leaderboard_latest(t):
    """The latest row of each run, best first."""
    return w.leaderboard(t.events.select(F.col("user_id").cast("string").alias("run"), F.col("ts").alias("at"), F.col("event_id").alias("pos"), F.when(F.col("event_type") != "signup", F.col("value")).alias("delta"), (F.col("user_id") == 1).alias("is_base")))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM events")
def carry_forward(t):
    """The last value of an earlier row that has one."""
    e = t.events.withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return w.carry_forward(e, ["user_id"], ["event_id"], "v", "carried").select("event_id", "carried")


@query("SELECT doc_id, lang, CAST((k - 1) // 20 + 1 AS INTEGER) AS shard, CAST((k - 1) % 20 + 1 AS INTEGER) AS index FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents)")
def shards(t):
    """Fixed-size shards of each subject."""
    return w.shards(t.documents.select("doc_id", "lang", "n_chars"), "lang", ["n_chars", "doc_id"], 20).select("doc_id", "lang", "shard", "index")


@query("SELECT doc_id, CASE WHEN row_number() OVER x = 1 THEN 'keep' ELSE 'duplicate_of_' || first_value(lang) OVER x END AS verdict FROM documents WINDOW x AS (PARTITION BY md5(text) ORDER BY lang, doc_id)")
def first_seen(t):
    """Whether a text was seen before, and in which split first."""
    return w.first_seen(t.documents.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("key")), "key", ["lang", "doc_id"], "lang").select("doc_id", "verdict")


@query(
    """WITH c AS (SELECT c_nationkey, c_custkey, c_custkey % 40 + 1 AS want, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 40 ORDER BY c_custkey) AS claim FROM customer),
    late AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM c WHERE claim > 1), most AS (SELECT c_nationkey, count(*) + 41 AS m FROM c GROUP BY 1),
    every AS (SELECT c_nationkey, unnest(range(1, m + 1)) AS number FROM most), free AS (SELECT e.*, row_number() OVER (PARTITION BY e.c_nationkey ORDER BY number) AS k FROM every e LEFT JOIN c ON c.claim = 1 AND c.c_nationkey = e.c_nationkey AND c.want = e.number WHERE c.want IS NULL)
    SELECT c_nationkey, c_custkey, CAST(want AS INTEGER) AS number FROM c WHERE claim = 1 UNION ALL SELECT c_nationkey, c_custkey, CAST(number AS INTEGER) FROM late JOIN free USING (c_nationkey, k)"""
)
def next_free_ids(t):
    """Numbers within a prefix: the wanted one for its first claimant, else the next that is free."""
    return w.next_free_ids(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"], (F.col("c_custkey") % 40 + 1).cast("int"))


@query("WITH x AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), e AS (SELECT lang, 137 * c / sum(c) OVER () AS q FROM x), f AS (SELECT lang, floor(q) AS f, round(q - floor(q), 9) AS r FROM e) SELECT lang, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= 137 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def strat_quota(t):
    """137 items shared out over languages by the largest remainder."""
    return s.largest_remainder(t.documents.groupBy("lang").agg(F.count("*").alias("c")), "lang", "c", 137)


@query(
    """WITH g AS (SELECT lang AS subject, source AS grp, count(*) AS n FROM documents GROUP BY ALL),
    o AS (SELECT *, sha256('42:' || grp) AS h FROM g), x AS (SELECT *, least(round_even(0.1 * sum(n) OVER (PARTITION BY subject), 0), sum(n) OVER (PARTITION BY subject) - 1) AS q,
    coalesce(sum(n) OVER (PARTITION BY subject ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY subject ORDER BY h, grp) AS k, count(*) OVER (PARTITION BY subject) AS c FROM o)
    SELECT subject, grp, n, CASE WHEN b < q AND k < c THEN 'val' ELSE 'train' END AS split FROM x"""
)
def group_split(t):
    """Whole sources into train or validation, by language."""
    return s.group_split(t.documents.select(F.col("lang").alias("subject"), F.col("source").alias("grp")), "subject", "grp", 0.1, "42")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k <= round_even(0.3 * n, 0)")
def select_fraction(t):
    """Exactly three tenths of the documents, by hash."""
    return s.select_fraction(t.documents, "doc_id", 0.3, "7")


@query("WITH u AS (SELECT doc_id, CAST('0x' || substr(sha256('v:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.7 THEN 'a' WHEN u < 0.85 THEN 'b' WHEN u < 0.95 THEN 'c' ELSE 'd' END AS variant FROM u")
def weighted_variant(t):
    """A variant for each document, in proportion to weights."""
    return s.weighted_choice(t.documents.select("doc_id"), "doc_id", [("a", 0.70), ("b", 0.15), ("c", 0.10), ("d", 0.05)], "v")


@query(
    """WITH c AS (SELECT doc_id AS id FROM documents WHERE lang = 'en'), n AS (SELECT CAST(round_even(count(*) * 0.25 / 0.75, 0) AS BIGINT) AS n FROM c),
    g AS (SELECT id, row_number() OVER (ORDER BY sha256('42:' || id), id) AS k FROM (SELECT DISTINCT conv_id AS id FROM conversations))
    SELECT id, 'core' AS kind FROM c UNION ALL SELECT id, 'general' FROM g, n WHERE k <= n.n"""
)
def mix_ratio(t):
    """English documents, and conversations that make up a quarter of the mix."""
    return s.mix(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id")), t.conversations.select(F.col("conv_id").alias("id")).distinct(), 0.25, "42")


@query("SELECT lang AS split, count(*) FILTER (n_chars <= 2500) AS kept, count(*) FILTER (n_chars > 2500) AS dropped FROM documents GROUP BY 1")
def splits_by_length(t):
    """Rows that fit a length, by split."""
    return s.splits_by_length(t.documents.withColumnRenamed("lang", "split"), "split", "n_chars", 2500)


@query(
    """WITH x AS (SELECT p_partkey, [p_brand, p_type, p_name, CAST(p_size AS VARCHAR)] AS o, p_partkey % 4 AS a, p_size % 5 AS k FROM part)
    SELECT p_partkey, array_to_string(list_concat(o[(k % 4) + 1:], o[:(k % 4)]), '|') AS options, chr(CAST(65 + ((a - k) % 4 + 4) % 4 AS INTEGER)) AS answer FROM x"""
)
def option_rotation(t):
    """Options turned left, with the answer's letter turned along."""
    options = F.array("p_brand", "p_type", "p_name", F.col("p_size").cast("string"))
    k = F.col("p_size") % 5
    return t.part.select("p_partkey", F.array_join(m.rotate(options, k), "|").alias("options"), m.letter(m.rotated_index(F.col("p_partkey") % 4, F.lit(4), k)).alias("answer"))


@query("SELECT c_custkey, CAST(c_custkey % 100 || '.' || c_nationkey || '.x' AS VARCHAR) AS id, (c_custkey % 100) || ',' || c_nationkey || ',-1' AS place FROM customer")
def natural_order(t):
    """Dotted ids with the numbers that sort them in natural order, in that order."""
    from tidemark.functions.text import natural_key

    rows = t.customer.select("c_custkey", F.concat_ws(".", (F.col("c_custkey") % 100).cast("string"), F.col("c_nationkey").cast("string"), F.lit("x")).alias("id"))
    key = natural_key(F.col("id"))
    return rows.orderBy(key, "c_custkey").select("c_custkey", "id", F.array_join(key.cast("array<string>"), ",").alias("place"))


@query("SELECT o_orderkey, 100 + CAST('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 900 AS task FROM orders")
def synthetic_task_id(t):
    """A stable number from an id's hash."""
    h = F.conv(F.substring(F.sha1(F.col("o_orderkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return t.orders.select("o_orderkey", (100 + F.pmod(h, F.lit(900))).alias("task"))
