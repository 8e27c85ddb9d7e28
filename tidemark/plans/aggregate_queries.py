"""Aggregates, statistics, grading and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as m
from tidemark.operators import aggregates as a
from tidemark.operators import gates as g
from tidemark.plans.catalogue import query

_RECORDS = """SELECT l_returnflag AS subject, l_linestatus AS type, CAST(l_linenumber AS BIGINT) AS points, 7 AS max_points, least(7, l_linenumber + 1) AS points_lenient, l_discount > 0.02 AS parse_ok, l_shipdate FROM lineitem"""


@query(
    f"""SELECT CASE WHEN GROUPING(subject) = 1 AND GROUPING(type) = 1 THEN 'total' WHEN GROUPING(type) = 1 THEN 'subject' ELSE 'type' END AS level, subject, type, count(*) AS n,
    CAST(sum(points) AS BIGINT) AS points, CAST(sum(max_points) AS BIGINT) AS max_points, CAST(sum(CASE WHEN parse_ok THEN 0 ELSE 1 END) AS BIGINT) AS parse_fail, CAST(sum(points_lenient) AS BIGINT) AS points_lenient,
    round(100.0 * sum(points)::DOUBLE / sum(max_points)::DOUBLE, 2) AS score_pct, round(sum(CASE WHEN parse_ok THEN 0 ELSE 1 END)::DOUBLE / count(*), 4) AS parse_fail_rate, CAST(sum(points_lenient) - sum(points) AS DOUBLE) AS format_loss
    FROM ({_RECORDS}) GROUP BY GROUPING SETS ((), (subject), (type))"""
)
def grade_summary(t):
    """Totals of graded records, in all, by subject and by type."""
    r = t.lineitem.select(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("type"), F.col("l_linenumber").cast("long").alias("points"), F.lit(7).alias("max_points"), F.least(F.lit(7), F.col("l_linenumber") + 1).alias("points_lenient"), (F.col("l_discount") > 0.02).alias("parse_ok"))
    return a.summarize(r).withColumn("format_loss", F.col("format_loss").cast("double"))


@query("SELECT l_shipmode AS reason, n FROM (SELECT l_returnflag || l_linenumber AS l_shipmode, count(*) AS n FROM lineitem WHERE l_discount <= 0.02 GROUP BY 1)")
def fail_reasons(t):
    """Why records failed, most frequent first."""
    r = t.lineitem.select((F.col("l_discount") > 0.02).alias("parse_ok"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("parse_reason"))
    return a.fail_reasons(r)


@query("SELECT event_type AS subject, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM events GROUP BY 1")
def accuracy_by_subject(t):
    """Share of right answers by subject."""
    return a.accuracy(t.events.select(F.col("event_type").alias("subject"), (F.col("value") > 10).alias("correct")), ["subject"])


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN k >= 7 THEN 10 WHEN k >= 5 THEN 6 WHEN k >= 3 THEN 3 WHEN k >= 2 THEN 1 ELSE 0 END AS points
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 8 AS k FROM lineitem)"""
)
def partial_credit(t):
    """Points by a table of least numbers of right parts."""
    k = (F.col("l_quantity").cast("int") % 8).alias("k")
    table = F.array(*[F.struct(F.lit(x).alias("min_correct"), F.lit(p).alias("points")) for x, p in ((5, 6), (2, 1), (3, 3))])
    return t.lineitem.select("l_orderkey", "l_linenumber", k).select("l_orderkey", "l_linenumber", m.partial_points(F.col("k"), F.lit(7), F.lit(10), table).alias("points"))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice * (1 - l_discount) - l_extendedprice * 0.95) <= 0.01 * abs(l_extendedprice * 0.95) + 1e-12 AS near, abs(l_tax - l_discount) <= 1e-6 + 1e-12 AS same FROM lineitem")
def numeric_close(t):
    """Numbers within a given and within the default tolerance."""
    gold = F.col("l_extendedprice") * 0.95
    return t.lineitem.select("l_orderkey", "l_linenumber", m.numeric_close(F.col("l_extendedprice") * (1 - F.col("l_discount")), gold, F.lit(0.01) * F.abs(gold)).alias("near"), m.numeric_close(F.col("l_tax"), F.col("l_discount")).alias("same"))


@query(
    """WITH x AS (SELECT event_id, [event_id % 2, event_id % 3, event_id % 5] AS g, [user_id % 2, user_id % 3, user_id % 5, 1] AS k FROM events)
    SELECT event_id, CAST((g[1] = k[1])::INT + (g[2] = k[2])::INT + (g[3] = k[3])::INT AS INTEGER) AS n_right, CAST(greatest(0, len(list_intersect(list_distinct(g), list_distinct(k))) - (len(list_distinct(g)) - len(list_intersect(list_distinct(g), list_distinct(k))))) AS INTEGER) AS n_picked FROM x"""
)
def verdict_parts(t):
    """Right places of two lists, and right picks less wrong ones."""
    given = F.array(*[F.col("event_id") % k for k in (2, 3, 5)])
    key = F.array(*[F.col("user_id") % k for k in (2, 3, 5)], F.lit(1).cast("long"))
    return t.events.select("event_id", m.correct_parts(given, key).alias("n_right"), m.multi_correct(given, F.array_distinct(key)).alias("n_picked"))


@query(
    """WITH RECURSIVE c AS (SELECT lang, count(*) FILTER (quality > toxic) AS w, count(*) FILTER (quality < toxic) AS l FROM labels JOIN documents USING (doc_id) GROUP BY lang),
    s AS (SELECT lang, w, l, 0 AS i, pow(0.5, w + l) AS p, pow(0.5, w + l) AS total FROM c UNION ALL SELECT lang, w, l, i + 1, p * (w + l - i) / (i + 1), total + p * (w + l - i) / (i + 1) FROM s WHERE i < least(w, l))
    SELECT lang, w AS wins, l AS losses, round(CASE WHEN w + l = 0 THEN 1.0 ELSE least(1.0, 2 * max(total)) END, 9) AS p FROM s GROUP BY lang, w, l"""
)
def sign_test(t):
    """Exact two-sided sign test by language."""
    c = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") > F.col("toxic")).alias("wins"), F.count_if(F.col("quality") < F.col("toxic")).alias("losses"))
    return c.withColumn("p", F.round(a.sign_test(F.col("wins"), F.col("losses")), 9))


@query()
def bootstrap_ci(t):
    """Percentile bootstrap of the difference between two labels, by language (no SQL: pseudo-random draws)."""
    p = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("lang", F.col("toxic").cast("double").alias("base"), F.col("quality").cast("double").alias("run"))
    return a.bootstrap_ci(p, ["lang"])


@query(
    """SELECT user_id AS id, coalesce(round(sum(value) FILTER (event_type = 'click'), 4), 0) AS click, coalesce(round(sum(value) FILTER (event_type = 'purchase'), 4), 0) AS purchase, coalesce(round(sum(value) FILTER (event_type = 'signup'), 4), 0) AS signup FROM events GROUP BY user_id"""
)
def judge_pivot(t):
    """Points by user and kind, 0 where there are none."""
    wide = a.judge_pivot(t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("value").alias("points")), ["click", "purchase", "signup"])
    return wide.select("id", *[F.round(F.col(k), 4).alias(k) for k in ("click", "purchase", "signup")])


@query(
    """WITH x AS (SELECT vec_id AS id, unnest(['A', 'B', 'C', 'D']) AS letter, unnest([CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)]) AS logit FROM embeddings),
    p AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY id) AS p, sum(exp(logit)) OVER (PARTITION BY id) / exp(2.0) AS m, row_number() OVER (PARTITION BY id ORDER BY logit DESC, letter) AS k FROM x)
    SELECT id, letter, round(p, 6) AS probability, round(m, 6) AS letter_mass FROM p WHERE k = 1"""
)
def letter_protocol(t):
    """Softmax over an item's letters, the chosen one and the mass on letters."""
    e = F.col("embedding")
    x = t.embeddings.select(F.col("vec_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), e[k].cast("double").alias("logit")) for k, c in enumerate("ABCD")])).alias("x"))
    out = a.letter_protocol(x.select("id", "x.*", F.lit(2.0).alias("all_mass")))
    return out.select("id", "letter", F.round("probability", 6).alias("probability"), F.round("letter_mass", 6).alias("letter_mass"))


@query("SELECT event_type, CAST(sum(user_id % 10) AS BIGINT) AS n_tokens, CASE WHEN sum(user_id % 10) > 0 THEN round(sum(value) / sum(user_id % 10), 6) END AS mean FROM events GROUP BY 1")
def token_weighted_mean(t):
    """A loss by token, weighted by tokens."""
    r = a.token_weighted_mean(t.events.withColumn("n", F.col("user_id") % 10), ["event_type"], "value", "n")
    return r.withColumn("mean", F.round("mean", 6))


@query(
    """WITH v AS (SELECT user_id AS item, event_id % 3 AS unit, event_type AS value, event_id AS pos, event_id % 11 = 0 AS greedy FROM events),
    c AS (SELECT item, unit, value, count(*) AS n_votes, max(greedy::INT) AS gr, min(pos) AS f FROM v GROUP BY ALL)
    SELECT item, unit, value, n_votes FROM c QUALIFY row_number() OVER (PARTITION BY item, unit ORDER BY n_votes DESC, gr DESC, f, value) = 1"""
)
def majority_vote(t):
    """The winning value of each unit; ties by the greedy answer, then the first seen."""
    e = t.events
    return a.majority_vote(e.select(F.col("user_id").alias("item"), (F.col("event_id") % 3).alias("unit"), F.col("event_type").alias("value"), F.col("event_id").alias("pos"), (F.col("event_id") % 11 == 0).alias("greedy")))


@query(
    """WITH c AS (SELECT user_id AS item, event_id % 3 AS unit, event_type AS value, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT item, unit, list(n ORDER BY n DESC) AS x FROM c GROUP BY ALL)
    SELECT item, unit, x[1] - coalesce(x[2], 0) > 2 AS decided FROM r"""
)
def vote_decided(t):
    """Whether two more votes could change a winner."""
    return a.vote_decided(t.events.select(F.col("user_id").alias("item"), (F.col("event_id") % 3).alias("unit"), F.col("event_type").alias("value")), 2)


@query(
    """WITH k AS (SELECT lang AS kind, count(*) FILTER (n_chars <= 3000) AS kept, count(*) FILTER (n_chars > 3000) AS dropped, CAST(coalesce(sum(length(source)) FILTER (n_chars <= 3000), 0) AS BIGINT) AS tokens FROM documents GROUP BY 1)
    SELECT *, round(tokens / sum(tokens) OVER (), 9) AS token_share FROM k"""
)
def train_composition(t):
    """What a length limit leaves of each kind, and each kind's share of tokens."""
    r = a.composition(t.documents.select(F.col("lang").alias("kind"), F.col("n_chars").alias("n_tokens"), F.length("source").alias("n_completion")), 3000)
    return r.withColumn("token_share", F.round("token_share", 9))


@query("SELECT lang, count(*) AS n, min(n_chars) AS low, (list(n_chars ORDER BY n_chars))[count(*) // 2 + 1] AS median, max(n_chars) AS high FROM documents GROUP BY lang")
def length_stats(t):
    """Least, upper median and greatest length by language."""
    return a.upper_median(t.documents, ["lang"], "n_chars")


@query("SELECT letter AS value, count(l_returnflag) AS n FROM (VALUES ('A'), ('B'), ('N'), ('R'), ('Z')) v(letter) LEFT JOIN lineitem ON l_returnflag = letter GROUP BY 1")
def answer_counts(t):
    """A histogram over listed answers, with those that don't occur."""
    return a.histogram(t.lineitem, "l_returnflag", ["A", "B", "N", "R", "Z"])


@query(
    """SELECT source, n_all, n_hits, round(n_hits / n_all, 6) AS ratio FROM (SELECT source, CAST(sum(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))) AS BIGINT) AS n_all, CAST(sum(length(regexp_replace(text, '[^À-ÖØ-öø-ÿ]', '', 'g'))) AS BIGINT) AS n_hits FROM documents GROUP BY 1) WHERE n_all >= 1500"""
)
def broken_encoding(t):
    """Share of letters with marks in each source that has enough letters."""
    from tidemark.functions.text import count_class

    hits = count_class(F.col("text"), "[À-ÖØ-öø-ÿ]")
    return a.group_ratio(t.documents, "source", hits, count_class(F.col("text"), "[A-Za-zÀ-ÖØ-öø-ÿ]"), 1500)


_MEASURES = """SELECT event_type AS run, 'delta' AS measure, NULL AS subject, round(avg(value), 6) AS value FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'variant_delta', 'v' || (user_id % 3), round(avg(value) - 12, 6) FROM events GROUP BY ALL
    UNION ALL SELECT event_type, 'parse_fail_delta', NULL, CAST(count(*) % 2 AS DOUBLE) FROM events GROUP BY 1"""
_GATE = f"""m AS ({_MEASURES}), r(rule, measure, sense, bound, required) AS (VALUES ('1', 'delta', '>=', 2.0::DOUBLE, true), ('2', 'parse_fail_delta', '<=', 0.0, true), ('3', 'general_nll_ratio', '<=', 1.05, true), ('4', 'variant_delta', '>=', -1.0, false),
    ('5', 'secondary_delta', '>=', -1.0, false), ('6', 'net_wins', '>=', 0.0, true), ('7', 'loglik_delta', '>=', -3.0, false), ('8', 'lenient_delta', '>=', 0.0, true), ('9', 'letter_accuracy_delta', '>=', -3.0, false)),
    e AS (SELECT run, rule, coalesce(subject, '') AS subject, value, bound, coalesce(CASE WHEN sense = '>=' THEN value >= bound - 1e-9 ELSE value <= bound + 1e-9 END, false) AS ok
    FROM (SELECT DISTINCT run FROM m) CROSS JOIN r LEFT JOIN m USING (run, measure) WHERE value IS NOT NULL OR required)"""


def _measures(t):
    e = t.events.withColumnRenamed("event_type", "run")
    none = F.lit(None).cast("string")
    rows = e.groupBy("run").agg(F.round(F.avg("value"), 6).alias("value")).select("run", F.lit("delta").alias("measure"), none.alias("subject"), "value")
    by = e.groupBy("run", (F.col("user_id") % 3).alias("k")).agg(F.round(F.avg("value") - 12, 6).alias("value")).select("run", F.lit("variant_delta").alias("measure"), F.concat(F.lit("v"), F.col("k").cast("string")).alias("subject"), "value")
    odd = e.groupBy("run").agg((F.count("*") % 2).cast("double").alias("value")).select("run", F.lit("parse_fail_delta").alias("measure"), none.alias("subject"), "value")
    return rows.unionByName(by).unionByName(odd)


@query(f"WITH {_GATE} SELECT * FROM e")
def gate_rules(t):
    """Every rule for every run: value, bound and verdict."""
    return g.evaluate(_measures(t))


@query(f"WITH {_GATE} SELECT run, bool_and(ok) AS passed, string_agg(DISTINCT CASE WHEN NOT ok THEN rule END, ',' ORDER BY CASE WHEN NOT ok THEN rule END) AS failed FROM e GROUP BY run")
def gate_verdicts(t):
    """Which runs pass, and which rules the others fail."""
    return g.verdicts(g.evaluate(_measures(t)))


@query("SELECT count(*) AS calls, CAST(sum(l_linenumber) AS BIGINT) AS prompt_tokens, CAST(sum(l_orderkey % 100) AS BIGINT) AS completion_tokens, round(coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0), 6) AS mean_duration FROM lineitem")
def usage_totals(t):
    """Sums of usage over calls, and the mean duration of the successful ones."""
    done = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    return t.lineitem.agg(F.count("*").alias("calls"), F.sum("l_linenumber").alias("prompt_tokens"), F.sum(F.col("l_orderkey") % 100).alias("completion_tokens"), F.round(F.coalesce(F.avg(done), F.lit(0.0)), 6).alias("mean_duration"))


@query(
    """SELECT c_mktsegment AS segment, c_custkey, round(c_acctbal / nullif(sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 0), 9) AS share FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5"""
)
def best_of_group(t):
    """The five best of each group (a top-k report) with their share of the group's total."""
    w = Window.partitionBy("c_mktsegment")
    ranked = t.customer.withColumns({"k": F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")), "all": F.sum("c_acctbal").over(w)})
    return ranked.where("k <= 5").select(F.col("c_mktsegment").alias("segment"), "c_custkey", F.round(F.col("c_acctbal") / F.nullif(F.col("all"), F.lit(0.0)), 9).alias("share"))
