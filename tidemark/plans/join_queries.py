"""Joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import canonical_key, native_key
from tidemark.operators import joins as j
from tidemark.operators import validate as v
from tidemark.operators.split import sample_n
from tidemark.operators.windows import todo
from tidemark.plans.catalogue import query

_KEY = "lower(trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))"


@query("SELECT d.doc_id AS id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_contains(t):
    """Benchmark items that stand word for word in a document."""
    return j.containing(t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select("item_id", F.col("text").alias("needle")))


@query(f"SELECT doc_id FROM documents WHERE {_KEY.format('text')} IN (SELECT {_KEY.format('text')} FROM benchmark) OR {_KEY.format('text')} IN (SELECT {_KEY.format('text')} FROM documents GROUP BY 1 HAVING count(*) > 1)")
def leak_exact_key(t):
    """Documents whose key is a benchmark item's, or another document's."""
    docs = t.documents.select("doc_id", native_key(F.col("text")).alias("key"))
    again = docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return j.leaks_by_key(docs, t.benchmark.select(native_key(F.col("text")).alias("key")).unionByName(again), "key").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_KEY.format('text')} IN (SELECT {_KEY.format('text')} FROM documents WHERE doc_id % 3 = 0)")
def leak_canonical_key(t):
    """Texts in capitals, with other white space, against a third of them as they are, under the canonical key (compatibility form, case folded)."""
    key = lambda c: F.sha2(canonical_key(c), 256).alias("key")
    other = F.concat(F.lit(" \n"), F.replace(F.upper("text"), F.lit(" "), F.lit("  ")))
    return j.leaks_by_key(t.documents.select("doc_id", key(other)), t.documents.where("doc_id % 3 = 0").select(key(F.col("text"))), "key").select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY {_KEY.format('text')}")
def exact_dedup_first(t):
    """The first document of each key and how many share it; copies are counted before they are dealt."""
    return t.documents.groupBy(F.sha2(native_key(F.col("text")), 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


def _verified(t):
    labels = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("agrees"), F.lit("high").alias("confidence"), F.when(F.col("toxic") == 1, "toxic").alias("concern"))
    return j.verify_filter(t.documents.select(F.col("doc_id").alias("id"), "lang", "source"), labels)


_REASON = """CASE WHEN l.doc_id IS NULL THEN 'unverified' WHEN coalesce(l.quality, 0) <> 1 THEN 'solver_disagrees' WHEN l.toxic = 1 THEN 'solver_concern' ELSE 'keep' END"""


@query(f"SELECT d.doc_id AS id, d.lang, d.source, {_REASON} AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def verify_filter(t):
    """Each document's reason to be kept or dropped."""
    return _verified(t)


@query(f"SELECT reason, lang, count(*) AS n FROM (SELECT {_REASON} AS reason, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY reason, lang")
def funnel_counts(t):
    """How many documents stay or go, and why, by language."""
    return _verified(t).groupBy("reason", "lang").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT d.doc_id AS id, {_REASON} AS reason FROM documents d LEFT JOIN labels l USING (doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS k, count(*) OVER (PARTITION BY reason) AS n FROM r)
    SELECT reason, any_value(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS examples FROM k WHERE k <= 20 GROUP BY reason"""
)
def reason_examples(t):
    """Counts by reason with the first twenty ids."""
    return j.reason_counts(_verified(t).select("id", "reason")).select("reason", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("SELECT d.source AS file, count(*) AS n_items, count(l.doc_id) AS n_answered, round(count(l.doc_id) / count(*), 4) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.source")
def coverage_per_file(t):
    """Share of documents with a label, by source."""
    return j.coverage_per_file(t.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("id")), t.labels.select(F.col("doc_id").alias("id")))


_MESSAGES = "SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id"


@query(
    f"""SELECT conv_id FROM ({_MESSAGES}) WHERE len(m) = 2 AND m[1].role = 'user' AND m[2].role = 'assistant' AND trim(m[1].text) <> '' AND length(m[1].text) <= 2000
    AND length(m[2].text) BETWEEN 20 AND 2500 AND NOT regexp_matches(m[2].text, '(?i)as an ai language model')"""
)
def single_turn_filter(t):
    """Conversations of exactly one user's and one assistant's message of sensible length."""
    return v.conversations(t.conversations).where(v.pair_ok(F.col("messages"))).select("conv_id")


@query(f"SELECT conv_id, md5({_KEY.format('text')}) AS prompt_key FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def user_prompt_key(t):
    """The key of each conversation's last user message."""
    last = v.last_user_text(F.col("messages"))
    return v.conversations(t.conversations).select("conv_id", F.md5(native_key(last)).alias("prompt_key")).where("prompt_key is not null")


@query(
    f"""WITH p AS (SELECT conv_id, {_KEY.format('text')} AS k, min(turn) OVER (PARTITION BY conv_id) AS f, turn FROM conversations WHERE role = 'user'),
    held AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 4)
    SELECT conv_id FROM p WHERE turn = f AND k NOT IN (SELECT k FROM p WHERE conv_id IN (SELECT conv_id FROM held))"""
)
def prompt_antijoin_pool(t):
    """Conversations whose first prompt no longer conversation shares: a pool without held-out prompts."""
    users = t.conversations.where("role = 'user'").select("conv_id", "turn", native_key(F.col("text")).alias("key"))
    first = users.groupBy("conv_id").agg(F.min(F.struct("turn", "key")).alias("f")).select("conv_id", F.col("f.key").alias("key"))
    held = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 4").select("conv_id")
    return j.antijoin(first, users.join(held, "conv_id", "left_semi"), "key").select("conv_id")


@query(
    """SELECT count(*) FILTER (q IS NOT NULL AND x IS NOT NULL AND x > q) AS wins, count(*) FILTER (q IS NOT NULL AND x IS NOT NULL AND x < q) AS losses,
    count(*) FILTER (q IS NOT NULL AND x IS NOT NULL AND x = q) AS ties, count(*) FILTER (q IS NULL OR x IS NULL) AS unpaired,
    CAST(sum(q) FILTER (q IS NOT NULL AND x IS NOT NULL) AS BIGINT) AS base_points, CAST(sum(x) FILTER (q IS NOT NULL AND x IS NOT NULL) AS BIGINT) AS run_points
    FROM (SELECT doc_id, quality AS q FROM labels WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id, 1 - toxic AS x FROM labels WHERE doc_id % 5 <> 0) b USING (doc_id)"""
)
def paired_compare(t):
    """Two runs over items that don't all occur in both: wins, losses, ties, unpaired, points."""
    base = t.labels.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("points"))
    run = t.labels.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), (1 - F.col("toxic")).alias("points"))
    return j.paired(base, run)


_BY_YEAR = "SELECT o_orderpriority AS subject, round(avg(o_totalprice), 4) AS points FROM orders WHERE year(o_orderdate) = {0} AND o_orderstatus <> '{1}' GROUP BY 1"


@query(f"SELECT subject, coalesce(a.points, 0) AS base, coalesce(b.points, 0) AS run, round(coalesce(b.points, 0) - coalesce(a.points, 0), 4) AS delta FROM ({_BY_YEAR.format(1995, 'P')}) a FULL JOIN ({_BY_YEAR.format(1996, 'F')}) b USING (subject)")
def per_subject_delta(t):
    """Means by priority in two years and their difference; a side that is missing counts 0."""

    def side(year, status):
        o = t.orders.where((F.year("o_orderdate") == year) & (F.col("o_orderstatus") != status))
        return o.groupBy(F.col("o_orderpriority").alias("subject")).agg(F.round(F.avg("o_totalprice"), 4).alias("points"))

    return j.deltas(side(1995, "P"), side(1996, "F"), ["subject"], "points").withColumn("delta", F.round("delta", 4))


@query("SELECT n_name, c.n AS base, s.n AS run, s.n - c.n AS delta FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s USING (k) JOIN nation ON n_nationkey = k")
def set_deltas(t):
    """Two summaries by nation; a nation on one side only has no difference."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return j.deltas(c, s, ["k"], "n", missing=None).join(t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("n_name", "base", "run", "delta")


@query(
    """WITH a AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), f AS (SELECT event_id, key, json_extract_string(props, key) AS value FROM a),
    p AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    l AS (SELECT p.event_id, f.key, f.value FROM p JOIN f ON f.event_id = p.before), r AS (SELECT p.event_id, f.key, f.value FROM p JOIN f USING (event_id) WHERE p.before IS NOT NULL)
    SELECT event_id, key, l.value AS left, r.value AS right FROM l FULL JOIN r USING (event_id, key) WHERE l.value IS DISTINCT FROM r.value"""
)
def fingerprint_diff(t):
    """What changed in an event's properties against the same user's event before."""
    from pyspark.sql import Window

    flat = j.flat_json(t.events, "props", ["event_id"])
    before = t.events.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before")).where("before is not null")
    left = before.join(flat.withColumnRenamed("event_id", "before"), "before").select("event_id", "key", "value")
    right = before.select("event_id").join(flat, "event_id").select("event_id", "key", "value")
    return j.fingerprint_diff(left, right, ["event_id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'x' || o_orderpriority ELSE o_orderstatus END AS answer, CASE WHEN o_totalprice > 200000 THEN 'override' ELSE 'base' END AS origin FROM orders")
def override_merge(t):
    """Base answers, replaced by others for listed ids, with where each came from."""
    base = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("answer"))
    other = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("x"), "o_orderpriority").alias("answer"))
    return j.override_merge(base, other, t.orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id")))


@query(
    """WITH a AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN repeat('é', 40000) ELSE l_returnflag END AS answer FROM lineitem WHERE l_linenumber >= 2),
    e AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P')
    SELECT DISTINCT 'duplicate' AS problem, id FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unexpected', id FROM a WHERE id NOT IN (SELECT id FROM e)
    UNION ALL SELECT DISTINCT 'missing', id FROM e WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT DISTINCT 'not_text', id FROM a WHERE answer IS NULL UNION ALL SELECT DISTINCT 'too_long', id FROM a WHERE length(answer) > 32767"""
)
def payload_problems(t):
    """Everything that is wrong with a set of answers."""
    answer = F.when(F.col("l_linenumber") == 3, F.lit(None)).when(F.col("l_linenumber") == 5, F.repeat(F.lit("é"), 40_000)).otherwise(F.col("l_returnflag"))
    answers = t.lineitem.where("l_linenumber >= 2").select(F.col("l_orderkey").alias("id"), answer.alias("answer"))
    return j.payload_problems(answers, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")))


@query("SELECT o_orderkey * 10 AS pos, o_orderkey AS id, coalesce(a.answer, '') AS answer FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag || l_linestatus) AS answer FROM lineitem WHERE l_quantity > 30 GROUP BY 1) a ON l_orderkey = o_orderkey")
def build_payload(t):
    """One answer for every expected id, in order, empty where there is none."""
    answers = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("answer"))
    return j.build_payload(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 10).alias("pos")), answers)


@query("SELECT n_name AS title, CASE WHEN n_regionkey = 2 THEN upper(substr(r_name, 1, 3)) WHEN n_regionkey = 1 THEN r_name ELSE n_name END AS canonical FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 4")
def resolve_titles(t):
    """Titles through normal forms and redirects to their pages, without missing pages."""
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    normal = both.where("n_regionkey in (1, 2)").select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    redirects = t.region.where("r_regionkey = 2").select(F.col("r_name").alias("source"), F.upper(F.substring("r_name", 1, 3)).alias("target"))
    missing = t.nation.where("n_regionkey = 4").select(F.col("n_name").alias("title"))
    return j.resolve_titles(t.nation.select(F.col("n_name").alias("title")), normal, redirects, missing)


@query(
    """WITH i AS (SELECT 'img/' || p_partkey || '.png' AS path, CASE WHEN p_size % 3 = 0 THEN NULL ELSE md5(p_brand) END AS sha256 FROM part),
    c AS (SELECT 'img/' || p_partkey || '.png' AS path, md5(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END) AS sha256, p_name AS description FROM part WHERE p_size > 10)
    SELECT i.path, i.sha256, coalesce(CASE WHEN i.sha256 IS NULL OR c.sha256 IS NULL OR i.sha256 = c.sha256 THEN c.description END, h.d) AS description
    FROM i LEFT JOIN c USING (path) LEFT JOIN (SELECT sha256, min(description) AS d FROM c GROUP BY 1) h ON h.sha256 = i.sha256"""
)
def verified_descriptions(t):
    """Descriptions of images by path where the hash agrees, else by hash."""
    path = F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path")
    images = t.part.select(path, F.when(F.col("p_size") % 3 != 0, F.md5("p_brand")).alias("sha256"))
    cache = t.part.where("p_size > 10").select(path, F.md5(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))).alias("sha256"), F.col("p_name").alias("description"))
    return j.descriptions(images, cache)


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE value > 20 AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = e.event_type AND d.value < 5)")
def log_resume_antijoin(t):
    """What is still to do: settings that the log has no finished row for."""
    return todo(t.events.where("value > 20").select("user_id", "event_type").distinct(), t.events.where("value < 5"), ["user_id", "event_type"])


@query("SELECT a.s AS subject, a.f AS kind FROM (SELECT DISTINCT l_shipdate::DATE AS s, l_returnflag AS f FROM lineitem WHERE l_linestatus = 'O') a LEFT JOIN (SELECT DISTINCT l_shipdate::DATE AS s, l_returnflag AS f FROM lineitem WHERE l_quantity > 48) b USING (s, f) WHERE b.s IS NULL")
def scope_gaps(t):
    """Required combinations that nothing covers."""
    from tidemark.operators.gates import scope_gaps as gaps

    pairs = t.lineitem.select(F.to_date("l_shipdate").alias("subject"), F.col("l_returnflag").alias("kind"), "l_linestatus", "l_quantity")
    return gaps(pairs.where("l_quantity > 48"), pairs.where("l_linestatus = 'O'"), ["subject", "kind"])


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n, max(CASE WHEN k = 1 THEN role END) AS r1, max(CASE WHEN k = 2 THEN role END) AS r2, max(CASE WHEN k = 1 THEN text END) AS u, max(CASE WHEN k = 2 THEN text END) AS a FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) GROUP BY 1),
    o AS (SELECT lower(trim(regexp_replace(u, '\\s+', ' ', 'g'))) AS key, min(conv_id) AS id FROM c WHERE n = 2 AND r1 = 'user' AND r2 = 'assistant' AND trim(u) <> '' AND length(u) <= 2000 AND length(a) BETWEEN 20 AND 2500 AND NOT regexp_matches(a, '(?i)as an ai language model') GROUP BY 1)
    SELECT id FROM (SELECT id, row_number() OVER (ORDER BY sha256('42:' || id), id) AS k FROM o) WHERE k <= 200"""
)
def general_pool(t):
    """A seeded sample of 200 conversations that pass the filter, without held-out prompts (the sample is the operator)."""
    c = v.conversations(t.conversations).where(v.pair_ok(F.col("messages"))).select(F.col("conv_id").alias("id"), native_key(v.last_user_text(F.col("messages"))).alias("key"))
    return sample_n(c.groupBy("key").agg(F.min("id").alias("id")).select("id"), "id", 200, "42")
