"""Joins: verification, contamination, overrides, comparisons. Every drop is a label; rows are kept to the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text to search for that are broadcast together; more is searched for in several passes.
BROADCAST_BYTES = 8 << 20


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key, the first by the order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def verify_filter(items: DataFrame, answers: DataFrame, *, drop_concerns: bool = True) -> DataFrame:
    """Items (id, ...) with answers (id, agrees, confidence, concern), each labelled by the first rule that holds.

    unverified, solver_disagrees, low_confidence, solver_concern, else keep; ids are unique in `answers`.
    """
    a = answers.select(F.col("id"), "agrees", "confidence", "concern", F.lit(True).alias("_there"))
    concern = F.lit(drop_concerns) & (F.coalesce(F.trim("concern"), F.lit("")) != "")
    reason = (
        F.when(F.col("_there").isNull(), "unverified")
        .when(~F.coalesce("agrees", F.lit(False)), "solver_disagrees")
        .when(F.lower(F.coalesce("confidence", F.lit(""))) == "low", "low_confidence")
        .when(concern, "solver_concern")
        .otherwise("keep")
    )
    return items.join(a, "id", "left").withColumn("reason", reason).drop("_there", "agrees", "confidence", "concern")


def reason_counts(labelled: DataFrame, examples: int = 20) -> DataFrame:
    """reason, n, and the first ids of each reason."""
    w = Window.partitionBy("reason").orderBy("id")
    few = labelled.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= examples)
    shown = few.groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return labelled.groupBy("reason").agg(F.count("*").alias("n")).join(shown, "reason")


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(id, item_id) where a text (id, text) holds a needle (item_id, needle) verbatim, each pair once.

    Needles of five words or more are met by an equi-join: their second to fourth word, with what stands between them, against all
    runs of three words of the text; the first word may be a part of a longer one. Only ids and runs are joined, and the texts of the few
    that meet are fetched afterwards. Needles without such an anchor are looked for all at once, by an automaton over them that reads each text
    once; they are broadcast in blocks of at most BROADCAST_BYTES.
    """
    run = r"[^ \n]+[ \n][^ \n]+[ \n][^ \n]+"
    keyed = needles.withColumn("_run", F.nullif(F.regexp_extract("needle", rf"^[^ \n]*[ \n]({run})[ \n]", 1), F.lit("")))
    anchored = keyed.where(F.col("_run").isNotNull()).select("item_id", "needle", "_run")
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?<![^ \n])(?=({run}))[^ \n]+"), F.lit(1)))
    met = texts.select("id", F.explode(runs).alias("_run")).join(anchored.select("item_id", "_run"), "_run").select("id", "item_id").distinct()
    found = met.join(texts.select("id", "text"), "id").join(anchored.select("item_id", "needle"), "item_id").where(F.contains("text", "needle")).select("id", "item_id")
    block, weight = [], 0
    for r in keyed.where(F.col("_run").isNull() & (F.length("needle") > 0)).select("item_id", "needle").toLocalIterator():
        block.append((r.item_id, r.needle))
        weight += len(r.needle.encode())
        if weight >= BROADCAST_BYTES:
            found, block, weight = found.unionByName(_with_any(texts, block, found.schema)), [], 0
    if block:
        found = found.unionByName(_with_any(texts, block, found.schema))
    return found.distinct()


def _with_any(texts: DataFrame, needles: list[tuple], schema) -> DataFrame:
    """(id, item_id) of the needles of one block that a text holds."""
    shared = texts.sparkSession.sparkContext.broadcast(needles)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        owners: dict[str, list] = {}
        for item, needle in shared.value:
            owners.setdefault(needle, []).append(item)
        automaton = ahocorasick.Automaton()
        for needle, items in owners.items():
            automaton.add_word(needle, items)
        automaton.make_automaton()
        for b in batches:
            hits = [(i, item) for i, text in enumerate(b.column(1).to_pylist()) if text for item in {x for _, items in automaton.iter(text) for x in items}]
            ids = b.column(0).take(pa.array([i for i, _ in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([item for _, item in hits], _arrow(schema["item_id"].dataType))], names=["id", "item_id"])

    return texts.select("id", "text").mapInArrow(run, schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def leaks_by_key(candidates: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is among the protected ones."""
    return candidates.join(protected.select(key).distinct(), key, "left_semi")


def antijoin(candidates: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Candidates whose key isn't among the protected ones."""
    return candidates.join(protected.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def paired(base: DataFrame, run: DataFrame) -> DataFrame:
    """One row: wins, losses, ties, unpaired, base_points, run_points; both sides: id, points, ids unique."""
    both = base.select("id", F.col("points").alias("_b")).join(run.select("id", F.col("points").alias("_r")), "id", "full")
    pair = F.col("_b").isNotNull() & F.col("_r").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(
        count(pair & (F.col("_r") > F.col("_b"))).alias("wins"),
        count(pair & (F.col("_r") < F.col("_b"))).alias("losses"),
        count(pair & (F.col("_r") == F.col("_b"))).alias("ties"),
        count(~pair).alias("unpaired"),
        F.sum(F.when(pair, F.col("_b"))).alias("base_points"),
        F.sum(F.when(pair, F.col("_r"))).alias("run_points"),
    )


def deltas(base: DataFrame, run: DataFrame, keys: list[str], value: str, *, missing: float | None = 0.0) -> DataFrame:
    """keys, base, run, delta of two summaries; a side that lacks a key counts `missing` (None: the delta is null)."""
    b, r = base.select(*keys, F.col(value).alias("base")), run.select(*keys, F.col(value).alias("run"))
    both = b.join(r, keys, "full")
    if missing is not None:
        both = both.fillna(missing, ["base", "run"])
    return both.withColumn("delta", F.col("run") - F.col("base"))


def fingerprint_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and values of two flattened trees (keys..., key, value) that differ or stand on one side only."""
    left, right = a.select(*keys, "key", F.col("value").alias("left")), b.select(*keys, "key", F.col("value").alias("right"))
    return left.join(right, [*keys, "key"], "full").where(~F.col("left").eqNullSafe(F.col("right")))


def flat_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep..., key, value of each top-level member of a JSON object column, values as text."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select(*keep, F.explode(parsed).alias("key", "value"))


def override_merge(base: DataFrame, other: DataFrame, ids: DataFrame) -> DataFrame:
    """Answers (id, answer) of `base`, replaced by `other`'s for the listed ids, with where each came from."""
    o = other.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("answer").alias("_other"), F.lit(True).alias("_there"))
    both = base.join(o, "id", "left")
    return both.select("id", F.when(F.col("_there"), F.col("_other")).otherwise(F.col("answer")).alias("answer"), F.when(F.col("_there"), "override").otherwise("base").alias("origin"))


def payload_problems(answers: DataFrame, expected: DataFrame, most_units: int = 32_767) -> DataFrame:
    """(problem, id) rows: duplicate, unexpected and missing ids, answers that are null or longer than the limit in UTF-16 units."""
    counted = answers.groupBy("id").agg(F.count("*").alias("n"))
    label = lambda df, name: df.select(F.lit(name).alias("problem"), "id").distinct()
    units = F.octet_length(F.encode(F.col("answer"), "UTF-16LE")) / 2
    return (
        label(counted.where("n > 1"), "duplicate")
        .unionByName(label(answers.join(expected, "id", "left_anti"), "unexpected"))
        .unionByName(label(expected.join(answers, "id", "left_anti"), "missing"))
        .unionByName(label(answers.where(F.col("answer").isNull()), "not_text"))
        .unionByName(label(answers.where(units > most_units), "too_long"))
    )


def build_payload(template: DataFrame, answers: DataFrame, most_units: int = 32_767) -> DataFrame:
    """pos, id, answer for every template id once, in order; missing answers are empty, long ones cut to the limit."""
    one = first_per(answers, ["id"], [F.col("answer").asc_nulls_last()])
    cut = F.decode(F.substring(F.encode(F.coalesce("answer", F.lit("")), "UTF-16LE"), 1, 2 * most_units), "UTF-16LE")
    return template.join(one, "id", "left").select("pos", "id", cut.alias("answer")).orderBy("pos")


def resolve_titles(titles: DataFrame, normalized: DataFrame, redirects: DataFrame, missing: DataFrame) -> DataFrame:
    """title, canonical: titles through a table of normal forms, then of redirects (both: source, target), without missing ones."""
    n = normalized.select(F.col("source").alias("title"), F.col("target").alias("_n"))
    step = titles.select("title").join(n, "title", "left").withColumn("_n", F.coalesce("_n", "title"))
    r = redirects.select(F.col("source").alias("_n"), F.col("target").alias("_r"))
    found = step.join(r, "_n", "left").select("title", F.coalesce("_r", "_n").alias("canonical"))
    return found.join(missing.select(F.col("title").alias("canonical")), "canonical", "left_anti").select("title", "canonical")


def descriptions(images: DataFrame, cache: DataFrame) -> DataFrame:
    """images (path, sha256) with cache entries (path, sha256, description): by path if no hash speaks against it, else any entry of the same hash."""
    c = cache.select(F.col("path"), F.col("sha256").alias("_sha"), F.col("description").alias("_d"))
    by_path = images.join(c, "path", "left").withColumn("_d", F.when(F.col("sha256").isNull() | F.col("_sha").isNull() | (F.col("sha256") == F.col("_sha")), F.col("_d"))).drop("_sha")
    by_hash = cache.groupBy("sha256").agg(F.min("description").alias("_h"))
    return by_path.join(by_hash, "sha256", "left").select("path", "sha256", F.coalesce("_d", "_h").alias("description"))


def by_path_or_name(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """path, description: an exact path, else the only known path with the same last part."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    exact = known.select("path", F.col("description").alias("_e"))
    names = known.withColumn("_name", base(F.col("path"))).groupBy("_name").agg(F.count("*").alias("_n"), F.max("description").alias("_u")).where("_n = 1")
    return wanted.join(exact, "path", "left").withColumn("_name", base(F.col("path"))).join(names, "_name", "left").select("path", F.coalesce("_e", "_u").alias("description"))


def must_be_empty(df: DataFrame, what: str) -> None:
    """Raise if there is any row, naming a few."""
    found = df.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def coverage_per_file(items: DataFrame, answers: DataFrame) -> DataFrame:
    """file, n_items, n_answered, share (rounded to 4) of items (file, id) that have an answer (id)."""
    there = answers.select("id").distinct().withColumn("_a", F.lit(1))
    g = items.join(there, "id", "left").groupBy("file").agg(F.count("*").alias("n_items"), F.coalesce(F.sum("_a"), F.lit(0)).cast("long").alias("n_answered"))
    return g.withColumn("share", F.round(F.col("n_answered") / F.col("n_items"), 4))


def any_of(*conditions: Column) -> Column:
    """Whether any condition holds; null counts as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
