"""Compositions: a verified, decontaminated and deduplicated dataset, its splits and mix, and the log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import native_key
from tidemark.operators import joins, near, split, windows
from tidemark.plans.session import written



def protected_hits(candidates: DataFrame, protected: DataFrame, key: str = "key") -> DataFrame:
    """id, set_name of candidates whose key is protected, attributed to the first set by rank; both: id/set_name, set_rank, key."""
    first = protected.groupBy(key).agg(F.min(F.struct("set_rank", "set_name")).alias("_s"))
    return candidates.join(first, key).select("id", F.col("_s.set_name").alias("set_name"))


def clean_dataset(items: DataFrame, answers: DataFrame, protected: DataFrame, blocked: DataFrame) -> DataFrame:
    """Items (id, pos, text, ...) with `reason`: keep, or the first stage that drops an item.

    In order: what verification says, a protected key (by set), a blocked id, a repeat of a kept item's key. Every item stays as a row.
    """
    verified = joins.verify_filter(items.withColumn("key", native_key(F.col("text"))), answers)
    marked = verified.join(protected_hits(verified, protected).withColumnRenamed("set_name", "_set"), "id", "left").join(blocked.select("id").distinct().withColumn("_blocked", F.lit(True)), "id", "left")
    reason = F.when(F.col("reason") != "keep", F.col("reason")).when(F.col("_set").isNotNull(), F.concat(F.lit("dup_"), "_set")).when(F.col("_blocked"), "blocklist").otherwise("keep")
    staged = marked.withColumn("reason", reason).drop("_set", "_blocked")
    # of kept items with one key the first stays; a key that many share is one row for each task before it is dealt
    first = staged.where("reason = 'keep'").groupBy("key").agg(F.min(F.struct("pos", "id")).alias("_first")).select("key", F.col("_first.id").alias("_first"))
    again = (F.col("reason") == "keep") & (F.col("_first") != F.col("id"))
    return staged.join(first, "key", "left").withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).drop("_first", "key")


def funnel(labelled: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, reason, n: the funnel of a labelled dataset, in one aggregate."""
    return labelled.groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def processed(items: DataFrame, general: DataFrame, *, fraction: float, ratio: float, seed: str, variants: list[tuple[str, float]]) -> DataFrame:
    """id, kind, split, variant: items split by whole groups, each training item with a prompt variant, and general rows mixed in.

    items: id, subject, grp; general: id.
    """
    groups = split.group_split(items, "subject", "grp", fraction, seed).select("subject", "grp", "split")
    placed = written(items.join(groups, ["subject", "grp"]).select("id", "split"), "placed")
    train = placed.where("split = 'train'")
    mixed = split.mix(train.select("id"), general, ratio, seed)
    core = split.weighted_choice(mixed.where("kind = 'core'"), "id", variants, seed)
    return (
        core.withColumn("split", F.lit("train"))
        .unionByName(mixed.where("kind = 'general'").withColumns({"variant": F.lit(variants[0][0]), "split": F.lit("train")}))
        .unionByName(placed.where("split = 'val'").select("id", F.lit("core").alias("kind"), F.lit(variants[0][0]).alias("variant"), "split"))
        .select("id", "kind", "split", "variant")
    )


def append_run(spark, path: str, row: DataFrame) -> None:
    """Add rows to the log of runs."""
    row.write.mode("append").parquet(path)


def current_runs(log: DataFrame) -> DataFrame:
    """The latest `run` row of each run; log: event, run, at, pos, ..."""
    return windows.latest_per(log.where("event = 'run'"), ["run"], [F.desc("at"), F.desc("pos")])


def staleness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """path, state (changed or not_deduplicated) of files whose hash isn't what was recorded; both: path, sha."""
    r, c = recorded.select("path", F.col("sha").alias("_r")), current.select("path", F.col("sha").alias("_c"))
    both = c.join(r, "path", "left")
    return both.select("path", F.when(F.col("_r").isNull(), "not_deduplicated").when(F.col("_r") != F.col("_c"), "changed").alias("state")).where("state is not null")


def step_means(log: DataFrame) -> DataFrame:
    """step, eval_loss, train_loss of each evaluation: its own loss, and the mean of the train losses since the one before.

    log: step, kind (train or eval), loss.
    """
    evals = log.where("kind = 'eval'").groupBy("step").agg(F.avg("loss").alias("eval_loss"))
    nxt = F.min(F.when(F.col("kind") == "eval", F.col("step"))).over(Window.partitionBy().orderBy("step").rangeBetween(0, Window.unboundedFollowing))
    rounds = log.withColumn("_round", nxt).where("kind = 'train' and _round is not null").groupBy(F.col("_round").alias("step")).agg(F.avg("loss").alias("train_loss"))
    return evals.join(rounds, "step", "left").select("step", "eval_loss", "train_loss")


def predicted_letters(scores: DataFrame) -> DataFrame:
    """id, letter: the most probable letter, the first on ties; scores: id, letter, logprob."""
    return joins.first_per(scores, ["id"], [F.desc("logprob"), "letter"]).select("id", "letter")


#: Fixed values of the history builder: letters and share below which a paper's encoding is broken, overlap of copied papers, last training year, fingerprint lengths.
LEAST_LETTERS, LEAST_MARKED, COPIED, LAST_TRAIN_YEAR, PRINT_QUESTION, PRINT_SOURCE = 1500, 0.035, 0.95, 2024, 400, 600


def history_dataset(rows: DataFrame, marked_class: str = "[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]") -> DataFrame:
    """Task rows (id, paper, year, pos, question, source, answer_key) labelled with split and reason; no row is left out.

    In order, the first that holds: broken_encoding (of the paper), copied_paper (another paper of the year holds nearly all its tasks and is the
    better copy), empty_question, a repeat of an earlier task (duplicate_of_ the split of the first), no_key, missing_source. A task without a
    source that cites one takes the last source before it in its paper.
    """
    from tidemark.functions.text import ascii_key, count_class, fingerprint
    from tidemark.operators.exam import missing_source, paper_id

    text = F.concat_ws(" ", "question", "source")
    base = rows.withColumns({"paper": paper_id(F.col("paper")), "year": F.col("year").try_cast("int")})
    prints = F.concat(F.substring(ascii_key(F.coalesce("question", F.lit(""))), 1, PRINT_QUESTION), F.lit("|"), F.substring(ascii_key(F.coalesce("source", F.lit(""))), 1, PRINT_SOURCE))
    base = written(base.withColumn("print", fingerprint(prints, PRINT_QUESTION + PRINT_SOURCE + 1)), "tasks")

    papers = base.groupBy("paper").agg(F.min("year").alias("year"), F.sum(count_class(text, r"\p{L}")).alias("letters"), F.sum(count_class(text, marked_class)).alias("marked"), F.count_if(F.coalesce(F.trim("answer_key"), F.lit("")) != "").alias("keyed"))
    broken = papers.where((F.col("letters") >= LEAST_LETTERS) & (F.col("marked") / F.col("letters") < LEAST_MARKED)).select("paper", F.lit(True).alias("_broken"))
    tasks = base.where(F.coalesce(F.trim("question"), F.lit("")) != "").select(F.col("paper").alias("grp"), "year", "print").distinct()
    clusters = near.components(near.copy_links(tasks, COPIED)).withColumnsRenamed({"node": "paper", "root": "cluster"})
    coded = F.col("paper").rlike(r"^[A-Z]{3,4}-R\d-\d{3}")
    best = near.canonical_members(papers.join(clusters, "paper"), "cluster", [F.desc(coded), F.desc("keyed"), F.length("paper"), "paper"])
    copies = clusters.join(best.select("paper"), "paper", "left_anti").select("paper", F.lit(True).alias("_copy"))

    carried = windows.carry_forward(base.withColumn("_source", F.nullif(F.trim("source"), F.lit(""))), ["paper"], ["pos", "id"], "_source", "_before")
    cites = F.coalesce(F.col("question").rlike(r"(?iu)źród[łl]"), F.lit(False))
    full = carried.withColumn("source", F.coalesce("_source", F.when(cites, F.col("_before")), F.lit(""))).drop("_source", "_before")
    split_ = F.when(F.col("year") > LAST_TRAIN_YEAR, "dev").otherwise("train")
    marked = full.withColumn("split", split_).join(broken, "paper", "left").join(copies, "paper", "left")
    early = F.when(F.col("_broken"), "broken_encoding").when(F.col("_copy"), "copied_paper").when(F.coalesce(F.trim("question"), F.lit("")) == "", "empty_question")
    staged = marked.withColumn("reason", early).drop("_broken", "_copy")
    seen = windows.first_seen(staged.where("reason is null"), "print", [F.when(F.col("split") == "dev", 0).otherwise(1), F.coalesce(-F.col("year"), F.lit(1 << 30)), "id"], "split").select("id", "verdict")
    late = F.when(F.col("verdict") != "keep", F.col("verdict")).when(F.coalesce(F.trim("answer_key"), F.lit("")) == "", "no_key").when(F.size(missing_source(F.col("question"), F.col("source"))) > 0, "missing_source").otherwise("keep")
    return staged.join(seen, "id", "left").withColumn("reason", F.coalesce("reason", late)).drop("verdict", "print")
