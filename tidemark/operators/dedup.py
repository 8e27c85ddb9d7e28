"""The near-duplicate rule of a dataset: what is compared, protected sets in order, then the dataset's own repeats, the first one staying.

Three methods tell that a candidate repeats a protected row: the cosine of question and answer, the cosine of the question, and the
token-set ratio of the question. Embeddings come in as columns. Null texts are empty; rows without an answer are not compared with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normal_text
from tidemark.operators import joins, near
from tidemark.operators.validate import TYPES
from tidemark.plans.session import written

#: Cosine of question and answer, of the question, within the dataset; token-set ratio.
QA, QUESTION, WITHIN, FUZZY = 0.80, 0.90, 0.95, 92.0
#: The sentences of an exam that say how to answer, not what is asked.
INSTRUCTIONS = [
    r"Dokończ\s+zdani[ea]\s*[.:]?",
    r"(?:Wybierz|Zaznacz|Wskaż|Podkreśl)\s+(?:(?:właściwą|poprawną|prawidłową)\s+odpowiedź|(?:dwie|trzy)\s+(?:(?:właściwe|poprawne|prawidłowe)\s+)?odpowiedzi)(?:\s+spośród\s+podanych)?(?:\s*\([^)]*\))?\s*[.:]?",
    r"Oceń\s+prawdziwość\s+(?:podanych\s+)?(?:stwierdzeń|informacji|zdań)[^.]*\.(?:\s*Zaznacz\s+P[^.]*\.)?",
]
#: How options A and B begin within a line.
OPTION = r"(?:^|(?<=\s))\(?{}[.)](?=\s)"


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_inline_options(question: Column) -> Column:
    """The question before a list of options in its line, which begins at an A that a B follows; all of it if nothing stands before."""
    q = F.regexp_replace(_blank(question), r"^\s+|\s+$", "")
    before = F.regexp_replace(q, rf"(?s){OPTION.format('A')}(?=.*\s\(?B[.)]\s).*$", "")
    stem = F.regexp_replace(F.regexp_replace(before, r"\s*:\s*$", ""), r"\s+$", "")
    return F.when(stem == "", q).otherwise(stem)


def strip_instructions(text: Column) -> Column:
    """Without the sentences that say how to answer, wherever they stand; as it was if nothing else is left."""
    rest = normal_text(F.regexp_replace(_blank(text), "(?iu)" + "|".join(INSTRUCTIONS), " "))
    return F.when(rest == "", normal_text(text)).otherwise(rest)


def is_schema_item(kind: Column, answer: Column) -> Column:
    return F.coalesce(kind.isin(TYPES), F.lit(False)) & answer.isNotNull()


def stem_text(kind: Column, answer: Column, question: Column, statements: Column, left: Column) -> Column:
    """What is compared of an item's question: with its statements or left elements, without instructions; of other rows without listed options."""
    parts = F.when(kind == "tf", F.coalesce(statements, F.array().cast("array<string>"))).when(kind == "match", F.coalesce(left, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(_blank(question)), parts), "\n")
    return strip_instructions(F.when(is_schema_item(kind, answer), whole).otherwise(strip_inline_options(question)))


def qa_text(stem: Column, answer: Column) -> Column:
    return F.concat(stem, F.lit("\nOdpowiedź: "), answer)


def protected_hits(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """id, set_name, methods, match_id: candidates that a protected set repeats, by the first set (by rank) in which a method fires.

    candidates: id, q, qa (vectors), fuzzy (normal text); protected: the same with set_name and set_rank, qa null without an answer.
    """
    out = candidates.select("id", F.lit(0).alias("set_rank"), F.lit("").alias("set_name"), F.array().cast("array<string>").alias("methods"), F.col("id").alias("match_id")).limit(0)
    for r in protected.select("set_rank", "set_name").distinct().orderBy("set_rank").collect():  # a handful of sets
        own = protected.where(F.col("set_rank") == r.set_rank)
        vector = lambda df, c: df.where(F.col(c).isNotNull()).select("id", F.col(c).alias("vector"))
        tested = candidates.select("id")
        for method, least in (("qa", QA), ("q", QUESTION)):
            best = near.cosine_top1(vector(candidates, method), vector(own, method)).where(F.col("cosine") >= least)
            tested = tested.join(best.select("id", F.col("match_id").alias(method)), "id", "left")
        best = near.fuzzy_best(candidates.select("id", F.col("fuzzy").alias("text")), own.select("id", F.col("fuzzy").alias("text")), cutoff=FUZZY).where("match_id is not null")
        tested = tested.join(best.select("id", F.col("match_id").alias("fuzzy")), "id", "left")
        methods = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), m) for m in ("qa", "q", "fuzzy")]))
        hit = tested.select("id", F.lit(r.set_rank).alias("set_rank"), F.lit(r.set_name).alias("set_name"), methods.alias("methods"), F.coalesce("qa", "q", "fuzzy").alias("match_id")).where(F.size("methods") > 0)
        out = out.unionByName(hit)
    return joins.first_per(out, ["id"], ["set_rank"]).drop("set_rank")


def deduplicated(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """id, reason, methods, match_id for every candidate: dup_vs_ and the set's name, dup_intra, or keep.

    candidates: id, pos and the columns of `protected_hits`. Of those that no protected set repeats, one that repeats an earlier kept one goes.
    """
    hits = written(protected_hits(candidates, protected), "hits")
    left = written(candidates.join(hits, "id", "left_anti").select("id", "pos", "qa", F.xxhash64("qa").alias("h")), "left")
    # of equal vectors the first stands for all: what it repeats the others repeat, too
    first = left.where(F.col("qa").isNotNull()).groupBy("h", "qa").agg(F.min(F.struct("pos", "id")).alias("_f")).select("h", "qa", F.col("_f.pos").alias("pos"), F.col("_f.id").alias("first"))
    pairs = near.cosine_pairs(first.select(F.col("first").alias("id"), F.col("qa").alias("vector")), WITHIN).select("a", "b")
    own = written(near.greedy_keep_first(first.select(F.col("first").alias("id"), "pos"), pairs), "own")
    copies = left.join(first.select("h", "qa", "first"), ["h", "qa"]).join(own.select(F.col("id").alias("first"), "kept", F.col("match_id").alias("_m")), "first")
    again = copies.where("not kept or id <> first").select("id", F.lit("dup_intra").alias("reason"), F.array(F.lit("qa")).alias("methods"), F.coalesce("_m", "first").alias("match_id"))
    found = hits.select("id", F.concat(F.lit("dup_vs_"), "set_name").alias("reason"), "methods", "match_id").unionByName(again)
    return candidates.select("id").join(found, "id", "left").select("id", F.coalesce("reason", F.lit("keep")).alias("reason"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"), "match_id")


def first_by_any(rows: DataFrame, pos: str, keys: list[str]) -> DataFrame:
    """The rows that share none of their keys with an earlier row that stays; pos: a total order.

    In each round a row stays if it is the first of each of its keys, and what shares a key with it goes. The first row of all that are left
    stays in every round; rounds are written tables.
    """
    open_, kept = written(rows.select(pos, *keys), "open"), None
    while open_.limit(1).count():
        ranked = open_
        for k in keys:
            first = open_.groupBy(F.col(k).alias("_key")).agg(F.min(pos).alias(f"_{k}"))
            ranked = ranked.join(first, F.col(k).eqNullSafe(F.col("_key"))).drop("_key")
        stays = written(ranked.where(" and ".join(f"{pos} = _{k}" for k in keys)).select(pos, *keys), "stays")
        kept = stays if kept is None else kept.unionByName(stays)
        for k in keys:
            open_ = open_.join(stays.select(F.col(k).alias("_key")).distinct(), F.col(k).eqNullSafe(F.col("_key")), "left_anti")
        open_ = written(open_, "open")
    return rows if kept is None else rows.join(kept.select(pos), pos, "left_semi")
