"""Validation as expressions: each gives the first error's name, or null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.functions.repeats import many_equal_lines, repeats

#: The kinds of items.
TYPES = ["mc", "multi", "tf", "match", "short", "numeric"]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def answer_list() -> Column:
    """The answer, when it is a JSON array, as an array of text."""
    return F.when(F.col("answer").startswith("["), F.from_json(F.col("answer"), "array<string>"))


def answer_map() -> Column:
    """The answer, when it is a JSON object, as a map."""
    return F.when(F.col("answer").startswith("{"), F.from_json(F.col("answer"), "map<string,string>"))


def item_error() -> Column:
    """The first rule that an item breaks, in a fixed order; null for a valid item."""
    kind, options, listed, mapped = F.col("type"), F.map_keys(F.col("options")), answer_list(), answer_map()
    n_options = F.coalesce(F.size(options), F.lit(0))
    is_ = lambda k: kind == k
    none = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(_blank("id"), "no_id")
        .when(_blank("subject"), "no_subject")
        .when(~F.coalesce(kind.isin(TYPES), F.lit(False)), "bad_type")
        .when(_blank("question"), "no_question")
        .when(F.coalesce(F.col("points"), F.lit(1)) < 1, "bad_points")
        .when(F.col("answer").isNull(), "no_answer")
        .when(kind.isin("mc", "multi") & (n_options < 2), "few_options")
        .when(is_("mc") & ~none(F.array_contains(options, F.col("answer"))), "answer_not_an_option")
        .when(is_("multi") & (F.coalesce(F.size(listed), F.lit(0)) < 1), "answer_not_a_list")
        .when(is_("multi") & (F.size(F.array_distinct(listed)) < F.size(listed)), "answer_repeats")
        .when(is_("multi") & (F.size(F.array_except(listed, options)) > 0), "answer_not_an_option")
        .when(is_("tf") & (F.coalesce(F.size("statements"), F.lit(0)) < 1), "no_statements")
        .when(is_("tf") & ~none(F.size(listed) == F.size("statements")), "answer_of_other_length")
        .when(is_("tf") & ~none(F.forall(listed, lambda v: v.isin("true", "false", "P", "F"))), "bad_verdict")
        .when(is_("match") & ((F.coalesce(F.size("left"), F.lit(0)) < 1) | (F.coalesce(F.size(F.map_keys("right")), F.lit(0)) < 1)), "no_pairs")
        .when(is_("match") & ~none(F.size(F.map_keys(mapped)) == F.size("left")), "answer_of_other_length")
        .when(is_("match") & (F.size(F.array_except(F.map_values(mapped), F.map_keys("right"))) > 0), "answer_not_on_the_right")
        .when(is_("numeric") & F.col("answer").try_cast("double").isNull(), "answer_not_a_number")
        .when(is_("numeric") & none(F.col("tolerance") < 0), "bad_tolerance")
        .when(is_("short") & (F.trim("answer").isin("", "[]")), "no_answer")
    )


def n_parts() -> Column:
    """How many parts of an item are graded."""
    return F.when(F.col("type") == "tf", F.size("statements")).when(F.col("type") == "match", F.size("left")).when(F.col("type") == "multi", F.size(answer_list())).otherwise(F.lit(1))


def pair_ok(messages: Column, artifact: str = r"(?i)as an ai language model") -> Column:
    """Exactly a user's and an assistant's message, of sensible length, without a mark of generated text."""
    pair = (F.size(messages) == 2) & (F.get(messages, F.lit(0))["role"] == "user") & (F.get(messages, F.lit(1))["role"] == "assistant")
    user, answer = F.get(messages, F.lit(0))["text"], F.get(messages, F.lit(1))["text"]
    ok = pair & (F.trim(user) != "") & (F.length(user) <= 2000) & (F.length(answer) >= 20) & (F.length(answer) <= 2500) & ~answer.rlike(artifact)
    return F.coalesce(ok, F.lit(False))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, messages: array of (turn, role, text) in order of turns."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def last_user_text(messages: Column) -> Column:
    """The last user message's text; null without any."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.get(users, F.size(users) - 1)["text"]


@F.arrow_udf(BooleanType())
def _loops(text: pa.Array) -> pa.Array:
    # back-references try every length at every place, so this is done in Python, by distances
    found = np.zeros(len(text), bool)
    plain = [(i, x.decode("utf-8", "replace")) for i, x in enumerate(text.to_pylist()) if x is not None]
    for (i, x), again in zip(plain, repeats([x for _, x in plain]).tolist(), strict=True):
        found[i] = again or many_equal_lines(x)
    return pa.array(found, mask=text.is_null().to_numpy(zero_copy_only=False))


def loops(text: Column) -> Column:
    """Whether a phrase of 4 to 80 characters repeats six times in a row, with or without white space between, or a line of three characters
    or more stands four times at all."""
    return F.coalesce(_loops(text.cast("binary")), F.lit(False))


def table_like(text: Column, least: float = 0.5) -> Column:
    """Whether most lines have several cells."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    cells = F.filter(lines, lambda x: F.size(F.split(x, r"\s\|\s|\t|\s{3,}")) >= 3)
    return F.when(F.size(lines) > 0, F.size(cells) / F.size(lines) >= least).otherwise(F.lit(False))


def missing_labels(labels: Column, answer: Column) -> Column:
    """Labels such as `a)` that the answer doesn't hold at a word's beginning."""
    return F.filter(labels, lambda x: ~F.concat(F.lit(" "), F.regexp_replace(F.lower(answer), r"\s+", " ")).contains(F.concat(F.lit(" "), F.lower(x))))


def labels_in(text: Column) -> Column:
    """Distinct labels `a)`, `1.` at the beginnings of lines, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*([0-9]{1,2}\.|[A-Za-z]\))"), F.lit(1)))
