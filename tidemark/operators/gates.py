"""Promotion rules over a comparison, and the log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack in comparisons of bounds.
SLACK = 1e-9
#: Fixed values of the rules: rule, measure, sense, bound, and whether a missing measure fails or skips it.
RULES = [
    ("1", "delta", ">=", 2.0, "fail"),
    ("2", "parse_fail_delta", "<=", 0.0, "fail"),
    ("3", "general_nll_ratio", "<=", 1.05, "fail"),
    ("4", "variant_delta", ">=", -1.0, "skip"),
    ("5", "secondary_delta", ">=", -1.0, "skip"),
    ("6", "net_wins", ">=", 0.0, "fail"),
    ("7", "loglik_delta", ">=", -3.0, "skip"),
    ("8", "lenient_delta", ">=", 0.0, "fail"),
    ("9", "letter_accuracy_delta", ">=", -3.0, "skip"),
]


def evaluate(measures: DataFrame, rules: list = RULES) -> DataFrame:
    """run, rule, subject, value, bound, ok of measures (run, measure, subject, value), one row for each rule and subject.

    A rule whose measure a run lacks fails or is left out, as the rule says.
    """
    spark = measures.sparkSession
    table = F.broadcast(spark.createDataFrame([(r, m, s, float(b), x == "fail") for r, m, s, b, x in rules], "rule string, measure string, sense string, bound double, required boolean"))
    every = measures.select("run").distinct().crossJoin(table)  # a fixed number of rules for each run
    found = every.join(measures, ["run", "measure"], "left").where(F.col("value").isNotNull() | F.col("required"))
    return found.select("run", "rule", F.coalesce("subject", F.lit("")).alias("subject"), "value", "bound", holds(F.col("value"), F.col("sense"), F.col("bound")).alias("ok"))


def holds(value: Column, sense: Column, bound: Column) -> Column:
    """Whether a value keeps to a bound; a missing one doesn't."""
    return F.coalesce(F.when(sense == ">=", value >= bound - SLACK).otherwise(value <= bound + SLACK), F.lit(False))


def verdicts(evaluated: DataFrame) -> DataFrame:
    """run, passed, failed: the rules that failed, in order."""
    return evaluated.groupBy("run").agg(F.bool_and("ok").alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("rule")))), ",").alias("failed"))


def scope_gaps(covered: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """What is required and not covered."""
    return required.select(*keys).distinct().join(covered.select(*keys).distinct(), keys, "left_anti")


def kept_files(recorded: DataFrame, protected: DataFrame) -> DataFrame:
    """Recorded paths that nothing protects: those that may go."""
    return recorded.select("path").distinct().join(protected.select("path").distinct(), "path", "left_anti")
