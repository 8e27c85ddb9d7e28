"""Aggregates and statistics over graded records and distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import percent

#: Draws of a bootstrap, and how many are made at a time.
DRAWS, DRAWS_AT_ONCE = 10_000, 1000


def summarize(records: DataFrame) -> DataFrame:
    """Totals, and the same by subject and by type, in one pass (grouping sets).

    records: subject, type, points, max_points, points_lenient, parse_ok. Returns level, subject, type, n, points, max_points,
    parse_fail, points_lenient, score_pct (2 digits), parse_fail_rate (4), format_loss.
    """
    records.createOrReplaceTempView("_tidemark_records")
    grouped = records.sparkSession.sql(
        """
        SELECT CASE grouping_id(subject, type) WHEN 3 THEN 'total' WHEN 1 THEN 'subject' ELSE 'type' END AS level, subject, type, count(*) AS n,
               sum(points) AS points, sum(max_points) AS max_points, sum(CASE WHEN parse_ok THEN 0 ELSE 1 END) AS parse_fail, sum(points_lenient) AS points_lenient
        FROM _tidemark_records GROUP BY GROUPING SETS ((), (subject), (type))
        """
    )
    return grouped.withColumns(
        {
            "score_pct": percent(F.col("points"), F.col("max_points")),
            "parse_fail_rate": F.round(F.col("parse_fail") / F.col("n"), 4),
            "format_loss": F.round(F.col("points_lenient") - F.col("points"), 4),
        }
    )


def fail_reasons(records: DataFrame) -> DataFrame:
    """reason, n of the rows that failed, most frequent first."""
    return records.where(~F.col("parse_ok")).groupBy(F.col("parse_reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def accuracy(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, accuracy (4 digits) of a boolean column `correct`."""
    return records.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test, 1 without any win or loss.

    The tail sum of binomial probabilities, each got from the one before by a ratio, so nothing overflows before some 1000 trials;
    beyond, use `sign_test_exact`.
    """
    n, k = wins + losses, F.least(wins, losses).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("p"), F.pow(F.lit(0.5), n).alias("total"))
    step = lambda s, i: F.struct((s["p"] * (n - i + 1) / i).alias("p"), (s["total"] + s["p"] * (n - i + 1) / i).alias("total"))
    tail = F.when(k >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step)["total"]).otherwise(F.pow(F.lit(0.5), n))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


@F.pandas_udf(T.DoubleType())
def sign_test_exact(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """The same with whole numbers of any size."""

    def one(w: int, v: int) -> float:
        n, k = w + v, min(w, v)
        if n == 0:
            return 1.0
        total, c = 0, 1
        for i in range(k + 1):
            total += c
            c = c * (n - i) // (i + 1)
        return min(1.0, 2 * total / (1 << n)) if n < 1000 else min(1.0, math.exp(math.log(2 * total) - n * math.log(2)))

    return pd.Series([one(int(w), int(v)) for w, v in zip(wins, losses, strict=True)])


def bootstrap_ci(pairs: DataFrame, keys: list[str], draws: int = DRAWS, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """keys, n, delta, low, high: percentile bootstrap of the total difference run - base over paired items (keys, base, run).

    An item's difference matters only by its value, so a group is counted by differences first and resampled as a
    multinomial draw over them: what reaches one task is the number of different differences, not of items.
    """
    counted = pairs.groupBy(*keys, (F.col("run") - F.col("base")).alias("d")).agg(F.count("*").alias("c"))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, c = pdf["d"].to_numpy(float), pdf["c"].to_numpy(np.int64)
        r, n = np.random.default_rng(seed), int(c.sum())
        totals = np.concatenate([r.multinomial(n, c / n, min(DRAWS_AT_ONCE, draws - a)) @ d for a in range(0, draws, DRAWS_AT_ONCE)])
        low, high = np.quantile(totals, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*pdf[keys].iloc[0].tolist(), n, float(c @ d), float(low), float(high)]], columns=[*keys, "n", "delta", "low", "high"])

    ddl = ", ".join([*(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys), "n long, delta double, low double, high double"])
    return counted.groupBy(*keys).applyInPandas(resample, ddl)


def judge_pivot(scores: DataFrame, labels: list) -> DataFrame:
    """id, one column of points for each label (0 where missing) and the total; scores: id, label, points."""
    wide = scores.groupBy("id").pivot("label", labels).agg(F.sum("points"))
    wide = wide.fillna(0, [str(x) for x in labels])
    return wide.withColumn("total", sum((F.col(f"`{x}`") for x in labels), F.lit(0)))


def letter_protocol(scores: DataFrame) -> DataFrame:
    """id, letter, probability, letter_mass: softmax over an item's letters, the first letter on ties.

    scores: id, letter, logit, and all_mass, the log of the sum over the whole vocabulary, where it is known.
    """
    w = Window.partitionBy("id")
    top = F.max("logit").over(w)
    e = F.exp(F.col("logit") - top)
    p = scores.withColumns({"_p": e / F.sum(e).over(w), "_mass": F.exp(top + F.log(F.sum(e).over(w)) - F.col("all_mass"))})
    first = Window.partitionBy("id").orderBy(F.desc("logit"), "letter")
    return p.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("id", "letter", F.col("_p").alias("probability"), F.col("_mass").alias("letter_mass"))


def token_weighted_mean(rows: DataFrame, keys: list[str], total: str, n: str) -> DataFrame:
    """keys, n_tokens, mean: the mean per token of sums over tokens; null without tokens."""
    g = rows.groupBy(*keys).agg(F.sum(n).alias("n_tokens"), F.sum(total).alias("_t"))
    return g.withColumn("mean", F.when(F.col("n_tokens") > 0, F.col("_t") / F.col("n_tokens"))).drop("_t")


def majority_vote(votes: DataFrame) -> DataFrame:
    """item, unit, value, n_votes: most votes; on ties the greedy value, else the first seen. votes: item, unit, value, pos, greedy."""
    g = votes.where(F.col("value").isNotNull()).groupBy("item", "unit", "value")
    g = g.agg(F.count("*").alias("n_votes"), F.max(F.col("greedy").cast("int")).alias("_g"), F.min("pos").alias("_first"))
    w = Window.partitionBy("item", "unit").orderBy(F.desc("n_votes"), F.desc("_g"), "_first", "value")
    return g.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("item", "unit", "value", "n_votes")


def vote_decided(votes: DataFrame, remaining: int) -> DataFrame:
    """item, unit, decided: whether the remaining votes can't change the winner, nor make a tie."""
    g = votes.where(F.col("value").isNotNull()).groupBy("item", "unit", "value").agg(F.count("*").alias("_n"))
    two = g.groupBy("item", "unit").agg(F.slice(F.sort_array(F.collect_list("_n"), asc=False), 1, 2).alias("_top"))
    lead = F.col("_top")[0] - F.coalesce(F.try_element_at("_top", F.lit(2)), F.lit(0))
    return two.select("item", "unit", (lead > remaining).alias("decided"))


def composition(rows: DataFrame, most_tokens: int) -> DataFrame:
    """kind, kept, dropped, tokens, token_share of rows (kind, n_tokens, n_completion) that fit a length."""
    fits = F.col("n_tokens") <= most_tokens
    g = rows.groupBy("kind").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"), F.coalesce(F.sum(F.when(fits, F.col("n_completion"))), F.lit(0)).alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy())
    return g.withColumn("token_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, low, median, high, the median being the element n/2 (from 0) in order."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))  # equal values count once
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("_c").over(Window.partitionBy(*keys))
    at = counted.withColumns({"_upto": F.sum("_c").over(w), "_n": n})
    return at.groupBy(*keys).agg(F.max("_n").alias("n"), F.min(value).alias("low"), F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col(value))).alias("median"), F.max(value).alias("high"))


def histogram(df: DataFrame, column: str, values: list) -> DataFrame:
    """value, n for every listed value, 0 where there is none."""
    all_ = df.sparkSession.createDataFrame([(v,) for v in values], f"value {df.schema[column].dataType.simpleString()}")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
    return F.broadcast(all_).join(counts, "value", "left").select("value", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def group_ratio(rows: DataFrame, key: str, hits: Column, all_: Column, least: int) -> DataFrame:
    """key, n_all, n_hits, ratio (6 digits) of groups with `least` or more in all."""
    g = rows.groupBy(key).agg(F.sum(all_).cast("long").alias("n_all"), F.sum(hits).cast("long").alias("n_hits"))
    return g.where(F.col("n_all") >= least).withColumn("ratio", F.round(F.col("n_hits") / F.col("n_all"), 6))
