"""Quotas, splits, seeded samples and mixes. Random choices are orders by a hash of seed and id, so they are the same anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, id_col: Column) -> Column:
    """SHA-256 of "seed:id", by which samples are ordered."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256)


def uniform(seed: str, id_col: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the hash."""
    return F.conv(F.substring(hash_order(seed, id_col), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def largest_remainder(weights: DataFrame, key: str, weight: str, n: int | Column) -> DataFrame:
    """key, quota: n things shared in proportion; what rounding down leaves goes to the largest remainders, then by key."""
    all_ = Window.partitionBy()
    exact = (F.lit(n) if isinstance(n, int) else n) * F.col(weight) / F.sum(weight).over(all_)
    floors = weights.withColumn("_exact", exact).withColumns({"_floor": F.floor("_exact"), "_rest": F.round(F.col("_exact") - F.floor("_exact"), 9)})
    left = (F.lit(n) if isinstance(n, int) else n) - F.sum("_floor").over(all_)
    rank = F.row_number().over(all_.orderBy(F.desc("_rest"), key))
    return floors.withColumns({"_left": left, "_rank": rank}).select(key, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


def _lowest(df: DataFrame, id_col: str, seed: str, wanted) -> DataFrame:
    """Ids of the rows with the lowest hashes, as many as wanted(number of rows) says.

    The cut is found on hashes alone, by a ranked window over their first hexadecimal digits' counts, so no task sorts all rows.
    """
    h = df.select(id_col, hash_order(seed, F.col(id_col)).alias("_h"))
    counts = h.groupBy(F.substring("_h", 1, 3).alias("_bin")).agg(F.count("*").alias("_c"))  # 4096 bins
    w = Window.partitionBy().orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(w), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy())})
    ranked = h.withColumn("_bin", F.substring("_h", 1, 3)).join(F.broadcast(before), "_bin")
    k = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", id_col)) + F.col("_before")
    return ranked.withColumn("_k", k).where(F.col("_k") <= wanted(F.col("_n")))


def select_fraction(df: DataFrame, id_col: str, fraction: float, seed: str) -> DataFrame:
    """Exactly round(fraction * n) ids, half to even: those with the lowest hashes."""
    return _lowest(df, id_col, seed, lambda n: F.bround(F.lit(fraction) * n)).select(id_col)


def sample_n(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """The n rows with the lowest hashes; ids are unique."""
    return df.join(_lowest(df, id_col, seed, lambda _: F.lit(n)).select(id_col), id_col, "left_semi")


def weighted_choice(df: DataFrame, id_col: str, weights: list[tuple[str, float]], seed: str) -> DataFrame:
    """Adds `variant`, chosen by a hash in proportion to the weights."""
    u, total, upto, choice = uniform(seed, F.col(id_col)), sum(w for _, w in weights), 0.0, None
    for name, w in weights[:-1]:
        upto += w / total
        choice = F.when(u < upto, name) if choice is None else choice.when(u < upto, name)
    return df.withColumn("variant", F.lit(weights[0][0]) if choice is None else choice.otherwise(weights[-1][0]))


def group_split(df: DataFrame, subject: str, group: str, fraction: float, seed: str) -> DataFrame:
    """subject, group, n, split: whole groups go to `val` in hash order while what went before is below the subject's quota.

    Quotas are round(fraction * rows) of each subject, half to even, one row less than all at most; the last group of a subject stays in `train`.
    """
    g = df.groupBy(subject, group).agg(F.count("*").alias("n"))
    order = Window.partitionBy(subject).orderBy(hash_order(seed, F.col(group)), group)
    all_ = Window.partitionBy(subject)
    g = g.withColumns({"_quota": F.least(F.bround(F.lit(fraction) * F.sum("n").over(all_)), F.sum("n").over(all_) - 1), "_before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_k": F.row_number().over(order), "_groups": F.count("*").over(all_)})
    return g.withColumn("split", F.when((F.col("_before") < F.col("_quota")) & (F.col("_k") < F.col("_groups")), "val").otherwise("train")).select(subject, group, "n", "split")


def general_count(n_rows: Column, ratio: float) -> Column:
    """How many general rows make up a share of the mix: n * ratio / (1 - ratio), half to even."""
    return F.bround(n_rows * F.lit(ratio / (1 - ratio))).cast("long")


def mix(core: DataFrame, general: DataFrame, ratio: float, seed: str) -> DataFrame:
    """id, kind: all core rows, and as many general ones, by hash, as the ratio asks for; in hash order."""
    n = core.count()
    from decimal import ROUND_HALF_EVEN, Decimal

    want = int(Decimal(n * ratio / (1 - ratio)).to_integral_value(ROUND_HALF_EVEN))
    chosen = sample_n(general.select("id"), "id", want, seed)
    both = core.select("id", F.lit("core").alias("kind")).unionByName(chosen.select("id", F.lit("general").alias("kind")))
    return both.orderBy(hash_order(seed, F.concat_ws("/", "kind", F.col("id").cast("string"))), "kind", "id")


def splits_by_length(df: DataFrame, split: str, n_tokens: str, most: int) -> DataFrame:
    """split, kept, dropped: rows that fit the length and rows that don't."""
    fits = F.col(n_tokens) <= most
    return df.groupBy(split).agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))
