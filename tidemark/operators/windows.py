"""Operators that depend on an order, which is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.session import written


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds the rank (from 1) of each row within its key, by columns in ascending, total order.

    Rows are dealt by ranges of key and order, so a key with a third of all rows lies in many parts: a rank is the rank within the part
    and what the key has in the parts before, of which there is one row for each key and part.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_key", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    placed = dealt.withColumn("_own", own).join(before, (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
    return placed.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def unique_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The k-th repeat of an id gets the suffix -dup(k-1)."""
    return ranked(df, id_col, order, "_k").withColumn("unique_id", F.when(F.col("_k") > 1, F.concat(F.col(id_col), F.lit("-dup"), (F.col("_k") - 1).cast("string"))).otherwise(F.col(id_col))).drop("_k")


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row of each key that comes first in a descending, total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def leaderboard(log: DataFrame) -> DataFrame:
    """run, at, delta, position: the latest row of each run, by delta descending (null last), the base first on ties, then time.

    log: run, at, pos, delta, is_base.
    """
    last = latest_per(log, ["run"], [F.desc("at"), F.desc("pos")])
    w = Window.partitionBy().orderBy(F.desc_nulls_last("delta"), F.desc("is_base"), "at", "run")
    return last.select("run", "at", "delta", F.row_number().over(w).alias("position"))


def carry_forward(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Adds the last value that isn't null in an earlier row of the group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def shards(df: DataFrame, subject: str, order: list[str], size: int) -> DataFrame:
    """Adds shard (from 1) and its index (from 1) of fixed-size shards of each subject."""
    k = F.col("_k") - 1
    return ranked(df, subject, order, "_k").withColumns({"shard": (F.floor(k / size) + 1).cast("int"), "index": (F.pmod(k, F.lit(size)) + 1).cast("int")}).drop("_k")


def first_seen(df: DataFrame, key: str, order: list[str], mark: str) -> DataFrame:
    """Adds `verdict`: keep for the first row of a key, else duplicate_of_ and the first row's mark.

    The first rows are an aggregate that each task prepares, joined back by key; so no task gets all rows of a key. order: columns, ascending
    and total.
    """
    at = F.struct(*order)
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(at.alias("at"), F.col(mark).alias("mark"))).alias("_first"))
    both = df.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return both.select(*df.columns, F.when(at.eqNullSafe(F.col("_first.at")), "keep").otherwise(F.concat(F.lit("duplicate_of_"), F.col("_first.mark"))).alias("verdict"))


def next_free_ids(df: DataFrame, group: str, order: list, wanted: Column, taken: DataFrame | None = None) -> DataFrame:
    """Adds `number`: the wanted number for its first claimant, else the next one of the group that nobody holds.

    `taken` (group, number) are held beforehand. The k-th row without a number gets the k-th free one: k and as many as are held below
    it, which a running count over rows and held numbers tells.
    """
    claims = df.withColumn("_want", wanted)
    held = taken.select(F.col(group), F.col("number").alias("_want"), F.lit(True).alias("_held")) if taken is not None else df.select(group).limit(0).withColumns({"_want": F.lit(0), "_held": F.lit(True)})
    claims = claims.join(held, [group, "_want"], "left")
    first = F.row_number().over(Window.partitionBy(group, "_want").orderBy(*order)) == 1
    claims = claims.withColumn("_own", F.when(first & F.col("_want").isNotNull() & F.col("_held").isNull(), F.col("_want")))
    used = claims.where(F.col("_own").isNotNull()).select(group, F.col("_own").alias("_n")).unionByName(held.select(group, F.col("_want").alias("_n"))).distinct()
    # the k-th free number: k plus the held ones that lie below it
    w = Window.partitionBy(group).orderBy("_n")
    gaps = used.withColumn("_free_below", F.col("_n") - F.row_number().over(w))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    keep = [c for c in df.columns]
    open_ = claims.where(F.col("_own").isNull()).select(F.col(group).alias("_group"), F.struct(*keep).alias("_row"), rank.cast("long").alias("_at"), F.lit(0).alias("_held"))
    steps = gaps.select(F.col(group).alias("_group"), F.lit(None).cast(open_.schema["_row"].dataType).alias("_row"), F.col("_free_below").cast("long").alias("_at"), F.lit(1).alias("_held"))
    below = F.sum("_held").over(Window.partitionBy("_group").orderBy("_at", "_held").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = open_.unionByName(steps).withColumn("number", F.col("_at") + below).where("_held = 0").select("_row.*", "number")
    return claims.where(F.col("_own").isNotNull()).select(*keep, F.col("_own").cast("int").alias("number")).unionByName(placed.select(*keep, F.col("number").cast("int").alias("number")))


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done, by keys that may be null."""
    d = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wanted.join(d, on, "left_anti")
