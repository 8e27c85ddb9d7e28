"""An extension: the latest row of each key over a growing folder of files, as a stream.

The batch operators need no stream; this keeps a log's latest-per-key view up to date as files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(log: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The columns of each key's latest row, by time and then by all columns, as an updating aggregate: state is one row for each key."""
    best = log.groupBy(*keys).agg(F.max(F.struct(at, *columns)).alias("_best"))
    return best.select(*keys, f"_best.{at}", *[f"_best.{c}" for c in columns])


def windowed_counts(log: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window of event time; rows later than `late` don't count."""
    return log.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), *keys, "n")
