"""The log of runs and the candidate it names: rows are only added, and the state is a view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import gates

#: What a run must be better by than the candidate.
BEAT = 1.0
SCHEMA = "event string, run string, at string, pos long, delta double, passed boolean, failed string, promoted boolean, reason string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; none if there is no log yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def candidate(log: DataFrame) -> DataFrame:
    """The row that was promoted last, or none."""
    return log.where("promoted").orderBy(F.desc("at"), F.desc("pos")).limit(1)


def record_run(spark: SparkSession, path: str, run: str, at: str, measures: DataFrame) -> dict:
    """Judge a run by the rules and against the candidate, add its row to the log, and return it.

    measures: run, measure, subject, value. It is promoted if no rule fails and its delta beats the candidate's by BEAT.
    """
    log = read_log(spark, path)
    own = measures.where(F.col("run") == run)
    verdict = gates.verdicts(gates.evaluate(own)).first()
    delta = own.where("measure = 'delta'").agg(F.max("value")).first()[0]
    best = candidate(log).first()
    beats = best is None or best["delta"] is None or (delta is not None and delta >= best["delta"] + BEAT - gates.SLACK)
    passed = bool(verdict and verdict["passed"])
    row = {"event": "run", "run": run, "at": at, "pos": log.count(), "delta": delta, "passed": passed, "failed": verdict["failed"] if verdict else "", "promoted": passed and beats, "reason": "" if beats else "does not beat the candidate"}
    spark.createDataFrame([tuple(row.values())], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return row


def promote(spark: SparkSession, path: str, run: str, at: str, reason: str, force: bool = False) -> dict:
    """Make a recorded run the candidate by hand; a reason is needed, and force where a rule failed."""
    log = read_log(spark, path)
    last = log.where((F.col("event") == "run") & (F.col("run") == run)).orderBy(F.desc("at"), F.desc("pos")).first()
    if not reason.strip():
        raise ValueError("a reason is needed")
    if last is None:
        raise ValueError(f"{run} isn't in the log")
    if not last["passed"] and not force:
        raise ValueError(f"{run} failed rules {last['failed']}")
    row = {"event": "manual_promote", "run": run, "at": at, "pos": log.count(), "delta": last["delta"], "passed": last["passed"], "failed": last["failed"], "promoted": True, "reason": reason}
    spark.createDataFrame([tuple(row.values())], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return row


def grid(settings: dict[str, list]) -> list[dict]:
    """Every combination of settings, the last one changing fastest; values that repeat are an error."""
    out: list[dict] = [{}]
    for name, values in settings.items():
        if len(set(map(repr, values))) < len(values):
            raise ValueError(f"{name} repeats a value")
        out = [{**x, name: v} for x in out for v in values]
    return out


def ranked(runs: DataFrame, log: DataFrame) -> DataFrame:
    """run, delta, place of planned runs (run, pos) by their latest delta, those without one last, in the planned order on ties."""
    latest = log.where("event = 'run'").withColumn("_k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at"), F.desc("pos")))).where("_k = 1").select("run", "delta")
    w = Window.partitionBy().orderBy(F.desc_nulls_last("delta"), "pos")
    return runs.join(latest, "run", "left").select("run", "delta", F.row_number().over(w).alias("place"))
