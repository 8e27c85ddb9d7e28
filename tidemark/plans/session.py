"""Getting the package to the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: The setting for rows in an Arrow batch, Spark's own value, and what is set in its place.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship_package(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once for each application; and while the session has Spark's own number of rows in an
    Arrow batch, take fewer: rows hold whole texts, and every Python worker and its JVM side hold a few batches each."""
    if spark.conf.get(ARROW_ROWS[0]) == ARROW_ROWS[1]:
        spark.conf.set(ARROW_ROWS[0], ARROW_ROWS[2])
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`; set only where unset, and then only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def for_this_run(spark: SparkSession, path: str, make: bool = False) -> str:
    """The path, of which whatever stands there goes when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        system.mkdirs(p)
    system.deleteOnExit(p)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for this run."""
    return for_this_run(spark, f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}", make=True)


def written(df, name: str):
    """`df` written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for_this_run(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
