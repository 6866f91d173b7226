"""What several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two collections of the driver's dropped plans, and when the last was.
BETWEEN = 2
_collected = [0.0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary folder stands in for it on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir, so later stages reread it rather than compute it again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint(eager=True)
    # The driver drops shuffle files when it collects the plans that made them; without this they'd stay for a long query's
    # whole run. Quick steps leave little behind, so they don't pay for a collection each.
    if time.monotonic() - _collected[0] > BETWEEN:
        released(spark)
    return kept


def released(spark: SparkSession) -> None:
    """Lets the driver give up what earlier plans left in it, in Python and in the JVM."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _collected[0] = time.monotonic()


def slices(sizes, limit: int):
    """(start, end) ranges of consecutive rows whose sizes sum to about ``limit``; a larger row stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
