"""Distributed running sums and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Exclusive running sum of ``value`` along the integer column ``order`` within ``keys``.

    Two levels, so that no key has to fit in one task: rows are summed inside blocks
    of ``block`` consecutive order values, and only the block totals (one row per
    block) go through a window over the whole key.
    """
    tagged = df.withColumn("_b", F.floor(F.col(order) / block))
    totals = tagged.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tagged.withColumn("_s", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets.hint("merge"), [*keys, "_b"]).withColumn(out, F.col("_o") + F.col("_s")).drop("_b", "_o", "_s")


def checkpointed(df: DataFrame, compact: bool = False) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder and read it back.

    Survives lost executors and cuts the lineage.  Spark takes the size of the files for that of the rows when it chooses
    what to broadcast, and the coordinates of regular meshes shrink to a hundredth in a file: values are written plain, so a table
    is broadcast in later joins only if its rows are small.  ``compact`` compresses, for tables whose files matter more.  The
    folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session
    without one gets a temporary folder.  Tables stay until :func:`release` or the end of a :func:`scratch` block.
    """
    path = f"{shared_folder(df.sparkSession)}/quadfield-{uuid.uuid4().hex}"
    _tables(df.sparkSession).append(path)  # noted first: a write that fails leaves files too
    plain = {} if compact else {"compression": "none", "parquet.enable.dictionary": "false"}
    df.write.options(**plain).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: dict[str, list[str]] = {}


def _tables(spark: SparkSession) -> list[str]:
    """Intermediate tables of the application that are still there, oldest first."""
    return _TABLES.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, after: int = 0) -> int:
    """Removes the intermediate tables written since there were ``after`` of them; returns how many.

    Call it when the results that read them have been written or collected: a DataFrame built on a removed table can't run again.
    """
    held, removed = _tables(spark), 0
    while len(held) > after:
        path = held.pop()
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
        removed += 1
    return removed


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables made inside the block are removed at its end, also after an error; blocks may be nested.

    Write or collect what is wanted of them before the block ends::

        with scratch(spark):
            detect_boundaries(mesh).write.parquet(path)
    """
    before = len(_tables(spark))
    try:
        yield
    finally:
        release(spark, before)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
