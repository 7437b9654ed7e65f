"""Shared helpers: table readers, staged tables in the shared folder, running totals over split groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadfield.operators.scans import checkpointed

#: Runs of ASCII white space, in the syntax of Java, RE2 and Python alike.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def staged(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    return checkpointed(df, compact=True)


def row_key(df: DataFrame, text: str = "text") -> Column:
    """A second key beside ``doc_id`` that tells rows with the same ``doc_id`` and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def totals_before(df: DataFrame, group: list[str], part: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the group that come before.

    Rows of a group are ordered by (``part``, ``order``).  ``part`` is a coarse ordered key with a bounded number of values
    (some thousands); a group of any size is so spread over tasks: totals by (group, part) are aggregated on the map side,
    summed over the parts, and added to a running sum that sees one part only.
    """
    keys = [*group, part]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    match = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        match = c if match is None else match & c
    return (
        df.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(sums, match)
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__before", "__inside", *[f"__{k}" for k in keys])
    )
