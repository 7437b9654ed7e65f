"""Exact deduplication through an extendible-hash index in shared files (DataFrame operations only).

* Key: the 64-bit XXH64 of the normalised text.  The directory addresses buckets by the first bits of the key.
* Texts meet by key and bytes in one aggregation: copies collapse on the map side already, so a text that makes up a third of
  all rows reaches its owner as one row per map task.  Two texts with one key stay apart, as a chain of that key.
* Directory doubling: a bucket over ``capacity`` entries is split by one more bit, up to ``max_depth`` bits.  The directory is
  derived from a histogram over at most ``2 ** max_depth`` prefixes, whatever the size of the corpus.
* The index (bucket, key, place in the chain, smallest doc_id, group size) is written by owner tasks that hold ranges of keys.
* Documents probe the index by key and digest; only entries with copies are needed for that.  Bucket, depth and chain lay out the
  stored index and take no part in the result: groups come from the aggregation.  A table of up to ``capacity`` distinct texts has
  one bucket.

Null texts count as empty; empty texts are equal.  Rows that share the smallest doc_id of a group (repeated rows) are all kept;
a null doc_id never stays in favour of another one, and stays when its group has no other.  Any other columns are ignored by the
index and passed through by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadfield.llm.common import SPACES, staged


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def prefix(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits)


def directory(entries: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(slot, depth, bucket): for each slot of the fully doubled directory the local depth of its bucket.

    The local depth is the smallest at which the bucket holds at most ``capacity`` entries; a bucket that is overfull at
    ``max_depth`` stays one bucket with an overflow chain.
    """
    hist = entries.groupBy(prefix(F.col("key"), max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    deep = hist.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    deep = deep.withColumn("head", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    full = deep.groupBy("depth", "head").agg(F.sum("n").alias("held"))
    fits = deep.join(full, ["depth", "head"]).filter((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    return (
        fits.groupBy("slot").agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)"))
    )


def build_index(docs: DataFrame, capacity: int = 1 << 18, max_depth: int = 12) -> DataFrame:
    """The staged index of all distinct texts: bucket, depth, key, chain, text_sha256, keep_id, group_size."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    entries = texts.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = staged(entries.select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    slots = directory(entries, capacity, max_depth)
    chained = Window.partitionBy("key").orderBy("text_sha256")
    index = (
        entries.withColumn("slot", prefix(F.col("key"), max_depth)).join(slots, "slot")
        .withColumn("chain", F.row_number().over(chained))
        .select("bucket", "depth", "key", "chain", "text_sha256", "keep_id", "group_size")
    )
    return staged(index.repartitionByRange("bucket", "key"))


def mark(docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs) if index is None else index
    copies = index.filter("group_size > 1").select("key", "text_sha256", "keep_id", "group_size")
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = norm.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256"))
    hit = F.col("group_size").isNotNull()
    return rows.join(copies, ["key", "text_sha256"], "left").select(
        "doc_id",
        F.when(hit, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(hit, F.col("keep_id").eqNullSafe(F.col("doc_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = mark(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(normalised(F.col("text")), 256)
    return docs.join(gone.dropDuplicates(), docs.doc_id.eqNullSafe(F.col("__gone")) & (sha == F.col("__sha")), "left_anti")


ORACLE = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
