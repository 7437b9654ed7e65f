"""A training-data pipeline: quality, repeated lines, near copies, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents.  ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadfield.llm import line_dedup, mixing, packing, quality, simhash_dedup
from quadfield.llm.common import documents, staged, table
from quadfield.shipping import attach


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from all labels of documents that are there."""
    attach(spark)
    fitted = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, fitted)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; no document is dropped."""
    attach(spark)
    out = line_dedup.delete_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.col("__lines_removed") > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; links and fingerprints are those of the operator's own query."""
    attach(spark)
    return simhash_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mixture; a document of a source below its target is there once for each epoch."""
    attach(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    attach(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", good), ("line_dedup", without_repeated_lines), ("simhash", one_of_each), ("mixing", mixed), ("packing", packed)]
#: A trained classifier, fingerprints and tokens: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs) if k + 1 < len(STAGES) else docs
    return docs
