"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from functools import wraps

from quadfield.llm import embedding_dedup, exact_dedup, filter_audit, language_id, line_dedup, mixing, nearest_vectors, packing, pii, quality, simhash_dedup, substring_dedup, token_alignment
from quadfield.llm.common import documents, table
from quadfield.shipping import attach

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` and, where there is one, the SQL that gives the same rows."""

    def add(fn):
        @wraps(fn)
        def run(spark, folder):
            attach(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op4_exact_dedup", exact_dedup.ORACLE)
def op4(spark, folder):
    return exact_dedup.mark(documents(spark, folder))


@query("op2_line_dedup", line_dedup.ORACLE)
def op2(spark, folder):
    return line_dedup.digest(documents(spark, folder))


@query("op1_simhash")
def op1(spark, folder):
    return simhash_dedup.mark(documents(spark, folder))


@query("op10_mixing", mixing.ORACLE)
def op10(spark, folder):
    return mixing.digest(documents(spark, folder))


@query("op7_packing")
def op7(spark, folder):
    return packing.pack_documents(documents(spark, folder))


@query("op8_quality")
def op8(spark, folder):
    return quality.predict(documents(spark, folder), table(spark, folder, "labels"))


@query("op9_substring_dedup")
def op9(spark, folder):
    return substring_dedup.digest(documents(spark, folder))


@query("op5_pii")
def op5(spark, folder):
    return pii.detect(documents(spark, folder))


@query("op6_language_id")
def op6(spark, folder):
    return language_id.identify(documents(spark, folder))


@query("op3_nearest_vectors")
def op3(spark, folder):
    return nearest_vectors.digest(table(spark, folder, "embeddings"))


@query("op12_filter_audit", filter_audit.ORACLE)
def op12(spark, folder):
    return filter_audit.audit(documents(spark, folder), table(spark, folder, "labels"))


@query("op13_embedding_dedup")
def op13(spark, folder):
    return embedding_dedup.mark(table(spark, folder, "embeddings"))


@query("op11_token_alignment")
def op11(spark, folder):
    return token_alignment.align(documents(spark, folder))
