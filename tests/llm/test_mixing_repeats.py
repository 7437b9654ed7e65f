"""Rows that can't be told apart by doc_id and text, in the mixture."""

import collections

from pyspark.sql import functions as F

from quadfield.llm import mixing

from .test_text_operators import frame

KINDS = "doc_id long, text string, lang string, source string, n_chars long, __extra string"


def counts(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def test_as_many_of_equal_rows_as_were_chosen(spark):
    rows = [(7, "one two three", "en", "src0", k, "x") for k in range(40)] + [(7, "one two three", "de", "src1", 99, "y")] * 3
    rows += [(k, f"word {k} and more", "en", "src0", k, None) for k in range(100, 130)] + [(None, "no id", "en", "src0", 1, None)] * 4
    docs = frame(spark, rows, KINDS).repartition(5)
    chosen = mixing.select_epochs(docs).collect()
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    got = got.withColumn("origin", F.col("source")).collect()
    assert counts(got, "doc_id", "origin") == counts(chosen, "doc_id", "origin")
    times = counts([r for r in got if r.doc_id == 7 and r.source == "src0"], "n_chars")
    assert max(times.values()) - (min(times.values()) if len(times) == 40 else 0) <= 1  # dealt evenly


def test_a_budget_for_one_of_two_equal_rows(spark):
    docs = frame(spark, [(1, "one two", "en", "src0", 7, "x")] * 2, KINDS)
    assert len(mixing.select_epochs(docs, spend=0.5).collect()) == 1
    assert mixing.mix(docs, spend=0.5).collect() == docs.limit(1).collect()


def test_nothing(spark):
    docs = frame(spark, [], KINDS)
    assert mixing.mix(docs).count() == 0
