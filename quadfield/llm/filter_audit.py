"""How quality filters overlap and what they cost, for every order in which they could be applied.

A document is reduced to the set of filters it fails, and that set to a truth table: a word of 32 bits whose bit ``s`` says whether
the document survives the subset ``s`` of filters (bit 0 of ``s``: filter A ... bit 4: filter E).  Positional popcounts of these words
give the survivors of all 32 subsets for each part and label; every figure of every order follows from them.

* Counting is by carry-save adders: three words of equal weight become a sum word of that weight and a carry word of the next one,
  so a batch of n words takes about n adder steps on whole words instead of 32 n bit counts.  A word that stands for many documents
  enters the adder levels of its count's binary digits.
* Filter E (an earlier document has the same text) is judged on the whole table: documents meet by SHA-256 of the text.  Texts are
  counted on the map side by (text, part, labels), so a text that makes up a third of the table arrives as one row a task.
* Labels meet documents as narrow rows (id, part, digest, failed filters); texts are never shuffled.

Null texts are empty; empty texts are equal, so all but the first fail E.  Rows that share a doc_id and a text are equal in rank: none of
them is earlier than the other.  A null doc_id is never earlier or later than another one: such a row doesn't fail E.  Null sources and
empty ones are one part.  Labels of one doc_id are merged: good (toxic) if any row says so.  Other columns are ignored.  An empty table
has no parts and gives no rows.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import SPACES

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def truth_table(failed: int) -> int:
    """The word of a set of failed filters: bit ``s`` is set if no filter of the subset ``s`` is among them."""
    return sum(1 << s for s in range(SUBSETS) if not s & failed)


def positional_popcount(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of the 32 bits the sum of ``counts`` over the words that have it set."""
    out, carried, level = np.zeros(SUBSETS, np.int64), np.zeros(0, np.uint32), 0
    bits = np.arange(SUBSETS, dtype=np.uint32)
    top = int(counts.max()).bit_length() if len(counts) else 0
    while level < top or len(carried):
        held = np.concatenate([words[(counts >> level) & 1 == 1], carried]) if level < top else carried
        carries = []
        while len(held) > 2:
            n = len(held) // 3
            a, b, c, rest = held[:n], held[n : 2 * n], held[2 * n : 3 * n], held[3 * n :]
            either = a ^ b
            carries.append((a & b) | (c & either))
            held = np.concatenate([either ^ c, rest])
        for w in held:
            out += ((w >> bits) & 1).astype(np.int64) << level
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        level += 1
    return out


def _survivors(batches):
    table = np.array([truth_table(k) for k in range(SUBSETS)], np.uint32)
    for batch in batches:
        words = table[batch.column("failed").to_numpy(zero_copy_only=False)]
        n = batch.column("n").to_numpy(zero_copy_only=False)
        parts = batch.column("part").dictionary_encode()
        code = parts.indices.to_numpy(zero_copy_only=False)
        chosen = [np.ones(len(n), bool)] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
        order = np.argsort(code, kind="stable")
        ends = np.flatnonzero(np.diff(code[order])) + 1
        out = [[], [], [], []]
        for rows in np.split(order, ends) if len(order) else []:
            out[0].append(parts.dictionary[int(code[rows[0]])].as_py())
            for k, mark in enumerate(chosen):
                on = rows[mark[rows]]
                out[k + 1].append(positional_popcount(words[on], n[on]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(x, pa.list_(pa.int64())) for x in out[1:]]], ["part", "held", "good", "toxic"])


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, failed, n): counted documents by the filters they fail, E included."""
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"), failures(F.col("text")).alias("failed"),
    )
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "id", "left").select("id", "part", "sha", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    rows = rows.groupBy("id", "part", "sha", "failed", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    same = rows.groupBy("sha", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    least = same.groupBy("sha").agg(F.min("first").alias("least"))
    early = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    counted = same.join(least, "sha").withColumn("early", early)
    both = F.array(
        F.struct(F.col("failed").alias("failed"), F.col("early").alias("n")),
        F.struct((F.col("failed") + (1 << 4)).alias("failed"), (F.col("n") - F.col("early")).alias("n")),
    )
    return counted.select("part", "good", "toxic", F.inline(both)).filter("n > 0")


def survivors(failed: DataFrame) -> DataFrame:
    """(part, held, good, toxic): for each part three arrays of survivors by subset, over all documents and over those with a label."""
    sums = failed.mapInArrow(_survivors, "part string, held array<long>, good array<long>, toxic array<long>")
    spread = sums.select("part", F.posexplode(F.arrays_zip("held", "good", "toxic")).alias("subset", "c"))
    total = spread.groupBy("part", "subset").agg(*[F.sum(f"c.{c}").alias(c) for c in ("held", "good", "toxic")])
    whole = total.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "held", "good", "toxic"))).alias("t"))
    return whole.select("part", *[F.col(f"t.{c}").alias(c) for c in ("held", "good", "toxic")])


def _steps() -> tuple[str, str]:
    rows = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before = sum(1 << g for g in order[:step])
            rows.append({"filter_order": "".join(FILTERS[g] for g in order), "step": step + 1, "f": f, "b": before, "a": before | 1 << f})
    return json.dumps(rows), "array<struct<filter_order string, step int, f int, b int, a int>>"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module's description for each case."""
    held, good, toxic = F.col("held"), F.col("good"), F.col("toxic")
    full = SUBSETS - 1

    def removed_in_all_orders(f: int) -> Column:
        """Orders whose prefix before ``f`` is the set s: |s|! (4 - |s|)!."""
        ways = {0: 24, 1: 6, 2: 4, 3: 6, 4: 24}
        terms = [ways[s.bit_count()] * (held[s] - held[s | 1 << f]) for s in range(SUBSETS) if not s >> f & 1]
        return sum(terms[1:], terms[0])

    table = survivors(failed_sets(docs, labels))
    table = table.withColumn("shares", F.array(*[removed_in_all_orders(f) for f in range(len(FILTERS))]))
    text, schema = _steps()
    rows = table.select("part", "held", "good", "toxic", "shares", F.inline(F.from_json(F.lit(text), schema)))
    b, a, alone = F.col("b"), F.col("a"), F.col("a") - F.col("b")
    removed = held[b] - held[a]
    return rows.select(
        "part", "filter_order", "step", held[a].alias("kept"), removed.alias("removed"),
        (held[F.lit(0)] - held[alone] - removed).alias("redundant"), (held[F.lit(full) - alone] - held[F.lit(full)]).alias("unique_fails"),
        (good[b] - good[a]).alias("good_lost"), (toxic[b] - toxic[a]).alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT t.*, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
             min(t.doc_id) OVER (PARTITION BY body) AS earliest, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
             100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 2 * length(body) AS C,
             regexp_matches(body, '[#$%&*|]') AS D, coalesce(doc_id > earliest, false) AS E FROM w),
c AS (SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x)
      JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter, substr(filter_order, 1, step::INT - 1) AS done
      FROM o, range(1, 6) r(step)),
h AS (SELECT *, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END)
             || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS failed FROM c),
g AS (SELECT part, failed, filter_order, step, letter, n, n_good, n_toxic, contains(failed, letter) AS fails,
             length(translate(done, failed, '')) < length(done) AS gone FROM h, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
             coalesce(sum(n_good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
