"""The pipeline, stage by stage, against brute force on small tables."""

import os
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from quadfield.llm import line_dedup, mixing, packing

from .test_text_operators import fingerprint, gone_lines, smallest_reachable

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, written and read again in between."""
    out, docs = [], spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        after = stage(spark, docs, FOLDER)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.toPandas(), after.toPandas(), path))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality", "line_dedup", "simhash", "mixing", "packing"]
    for _, before, after, _ in stages[:-1]:
        assert list(after.columns) == list(before.columns) and len(after)


def test_quality_rejects_what_is_labelled_bad(stages):
    _, before, after, _ = stages[0]
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet' WHERE quality IS NOT NULL").df().set_index("doc_id").quality
    kept = set(after.doc_id)
    assert kept < set(before.doc_id)
    known = [k for k in before.doc_id if k in labels.index]
    assert sum((k in kept) == bool(labels[k]) for k in known) / len(known) > 0.95
    same = before.set_index("doc_id").loc[after.doc_id]
    assert (same.text.values == after.text.values).all()


def test_lines_go(stages):
    _, before, after, _ = stages[1]
    rows = [(int(k), t) for k, t in zip(before.doc_id, before.text)]
    gone = gone_lines(rows, line_dedup.MIN_CHARS)
    got = after.set_index("doc_id")
    assert gone and len(got) == len(rows)
    for k, t in rows:
        want = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ()))
        assert got.loc[k].text == want and (k not in gone or got.loc[k].n_chars == len(want))


def test_one_of_each_group_stays(stages):
    _, before, after, _ = stages[2]
    ids = [int(k) for k in before.doc_id]
    comp = smallest_reachable(ids, [fingerprint(t, 3) for t in before.text], 3)
    assert set(after.doc_id) == set(comp.values()) and len(after) == len(set(comp.values()))


def test_mixture(stages):
    _, before, after, _ = stages[3]
    con = duckdb.connect()
    con.register("documents", before)
    want = con.execute(f"SELECT doc_id, count(*) AS n FROM ({mixing.ORACLE}) GROUP BY doc_id").df()
    assert after.groupby("doc_id").size().to_dict() == dict(zip(want.doc_id, want.n))


def test_sequences(stages):
    _, before, after, _ = stages[4]
    encode, want = packing.WordIds()._encode, {}
    for k, t in zip(before.doc_id, before.text):
        ids = encode(t or "") + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(ids), 8192)):
            key = (int(k), n, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192]))
            want[key] = want.get(key, 0) + 1
    got = after.groupby(["doc_id", "piece", "start", "length", "ids_crc32"]).size().to_dict()
    assert got == want
    for _, own in after.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.values == [0, *own.length.cumsum().values[:-1]]).all() and own.length.sum() <= 2048


def test_everything_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert {"op2_line_dedup", "op4_exact_dedup", "op10_mixing", "op12_filter_audit"} <= set(entry.oracle_sql())
