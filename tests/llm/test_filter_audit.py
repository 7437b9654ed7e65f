import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quadfield.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def failed(text, doc_id, earliest):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and earliest.get(text, doc_id) < doc_id else "")


def brute(docs, labels):
    earliest = {}
    for d in docs:
        if d[0] is not None:
            earliest[d[1] or ""] = min(earliest.get(d[1] or "", d[0]), d[0])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {d[3] or "" for d in docs}:
        rows = [(failed(d[1], d[0], earliest), d[0] in good, d[0] in toxic) for d in docs if (d[3] or "") == part]
        shares = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                now = [r for r in left if f not in r[0]]
                gone = [r for r in left if f in r[0]]
                shares[f] += len(gone)
                fails = sum(f in r[0] for r in rows)
                out[part, order, k + 1] = (len(now), len(gone), fails - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                left = now
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1] += (shares[f],)
    return out


def check(spark, docs, labels):
    wide = [(*d, "x", 1, True) for d in docs]
    df = spark.createDataFrame(wide, DOCS + ", part string, n int, good boolean").repartition(5)
    marks = spark.createDataFrame([(*r, "x") for r in labels], LABELS + ", part string")
    got = filter_audit.audit(df, marks).collect()
    want = brute(docs, labels)
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(rows) == len(want) and rows == want


def test_popcount():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 7, 1000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        for counts in (np.ones(n, np.int64), rng.integers(1, 10**9, n)):
            want = [int(counts[(words >> np.uint32(b)) & 1 == 1].sum()) for b in range(32)]
            assert filter_audit.positional_popcount(words, counts).tolist() == want


def test_truth_table():
    assert filter_audit.truth_table(0) == (1 << 32) - 1 and filter_audit.truth_table(31) == 1
    assert [s for s in range(32) if filter_audit.truth_table(0b00101) >> s & 1] == [s for s in range(32) if not s & 0b00101]


def test_random_documents(spark):
    rng = np.random.default_rng(3)
    def text(k):
        words = [f"w{rng.integers(0, 60 if k % 3 else 4000)}" for _ in range(int(rng.integers(150, 260)))]
        return " ".join(words) + (" #" if k % 5 == 0 else "") + (" ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJK" if k % 4 == 0 else "")
    texts = [text(k) for k in range(60)]
    docs = [(int(i), texts[int(rng.integers(0, 60))], None, f"s{rng.integers(0, 3)}", 0) for i in rng.permutation(200)]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 260, 2)]
    check(spark, docs, labels)


def test_odd_rows(spark):
    long = "word " * 30000
    docs = [
        (1, None, None, None, None), (2, "", None, "", 0), (3, "  \t\n", None, "a", 0), (None, "x", None, "a", 0), (None, None, None, "a", 0), (5, "x", None, "a", 0),
        (6, "x", None, "b", 0), (6, "x", None, "b", 0), (6, "y", None, "a", 0), (5, "x", None, "a", 0), (7, long, None, "b", 0), (8, long, None, "a", 0), (-4, "x", None, "c", 0), (9, "É Ä " * 300, None, "c", 0),
    ]
    labels = [(1, 1, None), (1, 0, 1), (5, 1, 0), (6, None, 1), (6, 1, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    check(spark, docs, labels)


def test_one_text_holds_a_third(spark):
    docs = [(k, "same text" if k % 3 == 0 else f"text {k}", None, f"s{k % 2}", 0) for k in range(900)]
    check(spark, docs, [(k, k % 2, int(k % 5 == 0)) for k in range(900)])


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_nothing(spark, labels):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0
