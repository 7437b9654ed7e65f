"""Repeated line runs are followed to their end."""

from quadfield.llm import line_dedup

from .test_text_operators import frame, rows_by_id


def test_end_of_a_shared_run(spark):
    a, b, c = "a" * 90, "b" * 20, "c" * 20
    texts = [f"{a}\n{b}\n{c}\nthis one goes on", f"first\n{a}\n{b}\n\n{c}\nthat one differs", f"{a}\n{b}\n{c}", f"{b}\n{c}\n{'d' * 70}"]
    got = rows_by_id(line_dedup.delete_lines(frame(spark, list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].text for k in range(4)] == [texts[0], "first\n\nthat one differs", "", texts[3]]
    assert [got[k]["__lines_removed"] for k in range(4)] == [0, 3, 3, 0]


def test_frequent_lines(spark):
    """A line at eight places or more goes from the later ones, whatever its run; shorter or rarer ones stay."""
    said, rare, brief = "share this page with friends", "this one stands at seven places", "yes, of course"
    rows = [(k, f"own line {k}\n{said}\n{brief}\n" + (f"{rare}\n" if k < 7 else "") + f"end {k}") for k in range(9)]
    rows += [(20, None), (21, ""), (22, f"{said}\n{said}"), (22, f"{said}\n{said}"), (None, "alone")]
    got = {}
    for r in line_dedup.delete_lines(frame(spark, rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.text, r["__lines_removed"]))
    assert got[0] == [(rows[0][1], 0)] and got[20] == [(None, 0)] and got[21] == [("", 0)] and got[None] == [("alone", 0)]
    assert got[22] == [("", 2)] * 2
    for k in range(1, 9):
        assert got[k] == [(rows[k][1].replace(f"{said}\n", ""), 1)]


def test_untouched_texts_are_not_shuffled(spark):
    """Documents whose bit isn't set pass through: the join with the deletions sees the others only."""
    rows = [(k, f"line {k}") for k in range(500)] + [(k, "the very same line of text " * 5) for k in range(500, 504)]
    out = line_dedup.delete_lines(frame(spark, rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "bitmap_construct_agg" in plan
    assert sorted(r.doc_id for r in out.collect() if r["__lines_removed"]) == [501, 502, 503] and out.count() == 504
