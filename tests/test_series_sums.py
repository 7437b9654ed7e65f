"""Points of many steps: packed by element, summed in the kernel, every one of them counted."""

import pytest
from pyspark.sql import functions as F

import quadfield.operators.locate as loc
import quadfield.sources.generators as gen
from quadfield.operators.scans import checkpointed


@pytest.fixture(scope="module")
def box(spark):
    return checkpointed(gen.analytic_field(gen.box(spark, 6, 5, 4, (0, 6), (0, 5), case="b"), "q", lambda x, y: x + 10 * y))


@pytest.fixture(scope="module")
def points(spark):
    spot = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10 ** 6)) / 10 ** 6
    flag = F.when(F.col("id") % 7 < 3, "a").when(F.col("id") % 7 < 5, "b")
    return spark.range(3000, numPartitions=6).select(F.lit("b").alias("case"), flag.alias("flag"), (7 * spot(1) - 0.5).alias("x"), (5 * spot(2)).alias("y"))


def steps_of(box, steps):
    rows = box.select("case", F.explode(F.array(*[F.lit(k) for k in steps])).alias("step"), "elem", "q")
    return rows.withColumns({"time": F.col("step") * 0.5, "q": F.zip_with("q", F.array_repeat("step", F.size("q")), lambda v, s: v * (s + 1))})


def test_an_element_has_one_chunk(spark, box, points, monkeypatch):
    """Points of an element that come from all partitions meet its steps as one packed row."""
    made, pack = [], loc.pack
    monkeypatch.setattr(loc, "pack", lambda df, by, lists, *more: made.append((by, out := pack(df, by, lists, *more))) or out)
    got = loc.sample(points, box, steps_of(box, range(40)), ["q"], ["flag", "x", "y"], fill=None)
    assert [packed.count() for by, packed in made if by == ["case", "elem"]] == [30]
    error = F.abs(F.col("q") - (F.col("x") + 10 * F.col("y")) * (F.col("step") + 1))
    assert got.agg(F.count(F.lit(1)), F.max(error)).first()[0] == 120000 and got.agg(F.max(error)).first()[0] < 1e-9


def test_sums_are_those_of_the_samples(spark, box, points):
    """Outside points, a group without a name, elements that miss steps, shares, and more steps than one row holds."""
    fields = steps_of(box, [0, 1, 2, 31, 32, 70]).where("not (elem = 3 and step = 1) and elem <> 7")
    one = loc.sample(points, box, fields, ["q"], ["flag", "x", "y"], fill=None).groupBy("flag", "step").agg(
        F.count(F.lit(1)), F.count("elem"), F.count("q"), F.sum("q"),
    )
    want = {(r[0], r[1]): r[2:] for r in one.collect()}
    for share in (16, 1 << 15):
        got = {(r.flag, r.step): (r.points, r.inside, r.valued, pytest.approx(r.q)) for r in loc.sample_sums(points, box, fields, ["q"], ["flag"], share=share).collect()}
        assert len(got) == 18 and got == want


def test_no_point_inside(spark, box):
    away = spark.createDataFrame([("b", "a", 9.0, 9.0), ("b", "a", float("nan"), 1.0)], "case string, flag string, x double, y double")
    got = loc.sample_sums(away, box, steps_of(box, [0, 1]), ["q"], ["flag"]).collect()
    assert sorted((r.step, r.points, r.inside, r.valued, r.q) for r in got) == [(0, 2, 0, 0, None), (1, 2, 0, 0, None)]
