import os

import pytest
from pyspark.sql import functions as F

from quadfield.sources import fieldfiles as ff
from quadfield.sources import generators as gen


def written(spark, folder, case, steps=(0, 1), n=12, **how):
    m = gen.box(spark, n, 1, 3, (0, n), (0, 1)).select("elem", "gid", "x", "y")
    for k in steps:
        ff.write_field_file(m.withColumn("p", F.transform("x", lambda v: v + 100 * k)), str(folder), case, k, 0.5 * k, **how).collect()


def back(steps, n=12):
    rows = ff.read_elements(steps, ["x", "p"]).orderBy("case", "step", "elem").collect()
    cases = sorted({r.case for r in rows})
    for case in cases:
        own = [r for r in rows if r.case == case]
        assert [(r.step, r.elem) for r in own] == [(s, e) for s in (0, 1) for e in range(n)]
        assert all(r.gid == r.elem + 1 and r.x[0] == r.elem and r.p[0] == r.elem + 100 * r.step for r in own)
    return cases


def test_readings_of_a_name():
    assert ff.part_layouts("emb0.f00000", 0) == [("emb", 0), ("emb", 1)]
    assert ff.part_layouts("run20.f00001", 0) == [("run2", 0), ("run2", 1)]
    assert ff.part_layouts("box012.f00001", 12) == [("box0", 0), ("box0", 2), ("box", 3)]
    assert ff.part_layouts("box00.f00001", 0) == [("box0", 0), ("box0", 1), ("box", 2)]
    assert ff.part_layouts("box5.f00001", 4) == [] and ff.part_layouts("notes.txt", 0) == []


@pytest.mark.parametrize("case, per, digits", [("box", 1, 2), ("box", 1, 0), ("run2", 4, 0), ("run2", 1, 3), ("run10", 1, 0)])
def test_parts_are_found(spark, tmp_path, case, per, digits):
    written(spark, tmp_path, case, elements_per_file=per, part_digits=digits)
    files = sorted(os.listdir(tmp_path))
    files = [f for f in files if f.endswith("f00000")]
    assert len(files) == 12 // per
    for opened in (files[0], files[-1]):
        (name,) = back(ff.read_steps_table(spark, f"{tmp_path}/{opened}"))
        # zeros may belong to the case or to the numbers when there are more than the numbers need; the files are the same
        assert name == case if digits <= len(str(12 // per - 1)) else name.rstrip("0") == case.rstrip("0")
    every = ff.resolve_case(spark, f"{tmp_path}/{case}*.f*").withColumn("case", F.lit("c"))
    assert back(ff.read_headers(every)) == ["c"]


def test_cases_whose_names_begin_alike(spark, tmp_path):
    """Parts of run1 and of run10 lie side by side: run10.f00000 is a part of the one, run100.f00000 of the other."""
    written(spark, tmp_path, "run1", elements_per_file=6)
    written(spark, tmp_path, "run10", elements_per_file=6)
    assert back(ff.read_steps_table(spark, f"{tmp_path}/run11.f00000")) == ["run1"]
    assert back(ff.read_steps_table(spark, f"{tmp_path}/run101.f00000")) == ["run10"]


def test_single_files_keep_one_digit(spark, tmp_path):
    written(spark, tmp_path, "run2")
    steps = ff.read_steps_table(spark, f"{tmp_path}/run20.f00000")
    assert back(steps) == ["run2"] and steps.count() == 2


def test_a_missing_part_is_reported(spark, tmp_path):
    written(spark, tmp_path, "box", elements_per_file=1, part_digits=2)
    os.remove(f"{tmp_path}/box07.f00001")
    steps = ff.read_steps_table(spark, f"{tmp_path}/box00.f00000")
    with pytest.raises(Exception, match="parts of the step hold 11 of 12 elements; not there: box07.f00001"):
        steps.select("nelv").collect()


def test_gaps_in_element_numbers(spark, tmp_path):
    """Blocks without elements leave no hole among the parts; ids of the solver stay."""
    m = gen.box(spark, 12, 1, 3, (0, 12), (0, 1)).where("elem not between 3 and 8").select("elem", "gid", "x", "y")
    files = ff.write_field_file(m, str(tmp_path), "gap", 0, elements_per_file=3).collect()
    assert sorted(r.elements for r in files) == [3, 3] and sorted(os.path.basename(r.file) for r in files) == ["gap0.f00000", "gap1.f00000"]
    rows = ff.read_elements(ff.read_steps_table(spark, f"{tmp_path}/gap0.f00000"), ["x"]).orderBy("elem").collect()
    assert [(r.elem, r.gid, r.x[0]) for r in rows] == [(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 10, 9), (4, 11, 10), (5, 12, 11)]


def test_files_are_bounded_by_bytes(spark, tmp_path):
    m = gen.box(spark, 20, 1, 5, (0, 20), (0, 1)).select("elem", "x", "y")
    files = ff.write_field_file(m, str(tmp_path), "b", 0, bytes_per_file=4 * 2 * 25 * 6).collect()
    assert sorted(r.elements for r in files) == [2, 6, 6, 6]
    assert all(os.path.getsize(r.file.removeprefix("file:")) <= 4 * 2 * 25 * 6 + 132 + 4 + 4 * 6 for r in files)
