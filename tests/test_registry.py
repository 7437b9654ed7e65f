import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

#: analyses that finish quickly; compare.py covers all of them
QUICK = ["box_nodes", "calc_ieee_edge", "grad_phys", "modal_decay", "probe_mean", "probe_outside", "point_series", "line_crossings", "boundary_edges", "force_total", "step_nearest", "roundtrip_f32", "surface_triangles",
         "roundtrip_parts", "metafile_case", "directory_case", "probe_repeats", "point_series_outside", "select_fields", "calc_unary", "mesh_maps", "saved_sets", "visible_stored", "roundtrip_padded", "series_ranges_stored", "force_rollup"]


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    import __spark_entry__ as entry

    from compare import difference, duck

    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, duck(FOLDER).execute(entry.oracle_sql()[name]).df()) is None


def test_every_query_has_sql():
    import __spark_entry__ as entry

    own = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}
    assert own == own & set(entry.oracle_sql()) and len(own) > 70


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["flag", "points", "mean_q"]
