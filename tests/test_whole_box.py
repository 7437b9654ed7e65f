"""The analyses of the embedding box where the last row of cells isn't full."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small tables with 481 embeddings: 19 rows of 25 cells and six more."""
    import duckdb

    out = tmp_path_factory.mktemp("tables")
    for name in os.listdir(FOLDER):
        if name != "embeddings.parquet":
            os.symlink(f"{FOLDER}/{name}", out / name)
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/embeddings.parquet' WHERE vec_id < 481) TO '{out}/embeddings.parquet'")
    return str(out)


@pytest.mark.parametrize("name", ["grid_sample", "grid_interior", "point_locate", "point_sample", "exact_vs_nodal", "point_field", "point_series_outside", "nearest_wall"])
def test_last_row(spark, folder, name):
    import __spark_entry__ as entry

    from compare import difference, duck

    got = entry.queries()[name](spark, folder).toPandas()
    assert difference(got, duck(folder).execute(entry.oracle_sql()[name]).df()) is None
