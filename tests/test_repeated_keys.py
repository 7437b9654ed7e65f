"""Line items that agree in price and part: queries give the rows of their SQL."""

import os

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from quadfield.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables; line items near the walls and some others are there twice, three of them thrice, under other flags."""
    out = str(tmp_path_factory.mktemp("repeated"))
    for name in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{name}", f"{out}/{name}")
    os.remove(f"{out}/lineitem.parquet")
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    twice = items.where("l_partkey % 40 = 7 or l_partkey = 0 or l_extendedprice < 1500").withColumn("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("N"))
    thrice = twice.where("l_extendedprice < 1200").withColumn("l_returnflag", F.lit("R"))
    items.unionByName(twice).unionByName(thrice).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.mark.parametrize("name", ["exact_vs_nodal", "nodal_error", "point_field", "nearest_wall", "nearest_wall_node", "nearest_wall_any", "point_locate", "point_sample", "point_series"])
def test_rows_of_sql(spark, folder, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    con = duck(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    assert difference(QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()) is None
