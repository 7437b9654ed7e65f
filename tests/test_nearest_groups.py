"""Points of a cell are one group of the search for the nearest wall, wherever they come from."""

from pyspark.sql import functions as F

import quadfield.operators.nearest as nearest
from quadfield.operators import boundary as bd
from quadfield.operators.scans import checkpointed
from quadfield.sources import generators as gen


def test_a_group_for_each_cell(spark, monkeypatch):
    made, pack = [], nearest.pack
    monkeypatch.setattr(nearest, "pack", lambda df, by, lists, *more: made.append((df.select(*by), out := pack(df, by, lists, *more))) or out)
    mesh = checkpointed(gen.box(spark, 4, 3, 3, (0, 4), (0, 3), case="w"))
    spot = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10 ** 6)) / 10 ** 6
    points = spark.range(1200, numPartitions=7).select(F.lit("w").alias("case"), F.col("id").alias("pid"), (4 * spot(1)).alias("x"), (3 * spot(2)).alias("y"))
    got = nearest.nearest_wall_any(points, bd.external_edges(mesh), mesh, ["pid", "x", "y"])
    far = F.abs(F.col("dist") - F.least("x", 4 - F.col("x"), "y", 3 - F.col("y")))
    assert got.agg(F.count(F.lit(1)), F.max(far)).first()[0] == 1200 and got.agg(F.max(far)).first()[0] < 1e-5
    cells, packed = made[0]
    assert packed.count() == cells.distinct().count()
