"""The plan of valid tiles."""
from pyspark.sql import functions as F

from twinraster.operators import geo as G


def test_exploded_tiles_are_not_broadcast(spark):
    grids = spark.range(3).select("id", F.lit(16).alias("width"), F.lit(8).alias("height"))
    runs = grids.select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), F.lit(0).alias("x0"), F.lit(12).alias("x1"))
    found = G.valid_tiles(G.grid_tiles(grids, 8), [runs], 8, 0.5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.id, r.col, r.valid_fraction) for r in found.collect()) == sorted((i, c, f) for i in range(3) for c, f in ((0, 1.0), (8, 0.5)))
