"""Kernels over many whole groups at a time."""
import pyarrow as pa
from pyspark.sql import functions as F

from twinraster.operators import matching as K
from twinraster.operators import runs as R


def _calls(df, keys, order):
    """One row per call of a kernel: its groups, its rows, and whether it begins with a group."""
    def seen(table: pa.Table) -> pa.Table:
        at = table.column("_at").to_pylist()
        return pa.table({"groups": [at.count(1)], "rows": [len(at)], "whole": [at[0] == 1]})

    return R.whole_groups(df, keys, order, seen, "groups long, rows long, whole boolean")


def test_small_groups_share_a_call_and_large_ones_stay_whole(spark):
    small = spark.range(3000).select((F.col("id") % 1000).alias("g"), F.col("id").alias("v"))
    large = spark.range(25000).select(F.lit(5000).cast("long").alias("g"), F.col("id").alias("v"))
    calls = _calls(small.unionByName(large), ["g"], ["v"]).collect()
    assert sum(c.groups for c in calls) == 1001 and sum(c.rows for c in calls) == 28000 and all(c.whole for c in calls)
    assert len(calls) < 50


def test_no_group_gives_no_call(spark):
    assert _calls(spark.range(0).withColumn("g", F.lit(1)), ["g"], ["id"]).count() == 0


def test_many_tiles_are_labelled_and_walked_apart(spark):
    """Equal runs in neighbouring tiles of one call do not touch, and a component used in one tile is free in the next."""
    runs = spark.range(400).select(F.col("id").alias("pair_id"), F.lit("a").alias("class_name"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("y"), F.lit(2).alias("x0"), F.lit(4).alias("x1"))
    lab = R.component_areas(R.label_components(runs, 8, 8))
    assert sorted({(r.component_id, r.area, r["count"]) for r in lab.groupBy("component_id", "area").count().collect()}) == [(2, 4, 400), (58, 2, 400)]
    edges = spark.range(400).select(F.col("id").alias("pair_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(u).alias("iou"), F.lit(0.0).alias("drift")) for i, j, u in ((1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.3), (2, 2, 0.2))])).alias("e")).select("pair_id", "e.*")
    kept = K.greedy_match(edges, ["pair_id"])
    assert sorted((r.i, r.j, r["count"]) for r in kept.groupBy("i", "j").count().collect()) == [(1, 1, 400), (2, 2, 400)]
