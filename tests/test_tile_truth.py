from pyspark.sql import functions as F

from twinraster.plans import views as V


def test_compact_lines_give_the_truth_of_the_pixels(spark, tmp_path):
    """Negative, null and repeated keys, and flags beside R."""
    rows = [(k % 7 - 3 if k % 31 else None, k % 2 and "O" or "F", k % 90 - 45 if k % 17 else None, k % 70 - 35 if k % 19 else None, 0.05, ("A", "N", "R", "S", None)[k % 5 if k % 3 else 2])
            for k in range(3000)]
    spark.createDataFrame(rows, "l_suppkey long, l_linestatus string, l_partkey long, l_orderkey long, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    pixels = V.tile_pixels(spark, str(tmp_path)).select("pair_id", "class_name", "y", "x", "truth")
    found = V.tile_truth(spark, str(tmp_path)).select(*pixels.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, pixels.collect()))
    assert found.filter("truth").count() and found.filter(F.col("truth").isNull()).count()


def test_a_line_is_exchanged_as_two_numbers(spark):
    plan = V.tile_truth(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Project [l_suppkey" in line]
    assert "RepartitionByExpression [pair_id" in plan and len(exchanged) == 1 and "_code" in exchanged[0] and "l_returnflag#" not in exchanged[0].split("AS _code")[-1]
