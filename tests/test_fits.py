"""Fits and weights over tables with many rows per value."""
import random

import pytest

from pyspark.sql import functions as F

from twinraster.operators import models as L


def test_equal_rows_are_one_row_of_a_fit(spark):
    draw = random.Random(5)
    rows = [(a / 4, b / 3, int(draw.random() < 0.3 + 0.1 * a), (a + b) % 2) for a in range(5) for b in range(4)]
    few = spark.createDataFrame(rows, "a double, b double, y int, fold int")
    many = few.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(25)))).drop("_copy")
    table = L.design(many, ["a", "b"], "y", held=F.col("fold"))
    assert table.count() == len(rows)
    # 25 copies of a row are a row of weight 25; model 2 leaves no row out
    other = L.fit_logistic(L.design(few, ["a", "b"], "y", weight=F.lit(25.0), held=F.col("fold")), 2, 3)
    for one, two in zip(L.fit_logistic(table, 2, 3), other):
        assert [*one["mean"], *one["scale"], *one["weights"], one["bias"]] == pytest.approx([*two["mean"], *two["scale"], *two["weights"], two["bias"]], abs=1e-9)
        assert one["converged"]


def test_rows_are_not_exchanged_by_stratum(spark):
    """Rows of a stratum, or of a feature, never meet in one task: the small side travels, also where Spark's own limit for it is off."""
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class_name"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 5 == 0).alias("real"), F.col("id").cast("double").alias("v"))
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        weighted = L.stratum_weights(rows)
        moments = L.weighted_moments(weighted, ["class_name"], ["v"])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (weighted, moments)]
    finally:
        spark.conf.set(name, before)
    assert all("BroadcastHashJoin" in p for p in plans) and "SortMergeJoin" not in plans[0]
    assert weighted.filter("class_name = 'a'").agg(F.sum("weight")).first()[0] == pytest.approx(100)
