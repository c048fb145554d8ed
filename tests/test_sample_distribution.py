"""Counts of label tiles: one kernel over whole samples equals the run tables, and the labels are read once."""
import random

import pytest

from twinraster.operators import integrity as I

SIDE = 9


@pytest.fixture(scope="module")
def labels(spark):
    draw = random.Random(2)
    cells = [(t, y, x, draw.choices([0, 1, 2, -100, None], [3, 2, 2, 1, 1])[0]) for t in range(15) for y in range(SIDE) for x in range(SIDE) if draw.random() < 0.3 + t / 20]
    only = [(30, 0, 0, -100), (31, 8, 8, 1), (32, 0, 0, 1), (33, 0, 8, 2), (33, 1, 0, 2), (34, 4, 4, 0), (35, 0, 0, 1), (35, 1, 1, 1), (35, 2, 0, 2)]
    return spark.createDataFrame(cells + only, "pair_id long, y int, x int, label int")


def rows(df):
    return sorted(map(tuple, df.select("pair_id", *I.COUNTS, "category").collect()))


def test_kernel_and_runs_agree(labels):
    one = rows(I.sample_distribution(labels, SIDE, SIDE))
    assert one == rows(I.sample_distribution(labels, SIDE, SIDE, band_rows=4))
    found = {r[0]: r[1:] for r in one}
    assert len(one) == 21 and found[33][5:7] == (0, 2) and found[35] == (0, 2, 1, 3, 0, 1, 1, "both")


def test_labels_are_read_once(labels):
    plan = I.sample_distribution(labels, SIDE, SIDE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


def test_tiles_of_the_table_meet_once(spark):
    from twinraster.plans import audit_queries as A
    labels = A.clean_labels(spark, "/root/testdata/sf0.001")
    plan = I.sample_distribution(labels, 32, 32)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1
    joined = A.scoped(spark, "/root/testdata/sf0.001").na.fill(0, ["label"]).select("pair_id", "y", "x", "label")
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, joined.collect()))
