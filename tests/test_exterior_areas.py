"""Areas of exported exteriors: tiles finished in one kernel equal those of boundaries and sweeps; the prediction is made once."""
import random

import pytest

from pyspark.sql import functions as F

from twinraster.operators import chains as C
from twinraster.operators import runs as R
from twinraster.operators import scoring as S

SIDE = 12


@pytest.fixture(scope="module")
def masks(spark):
    draw = random.Random(5)
    cells = lambda share: [(t, c, y, x) for t in range(12) for c in S.CLASSES for y in range(SIDE) for x in range(SIDE) if draw.random() < share(t)]
    ring = [(20, S.CLASSES[0], y, x) for y in range(2, 9) for x in range(2, 9) if 2 in (y, x) or 8 in (y, x)]  # encloses a cell of its own and background
    corner = [(21, S.CLASSES[0], y, x) for y, x in ((0, 1), (1, 0), (1, 2), (2, 1), (0, 0), (0, 2))]  # two components that enclose a cell only together
    make = lambda rows: R.to_runs(spark.createDataFrame(rows, "pair_id long, class_name string, y int, x int")).cache()
    pred = R.label_components(make(cells(lambda t: 0.3 + t / 20) + ring + [(20, S.CLASSES[0], 5, 5)] + corner), SIDE, SIDE)
    return pred, make(cells(lambda t: 0.8 - t / 20) + ring)


def test_kernel_and_boundaries_agree(masks):
    rows = lambda df: sorted(map(tuple, df.select(*R.TILE, *S.AREAS).collect()))
    one, other = rows(S.exterior_areas(*masks, SIDE, SIDE)), rows(S.exterior_areas(*masks, SIDE, SIDE, band_rows=5))
    assert one == other and len(one) == 26
    found = {r[:2]: r[2:] for r in one}
    assert found[20, S.CLASSES[0]][:3] == (49, 49, 49) and found[21, S.CLASSES[0]][0] == 6


def test_few_masks_at_a_time(masks):
    rows = lambda kernel: sorted(map(tuple, R.whole_groups(both, R.TILE, ["side", "y", "x0"], kernel, shape).collect()))
    pred, truth = masks
    both = pred.select(*R.TILE, "y", "x0", "x1", "component_id", F.lit(0).alias("side")).unionByName(truth.select(*R.TILE, "y", "x0", "x1", F.lit(0).cast("long").alias("component_id"), F.lit(1).alias("side")))
    shape = "pair_id long, class_name string, " + ", ".join(f"{c} long" for c in S.AREAS)
    assert rows(S._exterior_areas(SIDE, SIDE, 1)) == rows(S._exterior_areas(SIDE, SIDE))


def test_validation_makes_the_prediction_once(spark, masks):
    pred, truth = masks
    made = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(pred.rdd.map(lambda r: (made.add(1), r)[1]), pred.schema)
    population = spark.createDataFrame([(t, c) for t in range(22) for c in S.CLASSES], "pair_id long, class_name string")
    assert C.validate(counted, truth, population, SIDE, SIDE).count() == 1
    assert made.value == pred.count()
    with pytest.raises(Exception, match="outside the population"):
        C.validate(pred, truth, population.filter("pair_id < 20"), SIDE, SIDE)
