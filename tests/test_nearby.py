import numpy as np
import pytest

from twinraster.operators import evidence as E
from twinraster.operators.nearby import neighbours


def brute_force(x, y, weight, reach):
    d = np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :])
    close = np.where(d <= reach, weight[None, :], 0).sum(1) - weight
    np.fill_diagonal(d, np.inf)
    return d.min(1), close


@pytest.mark.parametrize("seed", range(12))
def test_neighbours_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([1, 2, 3, 7, 60, 700]))
    kind = seed % 4
    x, y = rng.uniform(0, 256, n), rng.uniform(0, 256, n)
    if kind == 1:  # whole and half numbers, many in one place
        x, y = np.round(x / 16) / 2, np.round(y / 16) / 2
    if kind == 2:  # a crowd and a few far away
        x[n // 5:], y[n // 5:] = 40 + x[n // 5:] * 1e-4, 40 + y[n // 5:] * 1e-4
    if kind == 3:
        y[:] = 3.0
    weight = rng.integers(1, 50, n).astype(float)
    for reach in (0.5, 3.0, 50.0, 1000.0):
        near, close = neighbours(x, y, weight, reach)
        want = brute_force(x, y, weight, reach)
        np.testing.assert_allclose(near, want[0], rtol=1e-12)
        np.testing.assert_array_equal(close, want[1])


def test_fifty_thousand_components_in_one_tile(spark):
    """A tile of 250 x 200 components on a jittered grid, in one group."""
    rng = np.random.default_rng(1)
    gx, gy = np.meshgrid(np.arange(250), np.arange(200))
    x, y = (gx * 8 + rng.uniform(0, 3, gx.shape)).ravel(), (gy * 8 + rng.uniform(0, 3, gx.shape)).ravel()
    area = rng.integers(1, 40, len(x)).astype(float)
    rows = [(1, "new_building", k, float(area[k]), float(x[k]), float(y[k])) for k in range(len(x))]
    shapes = spark.createDataFrame(rows, "pair_id long, class_name string, component_id long, area double, centroid_x double, centroid_y double")
    found = E.neighbour_context(shapes, image_size=2048, reach=50.0).toPandas().sort_values("component_id")
    some = rng.choice(len(x), 300, replace=False)
    d = np.hypot(x[some, None] - x[None, :], y[some, None] - y[None, :])
    np.testing.assert_array_equal(found["nearby_component_area"].to_numpy()[some], np.where(d <= 50, area[None, :], 0).sum(1) - area[some])
    d[np.arange(len(some)), some] = np.inf
    np.testing.assert_allclose(found["nearest_component_distance"].to_numpy()[some], d.min(1), rtol=1e-12)
    middle = np.array([np.median(np.delete(area, k)) for k in some[:20]])
    np.testing.assert_allclose(found["area_over_median_neighbor"].to_numpy()[some[:20]], area[some[:20]] / middle)
