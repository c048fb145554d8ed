import numpy as np
import pytest

from twinraster.operators import geo as G
from twinraster.operators.settings import LAYER, resolve_settings, setting_conflicts

SCHEMA = f"id int, common {LAYER}, classes map<string, {LAYER}>, direct map<string, {LAYER}>"


def resolved(spark, common, classes=None, direct=None):
    rows = spark.createDataFrame([(1, common, classes, direct)], SCHEMA)
    return {r.class_name: (r.settings, r.morphology) for r in resolve_settings(rows, "common", "classes", "direct").collect()}


def test_alias_and_direct_override_conflicts(spark):
    found = resolved(spark, ({"min_component_area": 0.0}, None), None, {
        "new_building": ({"threshold": 0.99, "min_area": 1000.0, "min_component_area": 0.0, "simplification_tolerance": 0.0}, {"opening": 0.0}),
        "tree_removal": ({"threshold": 0.99, "min_positive_total_area": 1000.0}, None)})
    assert found["new_building"] == ({"threshold": 0.99, "min_area": 1000.0, "simplify_px": 0.0}, {"opening": 0.0})
    assert found["tree_removal"] == ({"threshold": 0.99, "min_area": 0.0, "min_pos_area": 1000.0}, {})


def test_morphology_is_inherited_key_by_key(spark):
    found = resolved(spark, ({"opening": 1.0, "closing": 2.0}, {"closing": 5.0}), {"new_building": ({"dilation": 1.0}, {"opening": 3.0})}, {"tree_removal": (None, {"fill_holes": 1.0})})
    assert found["new_building"][1] == {"opening": 3.0, "closing": 5.0, "dilation": 1.0}
    assert found["tree_removal"][1] == {"opening": 1.0, "closing": 5.0, "fill_holes": 1.0}


def test_thresholds_fall_back_to_the_class_then_to_a_half(spark):
    assert {c: s["threshold"] for c, (s, _) in resolved(spark, None).items()} == {"new_building": 0.5, "tree_removal": 0.5}
    found = resolved(spark, ({"building_threshold": 0.7}, None), {"tree_removal": ({"tree_threshold": 0.2}, None)})
    assert {c: s["threshold"] for c, (s, _) in found.items()} == {"new_building": 0.7, "tree_removal": 0.2}


def test_conflicts_name_layer_and_values(spark):
    rows = spark.createDataFrame([(1, ({"min_area": 4.0, "min_component_area": 4.0, "min_total_area": 1.0, "min_positive_total_area": 2.0}, None),
                                   {"new_building": ({"opening": 1.0}, {"opening": 2.0})}, None), (2, None, None, None)], SCHEMA)
    found = sorted(map(tuple, setting_conflicts(rows, "common", "classes", "direct").collect()))
    assert found == [(1, "classes.new_building", "opening", "opening", 2.0, 1.0), (1, "common", "min_pos_area", "min_total_area", 2.0, 1.0)]


@pytest.mark.parametrize("min_valid,want", [(0.8, 1), (0.9, 0), (0.0, 1)])
def test_valid_share_of_a_tile(spark, min_valid, want):
    """A 32-pixel tile whose first four columns are invalid in both rasters."""
    grid = spark.createDataFrame([(1, 32, 32)], "id long, width int, height int")
    runs = spark.createDataFrame([(1, y, 4, 32) for y in range(32)], "id long, y int, x0 int, x1 int")
    found = G.valid_tiles(G.grid_tiles(grid, 32), [runs, runs], 32, min_valid).collect()
    assert len(found) == want and all(r.valid_fraction == 0.875 for r in found)


def test_valid_shares_equal_pixel_counts(spark):
    rng = np.random.default_rng(2)
    masks = rng.random((2, 40, 56)) < 0.9
    grid = spark.createDataFrame([(7, 56, 40)], "id long, width int, height int")
    runs = [spark.createDataFrame([(7, int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(m))], "id long, y int, x0 int, x1 int") for m in masks]
    found = {(r.row, r.col): r.valid_fraction for r in G.valid_tiles(G.grid_tiles(grid, 16), runs, 16, 0.5).collect()}
    both = masks.all(0)
    want = {(y, x): both[y:y + 16, x:x + 16].mean() for y in (0, 16) for x in (0, 16, 32)}
    assert found == {k: v for k, v in want.items() if v >= 0.5}


def test_area_of_interest_narrows_the_grid(spark):
    rows = [(1, 0.0, 0.0, 100.0, 100.0, 0.0, 0.0, 100.0, 100.0, 10.2, None, 60.0, None), (2, 0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0, 20.0, None, None, None)]
    names = [f"{b}_{s}" for b in ("a", "b", "aoi") for s in "wsen"]
    found = G.common_grid(spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), 1.0).collect()
    assert [(r.id, r.west, r.south, r.east, r.north, r.width, r.height) for r in found] == [(1, 11.0, 0.0, 60.0, 100.0, 49, 100)]
