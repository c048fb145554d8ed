import pytest

from twinraster.operators import graph as G

BOXES = [("a", "ra", 500000.0, 4300000.0, 500010.0, 4300010.0, "EPSG:32618"), ("b", "rb", 500010.0, 4300000.0, 500020.0, 4300010.0, "EPSG:32618"),
         ("c", "rc", 500022.0, 4300000.0, 500032.0, 4300010.0, "EPSG:32618"), ("d", "rd", 500000.0, 4300000.0, 500010.0, 4300010.0, "EPSG:32619")]
SCHEMA = "id string, region_id string, w double, s double, e double, n double, crs string"


def groups(rows, **options):
    return {r.id: r.group_id for r in G.geographic_groups(rows, **options).collect()}


def test_shared_files_and_families_chain_rows_of_other_regions(spark):
    rows = spark.createDataFrame([("a", "a", None, "shared.tif", None), ("b", "b", "shared.tif", None, "family"), ("c", "c", None, "", "family"), ("d", "d", None, "", None)],
                                 "id string, region_id string, pre string, post string, parent_id string")
    assert groups(rows) == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_touching_and_buffered_boxes_group_across_regions(spark):
    rows = spark.createDataFrame(BOXES, SCHEMA)
    assert groups(rows) == {"a": "a", "b": "a", "c": "c", "d": "d"}  # d lies in another coordinate system
    assert groups(rows, buffer=3.0) == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_rows_of_one_state_share_a_group(spark):
    rows = spark.createDataFrame([("a", "r1", "x"), ("b", "r2", "x"), ("c", "r3", "y")], "id string, region_id string, state string")
    assert groups(rows) == {"a": "a", "b": "b", "c": "c"}
    assert groups(rows, strategy="state") == {"a": "a", "b": "a", "c": "c"}


def test_empty_boxes_count_as_none(spark):
    rows = spark.createDataFrame([("a", "r1", None, None, None, None, None), ("b", "r1", None, None, None, None, None)], SCHEMA)
    assert groups(rows) == {"a": "a", "b": "a"}


@pytest.mark.parametrize("rows,schema,options,match", [
    ([("a", None)], "id string, region_id string", {}, "region_id"),
    ([("a",)], "id string", {}, "region_id"),
    ([("a", "r", " ")], "id string, region_id string, state string", {"strategy": "state"}, "state"),
    ([("a", "r")], "id string, region_id string", {"buffer": 1.0}, "bounds"),
    ([BOXES[0], ("x", "r", None, None, None, None, None)], SCHEMA, {}, "all rows"),
    ([(*BOXES[0][:6], None)], SCHEMA, {}, "all rows"),
])
def test_unsafe_rows_are_refused(spark, rows, schema, options, match):
    with pytest.raises(ValueError, match=match):
        G.geographic_groups(spark.createDataFrame(rows, schema), **options)
