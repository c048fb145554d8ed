"""Queries against their SQL twins; TWINRASTER_ALL=1 runs every registered query."""
import os

import pytest

import check

SF = "/root/testdata/sf0.001"
SOME = ["a04_final_score", "r06_components", "v03_training_eligibility", "v06_provenance", "j01_temporal_pairs", "j08_duplicate_pairs", "a25_pair_features",
        "r20_valid_tiles", "v23_settings", "v23_setting_conflicts", "s06_mask_runs", "v07_unreadable_images", "a32_operating_points", "v14_review_outcomes",
        "v14_review_issues", "a31_image_fingerprints", "w05_rank_finalists", "r16_radiometric_match", "w12_epoch_draw", "w16_keep_threshold", "j05_footprint_pixels", "v11_polygon_cells", "s09_prediction_sink", "a29_sample_weights"]
# Queries without SQL are left to the tests of their operators.
NAMES = list(check.entry.oracle_sql()) if os.environ.get("TWINRASTER_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert check.compare(spark, duck, name, SF).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(check.entry.oracle_sql()) <= set(check.entry.queries())
