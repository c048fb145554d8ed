"""A build whose rows are one group."""
import pytest
from pyspark.sql import functions as F

from twinraster.operators.chains import build_dataset
from twinraster.plans import manifest_queries as MQ


def test_rows_of_one_group_are_all_training_rows(spark, tmp_path):
    placed = MQ.placed(spark, "/root/testdata/sf0.001").withColumn("region_id", F.lit("r1"))
    with pytest.raises(ValueError):
        build_dataset(placed, MQ.GROUP_KEYS, str(tmp_path / "a"), fraction=0.2, seed=7)
    counts = {r.outcome: r["count"] for r in build_dataset(placed, MQ.GROUP_KEYS, str(tmp_path / "b"), fraction=0.2, seed=7, one_sided=True).collect()}
    assert set(counts) == {"train", "excluded"} and sum(counts.values()) == placed.count() and counts["train"] > 0
