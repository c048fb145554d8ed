import numpy as np
import pytest

from twinraster.operators.order_stats import order_stats, sort_groups

QUANTILES, TOPS = {"low": 0.0, "mid": 0.5, "high": 0.9, "last": 1.0}, {"top1": 0.01, "top5": 0.05, "all": 1.0}


def check(spark, values, partitions):
    rows = [(g, k, v) for g, vs in values.items() for k, v in enumerate(vs)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        frame = spark.createDataFrame(rows, "g string, k long, v double").repartition(5, "k")
        found = {r.g: r for r in order_stats(sort_groups(frame, ["g"], "v", ["k"]), ["g"], "v", QUANTILES, TOPS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {g: [v for v in vs if v is not None] for g, vs in values.items()}
    assert set(found) == {g for g, vs in want.items() if vs}
    for g, r in found.items():
        vs = np.sort(want[g])
        assert r.n == len(vs)
        for name, share in QUANTILES.items():
            assert r[name] == pytest.approx(np.quantile(vs, share), rel=1e-12, abs=1e-15)
        for name, share in TOPS.items():
            assert r[name] == pytest.approx(vs[len(vs) - int(np.ceil(share * len(vs))):].mean(), rel=1e-9)


def test_one_giant_group_among_small_ones(spark):
    """Three quarters of all rows lie in one group, which spans most partitions, a third of them with the same value."""
    rng = np.random.default_rng(4)
    giant = rng.random(30_000)
    giant[:10_000] = 0.5
    values = {"giant": giant.tolist(), None: rng.random(500).tolist(), "none": [None, None], "one": [0.25], "two": [0.5, None, 0.75]}
    values |= {f"small{k}": rng.random(int(rng.integers(1, 40))).tolist() for k in range(400)}
    check(spark, values, 16)


def test_more_partitions_than_rows_and_equal_values(spark):
    check(spark, {"a": [1.0] * 7, "b": [2.0, 1.0], "c": [3.0]}, 24)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "g string, k long, v double")
    assert order_stats(sort_groups(frame, ["g"], "v", ["k"]), ["g"], "v", QUANTILES, TOPS).collect() == []
