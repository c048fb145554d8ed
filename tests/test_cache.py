import pytest
from pyspark.sql import functions as F

from twinraster.operators import cache as C


def labelled(spark, cut_off=None):
    rows = [(1, "new_building", 10, 0, 2, 6), (1, "new_building", 10, 1, 2, 6 if cut_off is None else cut_off), (1, "tree_removal", 3, 5, 0, 9), (2, "new_building", 0, 0, 0, 3)]
    return spark.createDataFrame(rows, "pair_id long, class_name string, component_id long, y int, x0 int, x1 int")


def run(spark, path, runs, model="m", config="c", pair="p", counter=None, value=1.0):
    keyed = C.cache_keys(C.mask_fingerprints(runs, 16, 16).withColumn("pair_fingerprint", F.lit(pair)), model, config, [0, 1])

    def compute(todo):
        if counter is not None:
            counter.append(todo.count())
        return todo.select("cache_key", F.lit(value).alias("f"), F.col("component_id").cast("double").alias("g"))

    found = C.cached_features(keyed, compute, ["f", "g"], path, buckets=4).collect()
    return {(r.pair_id, r.class_name): (r.state, r.f, r.g) for r in found}


def test_second_run_computes_nothing_and_altered_masks_are_computed_again(spark, tmp_path):
    path, counter = f"{tmp_path}/cache", []
    first = run(spark, path, labelled(spark), counter=counter)
    assert {v[0] for v in first.values()} == {"miss"} and counter == [3]
    again = run(spark, path, labelled(spark), counter=counter, value=9.0)
    assert again == {k: ("hit", 1.0, v[2]) for k, v in first.items()} and counter == [3, 0]
    altered = run(spark, path, labelled(spark, cut_off=5), counter=counter, value=2.0)
    assert altered == first | {k: ("hit", 1.0, v[2]) for k, v in first.items()} | {(1, "new_building"): ("stale", 2.0, 10.0)} and counter[-1] == 1
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("change", [{"model": "other"}, {"config": "other"}, {"pair": "other"}])
def test_every_fingerprint_counts(spark, tmp_path, change):
    path = f"{tmp_path}/cache"
    run(spark, path, labelled(spark))
    assert {v[:2] for v in run(spark, path, labelled(spark), value=3.0, **change).values()} == {("stale", 3.0)}
    assert {v[:2] for v in run(spark, path, labelled(spark)).values()} == {("hit", 1.0)}


def test_bad_fingerprints_features_and_versions_are_refused(spark, tmp_path):
    for change in ({"model": ""}, {"config": ""}):
        with pytest.raises(ValueError, match="fingerprint"):
            run(spark, f"{tmp_path}/a", labelled(spark), **change)
    with pytest.raises(Exception, match="pair fingerprints"):
        run(spark, f"{tmp_path}/b", labelled(spark), pair="")
    with pytest.raises(Exception, match="finite"):
        run(spark, f"{tmp_path}/c", labelled(spark), value=float("nan"))
    run(spark, f"{tmp_path}/d", labelled(spark))
    old = spark.read.parquet(f"{tmp_path}/d").withColumn("version", F.lit(1))
    old.write.partitionBy("bucket").parquet(f"{tmp_path}/e")
    with pytest.raises(Exception, match="version"):
        run(spark, f"{tmp_path}/e", labelled(spark))


def test_fingerprints_follow_the_mask_only(spark):
    prints = lambda runs, *size: {(r.pair_id, r.class_name): (r.mask_fingerprint, r.bbox) for r in C.mask_fingerprints(runs, *size).collect()}
    one = prints(labelled(spark), 16, 16)
    assert one == prints(labelled(spark).repartition(7), 16, 16)
    assert one[1, "new_building"][1] == [0, 2, 2, 6]
    assert one[1, "new_building"] != prints(labelled(spark, cut_off=5), 16, 16)[1, "new_building"]
    assert one[1, "new_building"][0] != prints(labelled(spark), 16, 32)[1, "new_building"][0]
