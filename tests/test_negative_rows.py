"""Synthetic no-change rows: shift and blur against a plain walk over the image; no copy of the pixels meets its neighbours in a join."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinraster.functions.scalars import hash_unit
from twinraster.operators import sampling as A

H, W, SEED = 5, 6, 3


@pytest.fixture(scope="module")
def images(spark):
    draw = np.random.default_rng(1)
    cells = [(i, y, x, *map(float, draw.integers(0, 256, 3))) for i in range(4) for y in range(H) for x in range(W) if i < 3 or (y + x) % 3]
    return spark.createDataFrame(cells, "id long, y int, x int, r double, g double, b double").cache()


def mirror(c, n):
    return -c if c < 0 else 2 * n - 2 - c if c >= n else c


def test_shift_and_blur_follow_the_image(spark, images):
    out = {(r.id, r.kind, r.y, r.x): r for r in A.negative_rows(images, ["slight_shift", "blur"], SEED, H, W).collect()}
    pixels = {(r.id, r.y, r.x): r for r in images.collect()}
    tags = spark.range(4).select("id", *[hash_unit(F.lit(SEED), F.col("id"), F.lit(k), F.lit(t)).alias(t) for k, t in (("slight_shift", "step"), ("blur", "sigma"))])
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a or b]
    seen = 0
    for r in tags.collect():
        dy, dx = steps[int(r.step * 24)]
        side = np.exp(-1 / (2 * (0.6 + 0.7 * r.sigma) ** 2))
        near, own = side / (1 + 2 * side), 1 / (1 + 2 * side)
        for (i, y, x), p in pixels.items():
            if i != r.id:
                continue
            source = pixels.get((i, mirror(y - dy, H), mirror(x - dx, W)))
            got = out.get((i, "slight_shift", y, x))
            assert (got is None) == (source is None)
            if source:
                assert (got.r, got.g, got.b) == (source.r, source.g, source.b)
                assert got.valid == (0 <= y - dy < H and 0 <= x - dx < W)
            taps = [(near ** (abs(a) + abs(b)) * own ** (2 - abs(a) - abs(b)), pixels.get((i, mirror(y + a, H), mirror(x + b, W)))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            got = out[i, "blur", y, x]
            assert (got.o_r, got.o_g, got.o_b) == (p.r, p.g, p.b)
            assert all(getattr(got, c) == np.rint(sum(w * getattr(t, c) for w, t in taps if t)) for c in "rgb")
            seen += 1
    assert seen == images.count()


def test_region_and_counts(images):
    rows = A.negative_rows(images, ["exact_no_change", "brightness", "shadows"], SEED, H, W, F.col("x") < 2)
    assert rows.filter("x >= 2 AND (r <> o_r OR g <> o_g OR b <> o_b)").count() == 0
    counts = {(r.id, r.kind): r.changed_pixels for r in A.changed_pixels(rows).collect()}
    assert len(counts) == 12 and all(counts[i, "exact_no_change"] == 0 and 0 < counts[i, "brightness"] <= 2 * H for i in range(4))


def test_pixels_meet_once(images):
    plan = A.changed_pixels(A.negative_rows(images, ["blur", "slight_shift", "shadows"], SEED, H, W))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Scan ExistingRDD")[0].split("InMemoryRelation")[0] and plan.count("Exchange hashpartitioning") == 2  # pixels, then counts
