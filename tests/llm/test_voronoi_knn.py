import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinraster.llm import voronoi_knn as V


def brute(rows, k, every):
    """Every row is a candidate, and a query if its id says so; only the query's own row is left out."""
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, w) in enumerate(usable):
        if q is not None and q % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(w, v)), c is None, c or 0) for m, (c, v) in enumerate(usable) if m != n)[:k]
            out += [(q, r, None if none else c, -s) for r, (s, none, c) in enumerate(ranked, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["clusters", "copies", "mixed"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(len(kind))
    if kind == "clusters":
        centres = rng.normal(0, 5, (6, 12))
        vectors = centres[rng.integers(0, 6, 400)] + rng.normal(0, .1, (400, 12))
    elif kind == "copies":
        vectors = np.repeat(rng.normal(0, 1, (5, 8)), [200, 50, 3, 1, 40], axis=0)
    else:
        vectors = rng.normal(0, 1, (300, 6)) * rng.exponential(3, (300, 1))
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    if kind == "mixed":
        rows += [(1000, None), (1001, [None, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6),
                 (1004, []), (1005, [9.0, 9.0]), (1010, [0.0] * 6), rows[0], rows[1]] + [(20, [50.0 - i] * 6) for i in range(9)] + [(21, [40.0] * 6)] * 9
    docs = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, cell int").repartition(4)
    found = V.top_products(docs, F.col("vec_id") % 10 == 0, pivots=7)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    none = V.top_products(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0)
    assert none.collect() == [] and none.columns == ["query_id", "rank", "id", "score"]
    assert V.top_products(spark.createDataFrame([(10, [1.0])], schema), F.col("vec_id") % 10 == 0).collect() == []
    two = V.top_products(spark.createDataFrame([(10, [1.0]), (3, [-2.0])], schema), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in two] == [(10, 1, 3, -256 * 512)]


def test_repeated_and_null_ids_are_candidates(spark):
    rows = [(50, [1.0]), (1, [2.0]), (1, [9.0]), (2, [3.0]), (None, [4.0]), (50, [5.0])]
    found = V.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    one = [(50, 1, 1, 589824), (50, 2, 50, 327680), (50, 3, None, 262144), (50, 4, 2, 196608), (50, 5, 1, 131072)]
    five = [(50, 1, 1, 2949120), (50, 2, None, 1310720), (50, 3, 2, 983040), (50, 4, 1, 655360), (50, 5, 50, 327680)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(one + five, key=str)
