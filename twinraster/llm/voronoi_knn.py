"""Exact top-k inner products as a Voronoi kNN join.

An inner product is a distance in disguise: with M the largest norm, a candidate c gets one more component
sqrt(M^2 - |c|^2) and a query q the component 0; then |q - c|^2 = |q|^2 + M^2 - 2 q.c, and the nearest candidates are those of
largest product. In that space candidates are grouped by their nearest pivot. Each group's summary (rows, farthest row, the
k + 1 smallest distances to the pivot) bounds every query's k-th distance from above and every group's distance from below, so
a query goes only to groups that can hold one of its k. Groups are cut into blocks of bounded size, and each block answers
its queries locally with one matrix product in integers.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Pivots (their vectors are what is broadcast), candidates per block and queries per block.
PIVOTS, BLOCK_ROWS, BLOCK_QUERIES = 48, 8192, 4096
#: Relative slack on bounds, above rounding errors: a distance near 0 is the root of a difference of squares in doubles.
SLACK = 1e-6


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256, *more: str) -> DataFrame:
    """(id, v array of long, norm2, more columns): floor(scale * x) of each component. Rows with a null vector or component, or one that
    isn't finite, take no part; all others do, whether their id is null or comes again."""
    x = F.col(vector_col)
    usable = x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("bigint"))
    rows = vectors.filter(usable).select(F.col(id_col).alias("id"), v.alias("v"), *more)
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of an array column as doubles, short rows filled with zeros."""
    out = np.zeros((len(column), width))
    for row, values in zip(out, column):
        row[: len(values)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where no sum can pass 2^53, else in 64-bit integers."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a @ b.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ b.T.astype(np.int64)


def best_products(candidates: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score): for each query row the ``k`` candidates of largest integer inner product, ties to the
    smaller id (null last), the query's own row left out. Both inputs are (id, v, norm2) of ``scaled`` with ``row``, a number of their own for every
    row, the same in both; they should be written tables, as they are read several times.

    Defined cases: an id that comes again is another candidate, and another query; fewer candidates than ``k`` give as many rows; shorter vectors count as filled with zeros; components
    should stay below 2^28 in size so that a product of 64 of them fits a long; no candidate or no query gives no rows.
    """
    spark = candidates.sparkSession
    size = candidates.agg(F.max(F.size("v")).alias("width"), F.max("norm2").alias("norm2")).first()
    wide = queries.agg(F.max(F.size("v")).alias("width")).first()["width"]
    empty = "query_id bigint, rank int, id bigint, score bigint"
    if size["width"] is None or wide is None:
        return spark.createDataFrame([], empty)
    width, top = max(size["width"], wide), float(size["norm2"])
    chosen = candidates.orderBy(F.xxhash64("row"), "row").limit(pivots).collect()
    lifted = np.unique(np.column_stack([_matrix([r.v for r in chosen], width), [np.sqrt(max(0.0, top - r.norm2)) for r in chosen]]), axis=0)
    shared = spark.sparkContext.broadcast(lifted)
    slack = SLACK * (1.0 + np.sqrt(top))

    def distances(v: np.ndarray, lift: np.ndarray) -> np.ndarray:
        x = np.column_stack([v, lift])
        p = shared.value
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T, 0.0))

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = _matrix(part.column(2).to_numpy(zero_copy_only=False), width)
                d = distances(v, np.sqrt(np.maximum(top - part.column(3).to_numpy(), 0.0)))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["row", "id", "v", "cell", "far"])

    placed = stored(candidates.select("row", "id", "v", "norm2").mapInArrow(assign, "row bigint, id bigint, v array<bigint>, cell int, far double"), "voronoi")

    # summaries: a row or k + 1 per pivot
    nearest = (
        placed.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far", "row")).alias("r")).filter(F.col("r") <= k + 1)
        .groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near")))
    summary = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(nearest, "cell").collect()}
    cells = sorted(summary)
    radius = np.array([summary[c].radius for c in cells])
    near = np.full((len(cells), k + 1), np.inf)
    for row, c in zip(near, cells):
        row[: len(summary[c].near)] = summary[c].near
    parts = np.array([-(-summary[c].n // BLOCK_ROWS) for c in cells])

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = _matrix(part.column(2).to_numpy(zero_copy_only=False), width)
                d = distances(v, np.zeros(len(v)))[:, cells]
                upper = np.sort((d[:, :, None] + near[None]).reshape(len(d), -1), axis=1)[:, k]  # one of k + 1 may be itself
                wanted = d - radius[None, :] <= upper[:, None] + slack
                row, cell = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(row)) for k in range(3)), pa.array(np.array(cells, dtype=np.int32)[cell])], names=["row", "id", "v", "cell"])

    routed = stored(queries.select("row", "id", "v").mapInArrow(route, "row bigint, id bigint, v array<bigint>, cell int"), "voronoi-queries")
    asked = {r.cell: -(-r.n // BLOCK_QUERIES) for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame([(int(c), int(p), int(asked.get(c, 0))) for c, p in zip(cells, parts)], "cell int, parts int, asked int")
    plan = F.broadcast(plan.filter("asked > 0"))  # a row per pivot
    left = (
        placed.join(plan, "cell")
        .select("row", F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), "v", "cell", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("turn")))
    right = (
        routed.join(plan, "cell")
        .select("row", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("row"), "asked").cast("int").alias("turn")))

    def solve(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asks):
            held = held.sort_values(["unnamed", "id"], kind="stable")
            rows, matrix = held["row"].to_numpy(), _matrix(held["v"], width)
            for at in range(0, len(asks), 256):
                some = asks.iloc[at: at + 256]
                scores = _products(_matrix(some["v"], width), matrix)
                for query, row in zip(some["row"].to_numpy(), scores):
                    most = min(len(row), k + 1)
                    least = np.partition(row, len(row) - most)[len(row) - most]
                    found = np.flatnonzero(row >= least)
                    found = found[rows[found] != query]
                    found = found[np.argsort(-row[found], kind="stable")][:k]  # ids ascend, so ties keep the smaller
                    out.append((np.full(len(found), query), found, row[found]))
        query, found, score = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        names = held.iloc[found]
        return pd.DataFrame({"query": query, "unnamed": names["unnamed"].to_numpy(dtype=bool), "id": names["id"].to_numpy(dtype=np.int64), "score": score})

    keys = ["cell", "part", "turn"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query bigint, unnamed boolean, id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "unnamed", "id")
    best = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(named, "query").select("query_id", F.col("rank").cast("int"), F.when(~F.col("unnamed"), F.col("id")).alias("id"), "score")


def top_products(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, pivots: int = PIVOTS,
) -> DataFrame:
    """``best_products`` of the rows of ``vectors`` where ``is_query`` (a condition on ``id_col``) holds, against all rows."""
    marked = vectors.select(F.col(id_col).cast("bigint").alias(id_col), vector_col).withColumn("asks", is_query)
    rows = stored(scaled(marked, id_col, vector_col, scale, "asks").withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbered once, then read
    return best_products(rows, rows.filter("asks"), k, pivots)
