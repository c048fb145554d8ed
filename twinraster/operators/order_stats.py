"""Exact order statistics of groups of any size: quantiles and means of top shares from one range-partitioned sort.

Rows are sorted by group and value over all partitions, so a group lies in neighbouring partitions and a giant one is spread over many.
Only the first and the last group of a partition can reach beyond it: at most two rows per partition say where such a group's part begins
and how large the group is. With that, each partition finds the values it holds at the ranks asked for, and the parts are added up.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut


def sort_groups(rows: DataFrame, group: list[str], value: str, tie: list[str] = ()) -> DataFrame:
    """(group, value, _part): rows with a value, sorted over all partitions and written once. ``tie`` names columns that tell equal values of a
    group apart, so that a value that fills a group is split like others."""
    order = [*group, value, *tie]
    placed = rows.select(*order).filter(F.col(value).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*group, value)
    return cut(placed.select(*group, F.col(value).cast("double").alias(value), F.spark_partition_id().alias("_part")))


def _reaching(ordered: DataFrame, group: list[str]) -> dict[tuple, tuple[int, int]]:
    """{(partition, whether its last group): (rows of that group before, rows in all)} for groups that lie in several partitions; at
    most two entries per partition."""
    key = F.struct(*group)
    ends = ordered.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts = ordered.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ends), "_part").filter(key.eqNullSafe(F.col("first")) | key.eqNullSafe(F.col("last")))
    found = sorted(parts.select("_part", key.alias("g"), "n", key.eqNullSafe(F.col("first")).alias("at_start"), key.eqNullSafe(F.col("last")).alias("at_end")).collect(), key=lambda r: r["_part"])
    total: dict = {}
    for r in found:
        total[r["g"]] = total.get(r["g"], 0) + r["n"]
    seen: dict = {}
    out = {}
    for r in found:
        before = seen.get(r["g"], 0)
        seen[r["g"]] = before + r["n"]
        for end in (False, True):
            if r["at_end"] if end else r["at_start"]:
                out[r["_part"], end] = before, total[r["g"]]
    return out


def order_stats(ordered: DataFrame, group: list[str], value: str, quantiles: dict[str, float] = {}, top_means: dict[str, float] = {}) -> DataFrame:
    """One row per group of ``sort_groups``: ``n``, quantiles with linear interpolation by name, and by name the mean of the
    ceil(share * n) largest values."""
    reaching = _reaching(ordered, group)

    def run(batches):
        batches = list(batches)  # one partition of the sort
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        v = table[value].to_numpy()
        new = np.ones(len(v), dtype=bool)
        new[1:] = False
        for g in group:
            column = table[g].combine_chunks()
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        count = np.diff(start, append=len(v))
        skip, total = np.zeros(len(start), dtype=np.int64), count.copy()
        part = table["_part"][0].as_py()
        for end, at in ((False, 0), (True, -1)):
            skip[at], total[at] = reaching.get((part, end), (skip[at], total[at]))
        out = table.select(group).take(pa.array(start)).append_column("n", pa.array(count))
        for name, share in quantiles.items():
            spot = share * (total - 1)
            low = np.floor(spot).astype(np.int64)
            part_of = np.zeros(len(start))
            for rank, weight in ((low, 1 - (spot - low)), (low + 1, spot - low)):
                mine = np.flatnonzero((rank >= skip) & (rank < skip + count) & (weight > 0))
                part_of[mine] += v[start[mine] + rank[mine] - skip[mine]] * weight[mine]
            out = out.append_column(name, pa.array(part_of))
        if top_means:
            upto = np.concatenate([[0.0], np.cumsum(v)])
            for name, share in top_means.items():
                first = np.clip(total - np.ceil(share * total).astype(np.int64) - skip, 0, count)
                out = out.append_column(name, pa.array(upto[start + count] - upto[start + first]))
        yield from out.to_batches()

    names = [*quantiles, *top_means]
    schema = T.StructType([ordered.schema[g] for g in group] + [T.StructField("n", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in names])
    parts = ordered.mapInArrow(run, schema).groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    return parts.select(*group, "n", *quantiles, *[(F.col(n) / F.ceil(F.lit(share) * F.col("n"))).alias(n) for n, share in top_means.items()])
