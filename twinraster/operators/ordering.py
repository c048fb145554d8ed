"""Global order without a single-task window: exact ranks and prefix sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# monotonically_increasing_id keeps the partition number above bit 33.
_PARTITION_SHIFT = 33


def global_index(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Dense 0-based rank of every row in a total order.

    One range-partitioned sort, one checkpoint, and a table of per-partition
    counts (one row per partition) that is broadcast. A hot value is spread over
    partitions because the order columns include a unique tie-break.
    """
    tagged = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _PARTITION_SHIFT)
    local = F.col("_mid") - F.shiftleft(part, _PARTITION_SHIFT)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"),
    )
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_base") + local).cast("long"))
        .drop("_mid", "_part", "_base")
    )


def prefix_sum(df: DataFrame, value: str, *order: Column, name: str = "before") -> DataFrame:
    """Sum of ``value`` over all earlier rows of a total order (exclusive)."""
    tagged = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright(F.col("_mid"), _PARTITION_SHIFT))
    totals = tagged.groupBy("_part").agg(F.sum(value).alias("_n"))
    offsets = totals.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"),
    )
    inner = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.sum(value).over(inner) - F.col(value))
        .drop("_mid", "_part", "_base")
    )


def previous_in_group(df: DataFrame, group: list[str], order: Column, carry: str, name: str) -> DataFrame:
    """``lag`` over a group of any size: rank globally, then join each rank to the one before."""
    ranked = global_index(df, *[F.col(g) for g in group], order, name="_g")
    before = ranked.select((F.col("_g") + 1).alias("_g"), *[F.col(g).alias(f"_p_{g}") for g in group], F.col(carry).alias(name))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_p_{g}"))
    return (
        ranked.join(before, "_g", "left")
        .withColumn(name, F.when(same, F.col(name)))
        .drop("_g", *[f"_p_{g}" for g in group])
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; Spark prunes each input partition to ``n`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).withColumnRenamed("_rank", "rank")


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, quantile) with linear interpolation, for a column of any size.

    The column is ranked globally; only the two neighbours of each asked-for
    position are kept, so no task holds the whole column.
    """
    ranked = global_index(df.select(F.col(value).alias("v")).filter(F.col("v").isNotNull()), F.col("v"), name="_g")
    last = ranked.agg(F.max("_g").alias("last")).first()["last"]
    if last is None:
        return df.sparkSession.createDataFrame([], "share double, quantile double")
    spots = []
    for s in shares:
        at = s * last
        low = int(at)
        spots += [(s, low, 1 - (at - low))] + ([(s, low + 1, at - low)] if at > low else [])
    asked = F.explode(F.filter(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(g).alias("g"), F.lit(float(w)).alias("w")) for s, g, w in spots]), lambda a: a["g"] == F.col("_g")))
    wanted = ranked.filter(F.col("_g").isin([g for _, g, _ in spots])).select("v", asked.alias("a"))
    return wanted.groupBy(F.col("a.share").alias("share")).agg(F.sum(F.col("v") * F.col("a.w")).alias("quantile"))
