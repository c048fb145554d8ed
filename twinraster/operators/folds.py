"""Ordered folds over metric logs of any length."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordering import global_index


def _running_before(rows: DataFrame, better) -> DataFrame:
    """Adds ``_prior``: best value over all earlier steps of the run, for runs of any size.

    Rows get a global rank; blocks of consecutive ranks are summarised per run, the
    block summaries are scanned, and a short window finishes inside each block.
    """
    size = 8192
    ranked = cut(global_index(rows, F.col("run"), F.col("step"), name="_g")).withColumn("_block", F.floor(F.col("_g") / size))
    blocks = ranked.groupBy("run", "_block").agg(better("value").alias("_top"))
    scan = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("run", "_block", better("_top").over(scan).alias("_carry"))
    inner = Window.partitionBy("run", "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    pick = F.greatest if better is F.max else F.least
    # greatest/least skip NULLs, so a first block simply has no carry.
    return ranked.join(blocks, ["run", "_block"]).withColumn("_prior", pick("_carry", better("value").over(inner))).drop("_carry")


def best_so_far(log: DataFrame, mode: str = "max", min_delta: float = 0.0, patience: int = 5) -> DataFrame:
    """(run, step, value, improved, best, bad, stop) of an ordered metric log.

    A step improves when it beats the last accepted best by more than ``min_delta``.
    Only strict running records can improve. With a positive delta the accepted
    records form a chain: each record points at the next record beyond its value
    plus delta (found by binary search over the run's record order), and the chain
    from the first step is followed by pointer doubling, so neither long runs nor
    many records meet in one task.
    """
    better = F.max if mode == "max" else F.min
    sign = 1.0 if mode == "max" else -1.0
    prior = cut(_running_before(log.select("run", "step", "value"), better))
    record = F.col("_prior").isNull() | (sign * F.col("value") > sign * F.col("_prior"))
    if min_delta == 0:
        marked = prior.withColumn("improved", record)
    else:
        records = prior.filter(record).select("run", "step", (sign * F.col("value")).alias("v"))
        # Records rise with the step, so the successor is the first with v > own v + delta.
        probes = records.select("run", (F.col("v") + min_delta).alias("v"), F.lit(0).alias("kind"), F.col("step").alias("owner"))
        marks = records.select("run", "v", F.lit(1).alias("kind"), F.col("step").alias("owner"))
        order = global_index(probes.unionByName(marks), F.col("run"), F.col("v"), F.desc("kind"), F.col("owner"), name="_g")
        nxt = _next_mark(order)
        links = cut(nxt.select("run", F.col("owner").alias("step"), "next"))
        start = records.groupBy("run").agg(F.min("step").alias("step"))
        reached = start.withColumn("improved", F.lit(True))
        jump = links
        while True:
            more = reached.join(jump, ["run", "step"]).filter(F.col("next").isNotNull()).select("run", F.col("next").alias("step"), F.lit(True).alias("improved"))
            grown = cut(reached.unionByName(more).distinct())
            if grown.count() == reached.count():
                break
            reached = grown
            far = jump.select("run", F.col("step").alias("next"), F.col("next").alias("_far"))
            jump = cut(jump.join(far, ["run", "next"], "left").select("run", "step", F.col("_far").alias("next")))
        marked = prior.join(reached, ["run", "step"], "left").withColumn("improved", F.coalesce("improved", F.lit(False)))
    return _counters(marked, patience)


def _next_mark(order: DataFrame) -> DataFrame:
    """For every probe the first mark after it in the global order, within the run."""
    size = 8192
    t = order.withColumn("_block", F.floor(F.col("_g") / size)).withColumn("_m", F.when(F.col("kind") == 1, F.col("owner")))
    blocks = t.groupBy("run", "_block").agg(F.min_by("_m", F.when(F.col("_m").isNotNull(), F.col("_g"))).alias("_first"))
    ahead = Window.partitionBy("run").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select("run", "_block", F.first("_first", ignorenulls=True).over(ahead).alias("_carry"))
    inner = Window.partitionBy("run", "_block").orderBy("_g").rowsBetween(1, Window.unboundedFollowing)
    return t.join(blocks, ["run", "_block"]).withColumn("next", F.coalesce(F.first("_m", ignorenulls=True).over(inner), "_carry")).filter("kind = 0")


def _counters(marked: DataFrame, patience: int) -> DataFrame:
    """Last accepted value and steps since then, by the same block scan."""
    t = marked.withColumn("_a", F.when(F.col("improved"), F.struct("_g", "value")))
    blocks = t.groupBy("run", "_block").agg(F.max("_a").alias("_last"))
    scan = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("run", "_block", F.max("_last").over(scan).alias("_carry"))
    inner = Window.partitionBy("run", "_block").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    last = F.greatest(F.max("_a").over(inner), F.col("_carry"))
    t = t.join(blocks, ["run", "_block"]).withColumn("_l", last)
    bad = F.col("_g") - F.col("_l._g")
    return t.select("run", "step", "value", "improved", F.col("_l.value").alias("best"), bad.alias("bad"), (bad >= patience).alias("stop"))
