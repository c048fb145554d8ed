"""A table of computed features that later runs read back, keyed by everything that the features depend on."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import reject_any
from .runs import TILE

# Fixed value: the layout of cached rows; another layout is refused.
CACHE_VERSION = 2
#: What names a component, apart from what it looks like and how it is measured.
IDENTITY = [*TILE, "component_id"]


def content_fingerprint(content: Column, *shape) -> Column:
    """SHA-256 of a shape (sizes and type, as text) followed by the bytes of an image or mask."""
    head = F.concat_ws("x", *[s if isinstance(s, Column) else F.lit(str(s)) for s in shape])
    return F.sha2(F.concat(F.encode(F.concat(head, F.lit("|")), "utf-8"), content.cast("binary")), 256)


def mask_fingerprints(runs: DataFrame, height: int, width: int, keys: list[str] = IDENTITY) -> DataFrame:
    """(keys, mask_fingerprint, bbox): one fingerprint per mask, given as maximal runs, whatever their order, and its box (y0, x0, y1, x1).

    Runs of a mask are distinct, so two independent hashes of them, combined by exclusive or before any exchange, stand for their set.
    """
    one, two = F.xxhash64("y", "x0", "x1"), F.xxhash64(F.lit(width), "x1", "y", "x0")
    parts = runs.groupBy(*keys).agg(
        F.bit_xor(one).alias("_a"), F.bit_xor(two).alias("_b"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("x1") - F.col("x0")).alias("_s"),
        F.array(F.min("y"), F.min("x0"), F.max("y") + 1, F.max("x1")).cast("array<int>").alias("bbox"))
    text = F.concat_ws("|", F.lit(f"{height}x{width}"), "_n", "_s", "_a", "_b")
    return parts.select(*keys, F.sha2(text, 256).alias("mask_fingerprint"), "bbox")


def cache_keys(rows: DataFrame, model_fingerprint: str, config_fingerprint: str, scales: list[int] = (0,)) -> DataFrame:
    """``rows`` (identity, bbox, mask_fingerprint, pair_fingerprint) with ``cache_key``. Empty fingerprints are refused, of pairs when the job runs."""
    if not model_fingerprint or not config_fingerprint:
        raise ValueError("model and config fingerprints must not be empty")
    named = F.when(F.length("pair_fingerprint") > 0, F.col("pair_fingerprint"))
    named = F.coalesce(named, F.raise_error(F.lit("pair fingerprints must not be empty")).cast("string"))
    parts = F.to_json(F.struct(*IDENTITY, "bbox", "mask_fingerprint", F.array(*map(F.lit, scales)).alias("scales"), F.lit(config_fingerprint).alias("config"),
                               F.lit(model_fingerprint).alias("model"), named.alias("pair")))
    return rows.withColumn("cache_key", F.sha2(parts, 256))


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def cached_features(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], names: list[str], path: str, buckets: int = 64) -> DataFrame:
    """``rows`` of ``cache_keys`` with features ``names`` and ``state``: hit (read from the table at ``path``), stale (the component is there, but for
    another mask, box, configuration, model or image) or miss.

    Only stale rows and misses go to ``compute``, each key once; it returns ``cache_key`` and the features. They are appended to the table, one
    folder per bucket of keys, in one commit, and read back. Missing and non-finite features are refused, and so is a table of another version.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    held = _held(spark, path)
    if held is None:
        asked = rows.withColumn("state", F.lit("miss"))
        todo = rows
    else:
        reject_any(held.filter(F.col("version") != CACHE_VERSION).select("version", "cache_key"), "the cache has another version")
        known = held.select("bucket", "cache_key", F.lit("hit").alias("_hit"))
        seen = held.select(*IDENTITY).distinct().withColumn("_seen", F.lit(True))
        asked = rows.join(known, ["bucket", "cache_key"], "left").join(seen, IDENTITY, "left").withColumn(
            "state", F.coalesce("_hit", F.when(F.col("_seen"), "stale").otherwise("miss"))).drop("_hit", "_seen")
        todo = rows.join(known, ["bucket", "cache_key"], "left_anti")
    todo = todo.dropDuplicates(["cache_key"])
    asked_file = scratch_path(spark, "cache-asked")
    asked.write.parquet(asked_file)  # states are those before the table grows
    asked = spark.read.schema(asked.schema).parquet(asked_file)
    found = compute(todo).select("cache_key", *[F.col(n).cast("double").alias(n) for n in names])
    sound = F.lit(True)
    for n in names:
        sound = sound & F.coalesce(~F.isnan(n) & (F.abs(n) != float("inf")), F.lit(False))
    checked = [F.when(sound, F.col(n)).otherwise(F.raise_error(F.lit("cached features must be finite")).cast("double")).alias(n) for n in names]
    new = todo.select("bucket", "cache_key", *IDENTITY).join(found.select("cache_key", *checked), "cache_key", "left")
    whole = F.when(F.col(names[0]).isNull(), F.raise_error(F.lit("features are missing for a key")).cast("int")).otherwise(F.lit(CACHE_VERSION))
    new.withColumn("version", whole).select("version", "cache_key", *IDENTITY, *names, "bucket").write.partitionBy("bucket").mode("append").parquet(path)
    return asked.join(spark.read.parquet(path).select("bucket", "cache_key", *names), ["bucket", "cache_key"]).drop("bucket")
