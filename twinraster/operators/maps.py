"""Probability map and image arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp

# Channel means and spreads of the input normalisation.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}
VIEWS = ["identity", "hflip", "vflip", "rot180"]


def flip(maps: DataFrame, view: Column, height: int, width: int) -> DataFrame:
    """Move pixels to the flipped frame; every supported flip is its own inverse."""
    x = F.when(view.isin("hflip", "rot180"), width - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(view.isin("vflip", "rot180"), height - 1 - F.col("y")).otherwise(F.col("y"))
    return maps.withColumns({"x": x, "y": y})


def flip_views(maps: DataFrame, height: int, width: int) -> DataFrame:
    """Four copies of a map, one per view, in the flipped frame."""
    return flip(maps.withColumn("view", F.explode(F.array(*[F.lit(v) for v in VIEWS]))), F.col("view"), height, width)


def average_views(views: DataFrame, keys: list[str] = ("pair_id", "class_name")) -> DataFrame:
    return views.groupBy(*keys, "y", "x").agg(F.avg("p").alias("p"))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    powers = [F.exp(z - top) for z in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def _channels():
    return [(side, c) for side in ("pre", "post") for c in "rgb"]


def normalise(pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """(value/scale - mean) / std per channel; ``scale`` is 255 for byte images."""
    return pairs.withColumns({f"{s}_{c}": (F.col(f"{s}_{c}") / scale - CHANNEL_MEAN[c]) / CHANNEL_STD[c] for s, c in _channels()})


def denormalise(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({f"{s}_{c}": clamp(F.col(f"{s}_{c}") * CHANNEL_STD[c] + CHANNEL_MEAN[c], 0, 1) for s, c in _channels()})


def reverse_time(pairs: DataFrame) -> DataFrame:
    """Swap the earlier and the later image."""
    return pairs.withColumns({f"{s}_{c}": F.col(f"{'post' if s == 'pre' else 'pre'}_{c}") for s, c in _channels()})


def blend(a: DataFrame, b: DataFrame, weight: float, keys: list[str]) -> DataFrame:
    """weight*a + (1-weight)*b on equal keys."""
    left, right = a.select(*keys, F.col("p").alias("_a")), b.select(*keys, F.col("p").alias("_b"))
    return left.join(right, keys).select(*keys, (weight * F.col("_a") + (1 - weight) * F.col("_b")).alias("p"))


def invalid_probabilities(maps: DataFrame, keys: list[str], softmax_tolerance: float | None = None) -> DataFrame:
    """(keys, reason): non-finite or out-of-range values, and pixels whose classes do not sum to one."""
    p = F.col("p")
    bad = maps.filter(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).select(*keys, F.lit("outside [0,1]").alias("reason"))
    if softmax_tolerance is None:
        return bad
    sums = maps.groupBy(*keys).agg(F.sum("p").alias("_s")).filter(F.abs(F.col("_s") - 1) > softmax_tolerance)
    return bad.unionByName(sums.select(*keys, F.lit("classes do not sum to one").alias("reason")))


def image_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, r, g, b) from the image source's struct (BGR or grey bytes, row-major)."""
    channels = F.col("image.nChannels")
    t = images.select(*keys, F.col("image.width").alias("_w"), channels.alias("_c"), F.col("image.data").alias("_h"),
                      F.explode(F.sequence(F.lit(0), F.col("image.width") * F.col("image.height") - 1)).alias("_i"))
    # A slice of the binary value itself costs the slice, wherever it starts.
    byte = lambda k: F.conv(F.hex(F.substring(F.col("_h"), F.col("_i") * F.col("_c") + 1 + k, F.lit(1))), 16, 10).cast("int")
    last = F.when(F.col("_c") >= 3, 2).otherwise(0)
    middle = F.when(F.col("_c") >= 3, 1).otherwise(0)
    return t.select(*keys, F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"), (F.col("_i") % F.col("_w")).cast("int").alias("x"),
                    byte(last).alias("r"), byte(middle).alias("g"), byte(0).alias("b"))


def mask_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Boolean mask from a grey image; any value besides 0, 1 and 255 fails the job."""
    legal = F.col("r").isin(0, 1, 255)
    return pixels.select(*keys, "y", "x", F.when(legal, F.col("r") > 0).otherwise(F.raise_error(F.lit("mask must contain only 0/1/255")).cast("boolean")).alias("label"))


def image_issues(pixels: DataFrame, keys: list[str], height: int = 256, width: int = 256) -> DataFrame:
    """(keys, severity, reason) for size, blankness and exposure of every image."""
    stack = pixels.select(*keys, "y", "x", F.explode(F.array("r", "g", "b")).alias("v"))
    s = stack.groupBy(*keys).agg(F.stddev_pop("v").alias("sd"), F.avg("v").alias("m"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    issue = lambda cond, sev, why: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(why).alias("reason")))
    found = F.filter(F.array(
        issue((F.col("h") != height) | (F.col("w") != width), "error", f"expected {height}x{width}"),
        issue(F.col("sd") < 1, "warning", "blank/nearly blank imagery"),
        issue((F.col("m") < 8) | (F.col("m") > 247), "warning", "extremely dark/bright imagery")), lambda i: i.isNotNull())
    return s.select(*keys, F.explode(found).alias("i")).select(*keys, "i.severity", "i.reason")
