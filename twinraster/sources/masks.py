"""Truth masks from image files: decoded by Spark's image source, turned into runs without a pixel table."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_absent, present
from ..operators.polygons import cell_runs
from ..operators.runs import TILE
from .tables import PREDICTION_FIELDS, ContractError, read_truth

CLASSES = PREDICTION_FIELDS[1:]
ILLEGAL = "mask must contain only 0/1/255"


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, image) of every PNG below ``root``; files that can't be decoded are rows too."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    return found.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image")


def image_fault(image: Column, height: int | None = None, width: int | None = None) -> Column:
    """Why an image struct can't be used, null if it can: decoded badly or not at all, or of another size than asked for."""
    i = lambda name: image.getField(name)
    broken = i("data").isNull() | (i("height") <= 0) | (i("width") <= 0) | (i("nChannels") <= 0) | (F.length(i("data")) != i("height") * i("width") * i("nChannels"))
    other = F.lit(False) if height is None else (i("height") != height) | (i("width") != width)
    return F.when(F.coalesce(broken, F.lit(True)), "unreadable image").when(other, F.lit(f"expected {height}x{width}"))


def _encode(names: list[str]):
    def run(batches):
        for batch in batches:
            whom, rows, starts, stops, illegal = [], [], [], [], []
            sizes = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_h", "_w", "_c")]
            for k, (data, h, w, c) in enumerate(zip(batch.column(batch.schema.get_field_index("_data")).to_pylist(), *sizes)):
                grey = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)[:, :, -1 if c >= 3 else 0]
                if not np.isin(grey, (0, 1, 255)).all():
                    illegal.append(k)
                    continue
                edge = np.diff((grey > 0).astype(np.int8), prepend=0, append=0, axis=1)
                y, x0 = np.nonzero(edge == 1)
                whom.append(np.full(len(y), k))
                rows.append(y)
                starts.append(x0)
                stops.append(np.nonzero(edge == -1)[1])
            owner = np.concatenate([*whom, np.array(illegal, dtype=np.int64)]).astype(np.int64)
            count = len(owner) - len(illegal)
            fill = lambda parts: pa.array(np.concatenate([*parts, np.zeros(len(illegal))]).astype(np.int32), mask=np.arange(len(owner)) >= count)
            keys = [batch.column(batch.schema.get_field_index(n)).take(pa.array(owner)) for n in names]
            reason = pa.array([None] * count + [ILLEGAL] * len(illegal), pa.string())
            yield pa.RecordBatch.from_arrays([*keys, fill(rows), fill(starts), fill(stops), reason], names=[*names, "y", "x0", "x1", "reason"])

    return run


def mask_runs(images: DataFrame, keys: list[str], height: int | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs (keys, y, x0, x1) of mask images, and (keys, reason) of the images that give none because they can't be used.

    ``images`` has the keys and ``image``, the image source's struct. A pixel counts if its value is 1 or 255; grey images are read as they are, of
    colour images the last channel. Many images go through one Arrow batch; an image is one row in and its runs out.
    """
    judged = images.select(*keys, "image", image_fault(F.col("image"), height, width).alias("reason"))
    good = judged.filter(F.col("reason").isNull()).select(
        *keys, F.col("image.height").alias("_h"), F.col("image.width").alias("_w"), F.col("image.nChannels").alias("_c"), F.col("image.data").alias("_data"))
    schema = T.StructType([images.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("y", "x0", "x1")] + [T.StructField("reason", T.StringType())])
    found = good.mapInArrow(_encode(keys), schema)
    return found.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).drop("image").unionByName(found.filter(F.col("reason").isNotNull()).select(*keys, "reason"))


def read_truth_runs(spark: SparkSession, path: str, root: str | None = None, kind: str = "auto", height: int | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truth of either kind as runs: (runs, population, issues), keyed by pair_id and class_name.

    A manifest names a mask file per class; the files lie below ``root`` and are found by path. Masks declared absent or left
    blank are empty. Polygon tables hold the cells themselves. Issues (pair_id, class_name, reason) are masks that are missing or can't be used.
    """
    found, rows = read_truth(spark, path, kind)
    if found == "polygons":
        population = rows.select(F.col("id").alias("pair_id"), F.explode(F.array(*map(F.lit, CLASSES))).alias("class_name"))
        return cell_runs(rows), population, spark.createDataFrame([], "pair_id string, class_name string, reason string")
    if root is None:
        raise ContractError("a manifest of masks needs the folder of its images")
    named = [c for c in CLASSES if c in rows.columns]
    each = rows.select(F.col("id").alias("pair_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("class_name"), (F.col(c) if c in named else F.lit(None).cast("string")).alias("path")) for c in CLASSES])).alias("m")).select("pair_id", "m.*")
    wanted = each.filter(F.coalesce(present(F.col("path")) & ~is_absent(F.col("path")), F.lit(False)))
    placed = wanted.join(read_images(spark, root), "path", "left")
    runs, faults = mask_runs(placed.filter(F.col("image").isNotNull()), TILE, height, width)
    missing = placed.filter(F.col("image").isNull()).select(*TILE, F.lit("missing file").alias("reason"))
    return runs, each.select(*TILE), reduce(DataFrame.unionByName, [faults.select(*TILE, "reason"), missing])
