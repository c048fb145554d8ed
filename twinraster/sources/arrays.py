"""Saved array scans: NumPy files and batch scorers over Arrow batches."""
from __future__ import annotations

from collections.abc import Callable
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_SCHEMA = "id string, channels int, height int, width int, values array<float>"


def read_map_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, channels, height, width, values) of every saved map below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.np[yz]$", 1).alias("id"), "content").filter("id <> ''")
    return decode_maps(named)


def decode_maps(files: DataFrame) -> DataFrame:
    """Decode .npy/.npz bytes (no pickles); each map must be finite float [3, H, W] in [0, 1]."""
    def decode(batches):
        for pdf in batches:
            rows = []
            for ident, content in zip(pdf["id"], pdf["content"]):
                loaded = np.load(BytesIO(content), allow_pickle=False)
                a = loaded["probabilities"] if hasattr(loaded, "files") else loaded
                if a.ndim != 3 or a.shape[0] != 3 or not np.issubdtype(a.dtype, np.floating):
                    raise ValueError(f"{ident}: expected float [3, H, W], got {a.dtype} {a.shape}")
                if not np.isfinite(a).all() or (a < 0).any() or (a > 1).any():
                    raise ValueError(f"{ident}: probabilities must be finite and in [0, 1]")
                rows.append((ident, *a.shape, a.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["id", "channels", "height", "width", "values"])

    return files.select("id", "content").mapInPandas(decode, MAP_SCHEMA)


def long_maps(maps: DataFrame) -> DataFrame:
    """(id, channel, y, x, p) from decoded maps."""
    area = F.col("height") * F.col("width")
    return maps.select("id", "height", "width", F.posexplode("values").alias("i", "p")).select(
        "id", F.floor(F.col("i") / area).cast("int").alias("channel"), F.floor((F.col("i") % area) / F.col("width")).cast("int").alias("y"),
        (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("p").cast("double").alias("p"))


def score_batches(tiles: DataFrame, scorer: Callable, classes: int, batch_size: int = 8) -> DataFrame:
    """Run any scorer over batches of paired tiles.

    ``tiles`` has pair_id and equal-length arrays ``pre`` and ``post``. ``scorer`` maps
    two float arrays [n, pixels] to maps [n, classes, pixels] and presence [n, classes];
    shapes, finiteness and the [0, 1] range are checked.
    """
    pid = dict(tiles.dtypes)["pair_id"]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at:at + batch_size]
                pre, post = np.stack(part["pre"].to_numpy()), np.stack(part["post"].to_numpy())
                maps, presence = (np.asarray(v, dtype=float) for v in scorer(pre, post))
                if maps.shape != (len(part), classes, pre.shape[1]) or presence.shape != (len(part), classes):
                    raise ValueError("scorer returned unexpected shapes")
                for v in (maps, presence):
                    if not np.isfinite(v).all() or (v < 0).any() or (v > 1).any():
                        raise ValueError("scorer values must be finite and in [0, 1]")
                yield pd.DataFrame({"pair_id": part["pair_id"].to_numpy(), "maps": [m.ravel() for m in maps], "presence": list(presence)})

    return tiles.select("pair_id", "pre", "post").mapInPandas(run, f"pair_id {pid}, maps array<double>, presence array<double>")


def scored_pixels(scored: DataFrame, classes: list[str], width: int, pixels: int) -> DataFrame:
    """(pair_id, class_name, y, x, p) from scorer output."""
    names = F.array(*[F.lit(c) for c in classes])
    t = scored.select("pair_id", F.posexplode("maps").alias("i", "p"))
    cell = F.col("i") % pixels
    return t.select("pair_id", F.element_at(names, (F.floor(F.col("i") / pixels) + 1).cast("int")).alias("class_name"), F.floor(cell / width).cast("int").alias("y"), (cell % width).cast("int").alias("x"), "p")
