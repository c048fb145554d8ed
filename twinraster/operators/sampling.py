"""Seeded draws, negative mining and synthetic no-change rows."""
from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from .ordering import global_index
from .runs import tile_partition, whole_groups

# Kinds of synthetic no-change rows, colour gains, category shares.
COLOUR_GAINS = {"seasonal_color": (1.15, 0.9, 0.8), "vegetation_appearance": (1.1, 0.8, 0.9), "roof_color": (0.8, 1.0, 1.3), "agricultural": (1.25, 0.8, 0.9), "road": (0.85, 1.0, 1.15)}
STRENGTH, GAIN, GREEN_LEAD = (0.6, 0.4), (0.7, 0.6), 1.1  # least value and range of the draw; lead of green in vegetation
SHADOW_RADII, SHADOW_DARKNESS = (0.3, 0.35), (0.25, 0.25)  # shares of height and width; least value and range
PATCH_PARTS, PATCH_COLOURS = (16, 12), (90, 141)  # parts of height and width; least value and range
BLUR_SIGMA = (0.6, 0.7)  # least value and range
POSITIVE_SHARES = [("new_building", 0.25), ("tree_removal", 0.25), ("both", 0.125)]


def draw_epoch(pool: DataFrame, batches: int, batch_size: int, seed: int, real_ratio: float = 3.0) -> DataFrame:
    """(batch, slot, category, id): fixed positive slots, the rest negatives with real:other odds.

    Slots pick a category by position or hash, then a member by ``hash mod pool size``;
    members are indexed once per category, so no pool is collected.
    """
    indexed = global_index(pool.select("category", "id"), F.col("category"), F.col("id"), name="_g")
    starts = indexed.groupBy("category").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_size"))
    fixed = [c for c, share in POSITIVE_SHARES for _ in range(max(1, int(batch_size * share)))]
    unit = hash_unit(F.lit(seed), F.col("batch"), F.col("slot"), F.lit("kind"))
    category = F.when(unit < real_ratio / (1 + real_ratio), "real_negative").otherwise("negative")
    for i, c in enumerate(fixed):
        category = F.when(F.col("slot") == i, c).otherwise(category)
    slots = pool.sparkSession.range(batches).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("slot")).withColumn("category", category)
    pick = F.floor(hash_unit(F.lit(seed), F.col("batch"), F.col("slot"), F.lit("member")) * F.col("_size"))
    placed = slots.join(starts, "category").withColumn("_g", F.col("_first") + pick)
    return placed.join(indexed.select("_g", "id"), "_g").select("batch", "slot", "category", "id")


def mine_negatives(cells: DataFrame, pairs: DataFrame, seed: int, minimum: int = 30, centre: tuple[int, int] = (384, 384)) -> DataFrame:
    """Best built cell per pair, then every pair's centre cell, with the ``rank`` in seeded order; callers take what they need."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("pair_id").cast("string")))
    best = cells.filter(F.col("built") >= minimum).groupBy("pair_id").agg(
        F.max_by(F.struct("row", "col"), F.struct("built", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("p"))
    first = best.select("pair_id", F.col("p.row").alias("row"), F.col("p.col").alias("col"), F.lit(1).alias("pass"))
    rest = pairs.select("pair_id", F.lit(centre[0]).alias("row"), F.lit(centre[1]).alias("col"), F.lit(2).alias("pass"))
    ranked = global_index(first.unionByName(rest).withColumn("_o", order), F.col("pass"), F.col("_o"), name="rank")
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_o")


def assign_sources(attempts: DataFrame, sources: DataFrame, index: str = "attempt") -> DataFrame:
    """Round-robin: attempt i takes source ``i mod count`` in id order."""
    ranked = global_index(sources.select("source_id"), F.col("source_id"), name="_i")
    n = ranked.count()
    return attempts.withColumn("_i", F.pmod(F.col(index), F.lit(n))).join(ranked, "_i").drop("_i")


def rank_attempts(attempts: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Accepted attempts with their ``rank`` per category, first ones first, and whether they are ``within_target``."""
    want = F.lit(None).cast("int")
    for c, n in targets.items():
        want = F.when(F.col("category") == c, n).otherwise(want)
    placed = global_index(attempts.filter("accepted"), F.col("category"), F.col("attempt"), name="_g")
    starts = placed.groupBy("category").agg(F.min("_g").alias("_first"))
    ranked = placed.join(starts, "category").withColumn("rank", F.col("_g") - F.col("_first") + 1)
    return ranked.withColumn("within_target", F.coalesce(F.col("rank") <= want, F.lit(False))).drop("_g", "_first")


def _unit(*parts: object) -> float:
    """``hash_unit`` of one image."""
    text = "|".join(str(p) for p in parts if p is not None)
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:8], 16) / 4294967296.0


def _byte(v: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(v), 0, 255)


def _negatives(kinds: list[str], seed: int, height: int, width: int):
    """Arrow kernel: the changed pixels of whole images, ordered by row and column, one kind after another. Shift and blur mirror the borders; pixels that
    an image doesn't hold can't be moved and add nothing to a blur."""
    steps = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx]
    ry, rx = max(height * SHADOW_RADII[0], 1.0), max(width * SHADOW_RADII[1], 1.0)
    th, tw = max(1, height // PATCH_PARTS[0]), max(1, width // PATCH_PARTS[1])
    mirror = lambda c, n: np.where(c < 0, -c, np.where(c >= n, 2 * n - 2 - c, c))

    def run(table: pa.Table):
        y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        before = [table.column(c).to_numpy().astype(np.float64) for c in "rgb"]
        roi = table.column("_roi").to_numpy(zero_copy_only=False).astype(bool)
        fresh = table.column("_at").to_numpy() == 1
        image = np.cumsum(fresh) - 1
        names = table.column("_key").take(pa.array(np.flatnonzero(fresh))).to_pylist()
        code = (image * height + y) * width + x

        def find(sy: np.ndarray, sx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sy, sx = mirror(sy, height), mirror(sx, width)
            wanted = (image * height + sy) * width + sx
            place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            return place, (code[place] == wanted) & (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)

        for kind in kinds:
            draw = lambda tag: np.array([_unit(seed, n, kind, tag) for n in names])[image]  # noqa: B023, E731
            changed, valid, rows = before, np.ones(len(y), dtype=bool), None
            if kind == "brightness":
                gain = GAIN[0] + GAIN[1] * draw("gain")
                changed = [_byte(v * gain) for v in before]
            elif kind in COLOUR_GAINS:
                strength = STRENGTH[0] + STRENGTH[1] * draw("strength")
                changed = [_byte(v * (1 + (g - 1) * strength)) for v, g in zip(before, COLOUR_GAINS[kind])]
                if kind == "vegetation_appearance":
                    green = (before[1] > before[0] * GREEN_LEAD) & (before[1] > before[2] * GREEN_LEAD)
                    changed = [np.where(green, n, v) for n, v in zip(changed, before)]
            elif kind == "shadows":
                distance = ((y - draw("cy") * height) / ry) ** 2 + ((x - draw("cx") * width) / rx) ** 2
                shade = 1 - np.exp(-distance / 2) * (SHADOW_DARKNESS[0] + SHADOW_DARKNESS[1] * draw("dark"))
                changed = [_byte(v * shade) for v in before]
            elif kind == "temporary_objects":
                py, px = np.floor(draw("py") * (height - th + 1)), np.floor(draw("px") * (width - tw + 1))
                patch = (y >= py) & (y < py + th) & (x >= px) & (x < px + tw)
                changed = [np.where(patch, np.floor(PATCH_COLOURS[0] + PATCH_COLOURS[1] * draw(f"colour{c}")), v) for c, v in zip("rgb", before)]
            elif kind == "blur":
                sigma = BLUR_SIGMA[0] + BLUR_SIGMA[1] * draw("sigma")
                side = np.exp(-1.0 / (2 * sigma * sigma))
                near, own = side / (1 + 2 * side), 1 / (1 + 2 * side)
                weights, sums = (own * own, near * own, near * near), [np.zeros(len(y)) for _ in before]
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        tap, there = find(y + a, x + b)
                        w = np.where(there, weights[abs(a) + abs(b)], 0.0)
                        sums = [t + w * v[tap] for t, v in zip(sums, before)]
                changed = [_byte(t) for t in sums]
            if kind == "slight_shift":  # the whole image moves, whatever the region
                step = np.array(steps)[np.floor(draw("step") * len(steps)).astype(int)]
                sy, sx = y - step[:, 0], x - step[:, 1]
                place, rows = find(sy, sx)
                changed, valid = [v[place] for v in before], (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)
            else:
                changed = [np.where(roi, n, v) for n, v in zip(changed, before)]
            out = table.select(["id"]).append_column("kind", pa.array([kind]).take(pa.array(np.zeros(len(y), dtype=np.int64))))
            for name, column in zip(["y", "x", *"rgb", "valid", "o_r", "o_g", "o_b"], [table.column("y"), table.column("x"), *map(pa.array, [*changed, valid, *before])]):
                out = out.append_column(name, column)
            yield out if rows is None else out.filter(pa.array(rows))

    return run


def negative_rows(images: DataFrame, kinds: list[str], seed: int, height: int, width: int, roi: Column | None = None) -> DataFrame:
    """(id, kind, y, x, r, g, b, valid, o_r, o_g, o_b): changed copies of byte images that show no real change, with the pixel before the change.

    Rows of an image meet once, in a kernel over many whole images. Parameters come from a hash of (seed, id, kind).
    """
    roi = F.lit(True) if roi is None else F.coalesce(roi, F.lit(False))
    t = tile_partition(images.select("id", "y", "x", *"rgb", roi.alias("_roi"), F.col("id").cast("string").alias("_key")), ["id"])
    kind = {c: images.schema[c].dataType.simpleString() for c in ("id", "y", "x")}
    shape = f"id {kind['id']}, kind string, y {kind['y']}, x {kind['x']}, r double, g double, b double, valid boolean, o_r double, o_g double, o_b double"
    return whole_groups(t, ["id"], ["y", "x"], _negatives(kinds, seed, height, width), shape)


def changed_pixels(changed: DataFrame) -> DataFrame:
    """(id, kind, changed_pixels, invalid_pixels) of ``negative_rows``."""
    differs = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"o_{c}") for c in "rgb"])
    return changed.groupBy("id", "kind").agg(F.count_if(differs).alias("changed_pixels"), F.count_if(~F.col("valid")).alias("invalid_pixels"))


def paired_negatives(pairs: DataFrame) -> DataFrame:
    """Real no-change pairs: same nonempty region and season, and an explicit confirmation."""
    same = lambda c: (F.trim(f"{c}_pre") != "") & (F.col(f"{c}_pre") == F.col(f"{c}_post"))
    return pairs.withColumn("reason", F.when(~F.coalesce(same("region") & same("season"), F.lit(False)), "region and season must match").when(~F.coalesce("confirmed", F.lit(False)), "explicit confirmation required"))
