"""Mask algebra on horizontal runs ``(pair_id, class_name, y, x0, x1)``.

Masks are swept along each row: every run contributes +1 at ``x0`` and -1 at
``x1``, and a running sum gives the number of layers that cover each segment.
Dilation is "covered at least once", erosion is "covered by all rows of the
kernel", set operations test several running sums at once. A row holds at most
one event pair per run, so a window partition is bounded by the image width.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import connected_components

TILE = ["pair_id", "class_name"]


def tile_partition(df: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Place a tile's rows together once; every later sweep then needs no exchange.

    The partition count is given so that AQE does not fold the per-tile Python and
    window work, which is heavy for its bytes, into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def to_runs(pixels: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Maximal horizontal runs of distinct cells (``x1`` is exclusive)."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        pixels.select(*keys, "y", "x", (F.col("x") - F.row_number().over(w)).alias("_island"))
        .groupBy(*keys, "y", "_island")
        .agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
        .drop("_island")
    )


def to_pixels(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1")


def coalesce_rectangles(runs: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Join equal runs of consecutive rows into rectangles ``(y0, y1, x0, x1)``."""
    w = Window.partitionBy(*keys, "x0", "x1").orderBy("y")
    return (
        runs.withColumn("_block", F.col("y") - F.row_number().over(w))
        .groupBy(*keys, "x0", "x1", "_block")
        .agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
        .drop("_block")
    )


def _events(runs: DataFrame, keys: list[str], layer: str, layers: list[str]) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d"))))
    return runs.select(*keys, "y", ends.alias("_e")).select(
        *keys, "y", F.col("_e.x").alias("x"),
        *[(F.col("_e.d") if name == layer else F.lit(0)).alias(name) for name in layers],
    )


PLAIN = {0: 0}


def sweep(layers: dict[str, DataFrame], keys: list[str] = TILE) -> DataFrame:
    """Segments ``(keys, y, x0, x1, <depth per layer>)`` over all layers at once."""
    names = list(layers)
    return _segments(reduce(DataFrame.unionByName, [_events(runs, keys, name, names) for name, runs in layers.items()]), names, keys)


def sweep_shapes(sources: list[tuple[DataFrame, dict[str, dict[int, int]]]], keys: list[str] = TILE) -> DataFrame:
    """``sweep`` of several layers per run table, each the runs spread by a shape (row offset -> half width, which may be
    negative). A run is exploded once into the events of all its layers, so its lineage is planned and run once."""
    names = [name for _, shapes in sources for name in shapes]

    def events(runs: DataFrame, shapes: dict[str, dict[int, int]]) -> DataFrame:
        steps = [F.struct((F.col("y") + dy).alias("y"), (F.col("x0") - h).alias("a"), (F.col("x1") + h).alias("b"), F.lit(name).alias("layer"))
                 for name, shape in shapes.items() for dy, h in shape.items()]
        placed = runs.select(*keys, F.explode(F.array(*steps)).alias("_s")).filter("_s.b > _s.a")
        ends = F.explode(F.array(F.struct(F.col("_s.a").alias("x"), F.lit(1).alias("d")), F.struct(F.col("_s.b").alias("x"), F.lit(-1).alias("d"))))
        return placed.select(*keys, F.col("_s.y").alias("y"), F.col("_s.layer").alias("_layer"), ends.alias("_e")).select(
            *keys, "y", F.col("_e.x").alias("x"), *[F.when(F.col("_layer") == n, F.col("_e.d")).otherwise(0).alias(n) for n in names])

    return _segments(reduce(DataFrame.unionByName, [events(runs, shapes) for runs, shapes in sources]), names, keys)


def square(radius: int) -> dict[int, int]:
    return {dy: radius for dy in range(-radius, radius + 1)}


def _segments(events: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        events.select(
            *keys, "y", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"),
            *[F.sum(n).over(w).alias(n) for n in names],
        )
        .filter(F.col("x1") > F.col("x0"))
    )


def merge_segments(segments: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Join touching segments of a row into maximal runs."""
    w = Window.partitionBy(*keys, "y").orderBy("x0")
    gap = F.when(F.col("x0") == F.lag("x1").over(w), 0).otherwise(1)
    marked = segments.select(*keys, "y", "x0", "x1", gap.alias("_gap"))
    return (
        marked.withColumn("_run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "y", "_run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_run")
    )


def combine(layers: dict[str, DataFrame], where: Column, keys: list[str] = TILE) -> DataFrame:
    return merge_segments(sweep(layers, keys).filter(where), keys)


def spread_square(runs: DataFrame, radius: int) -> DataFrame:
    """Raw (overlapping) cover of a square dilation; feed to ``sweep``."""
    return (
        runs.withColumn("y", F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)))
        .withColumn("x0", F.col("x0") - radius)
        .withColumn("x1", F.col("x1") + radius)
    )


def spread_profile(runs: DataFrame, half_widths: dict[int, int]) -> DataFrame:
    """Raw cover of a dilation by a shape given as row offset -> half width."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(h).alias("h")) for dy, h in half_widths.items()])
    return (
        runs.withColumn("_s", F.explode(steps))
        .withColumn("y", F.col("y") + F.col("_s.dy"))
        .withColumn("x0", F.col("x0") - F.col("_s.h"))
        .withColumn("x1", F.col("x1") + F.col("_s.h"))
        .drop("_s")
    )


def clip(runs: DataFrame, height: int, width: int) -> DataFrame:
    return (
        runs.filter((F.col("y") >= 0) & (F.col("y") < height))
        .withColumn("x0", F.greatest(F.col("x0"), F.lit(0)))
        .withColumn("x1", F.least(F.col("x1"), F.lit(width)))
        .filter(F.col("x1") > F.col("x0"))
    )


def disk(radius: float) -> dict[int, int]:
    reach = int(np.floor(radius))
    return {dy: int(np.floor(np.sqrt(radius * radius - dy * dy))) for dy in range(-reach, reach + 1)}


def diamond(radius: int) -> dict[int, int]:
    return {dy: radius - abs(dy) for dy in range(-radius, radius + 1)}


def dilate(runs: DataFrame, radius: int, height: int | None = None, width: int | None = None, keys: list[str] = TILE) -> DataFrame:
    """Square dilation; clipped to the tile when its size is given."""
    cover = spread_square(runs, radius)
    if height is not None:
        cover = clip(cover, height, width)
    return combine({"m": cover}, F.col("m") > 0, keys)


def dilate_shape(runs: DataFrame, half_widths: dict[int, int], height: int | None = None, width: int | None = None, keys: list[str] = TILE) -> DataFrame:
    cover = spread_profile(runs, half_widths)
    if height is not None:
        cover = clip(cover, height, width)
    return combine({"m": cover}, F.col("m") > 0, keys)


def shrink_cover(runs: DataFrame, radius: int) -> DataFrame:
    """Cover whose depth is ``2*radius+1`` exactly on the square erosion."""
    return (
        runs.withColumn("x0", F.col("x0") + radius)
        .withColumn("x1", F.col("x1") - radius)
        .filter(F.col("x1") > F.col("x0"))
        .withColumn("y", F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)))
    )


def erode(runs: DataFrame, radius: int, keys: list[str] = TILE) -> DataFrame:
    """Square erosion of maximal runs; outside the tile counts as background."""
    return combine({"m": shrink_cover(runs, radius)}, F.col("m") == 2 * radius + 1, keys)


def erode_cross(runs: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Erosion by the 4-neighbour cross."""
    inner = runs.withColumn("x0", F.col("x0") + 1).withColumn("x1", F.col("x1") - 1).filter(F.col("x1") > F.col("x0"))
    above_below = runs.withColumn("y", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)))
    return combine({"m": inner.unionByName(above_below)}, F.col("m") == 3, keys)


def boundary(runs: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Mask minus its 3x3 erosion."""
    seg = sweep_shapes([(runs, {"m": PLAIN, "core": {dy: -1 for dy in (-1, 0, 1)}})], keys)
    return merge_segments(seg.filter((F.col("m") > 0) & (F.col("core") < 3)), keys)


def area(runs: DataFrame, keys: list[str] = TILE) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"))


# --- connected components ---------------------------------------------------

def _settle(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node of a small graph."""
    label = np.arange(n)
    while len(src):
        low = np.minimum(label[src], label[dst])
        step = label.copy()
        np.minimum.at(step, label[src], low)
        np.minimum.at(step, label[dst], low)
        while True:
            jumped = step[step]
            if np.array_equal(jumped, step):
                break
            step = jumped
        if np.array_equal(step, label):
            break
        label = step
    return label


def _touching(row: np.ndarray, start: np.ndarray, stop: np.ndarray, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of runs that touch a run of the next row; runs are ordered by row and start."""
    span = max(int(stop.max(initial=0)), 1) + 4
    first = np.searchsorted(row * span + stop, (row + 1) * span + start - reach, side="right")
    last = np.searchsorted(row * span + start, (row + 1) * span + stop + reach, side="left")
    count = np.maximum(last - first, 0)
    src = np.repeat(np.arange(len(row)), count)
    return src, np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def label_layers(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, layer, length) of every run of a stack of masks (layer, y, x), in the order of the cells; runs of one 4-component share the root, the
    index of its first run."""
    edge = np.diff(cells.astype(np.int8), prepend=0, append=0, axis=2)
    layer, y, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[2]
    src, dst = _touching(layer * (cells.shape[1] + 1) + y, start, stop)  # an empty row between layers
    return _settle(len(y), src, dst), layer, stop - start


def grow_layers(cells: np.ndarray) -> np.ndarray:
    """3x3 dilation over the last two axes, within them."""
    out = cells.copy()
    out[..., :, 1:] |= cells[..., :, :-1]
    out[..., :, :-1] |= cells[..., :, 1:]
    wide = out.copy()
    out[..., 1:, :] |= wide[..., :-1, :]
    out[..., :-1, :] |= wide[..., 1:, :]
    return out


def edge_layers(cells: np.ndarray) -> np.ndarray:
    """Masks minus their 3x3 erosions over the last two axes; outside is background."""
    wide = np.pad(cells, [(0, 0)] * (cells.ndim - 2) + [(1, 1), (1, 1)])
    return cells & grow_layers(~wide)[..., 1:-1, 1:-1]


def spread_layers(cells: np.ndarray, half_widths: dict[int, int]) -> np.ndarray:
    """Dilation by a shape (row offset -> half width) over the last two axes, within them."""
    height, width = cells.shape[-2:]
    dy, dx = max(half_widths), max(half_widths.values())
    wide = np.pad(cells, [(0, 0)] * (cells.ndim - 2) + [(dy, dy), (dx, dx)])
    return np.logical_or.reduce([wide[..., dy + a: dy + a + height, dx + b: dx + b + width] for a, h in half_widths.items() for b in range(-h, h + 1)])


def whole_groups(df: DataFrame, keys: list[str], order: list, kernel, schema: str, made_there: dict[str, Column] | None = None) -> DataFrame:
    """Arrow kernel over many whole groups of ``keys`` at a time: small groups share a call, and a task holds a batch and one group.

    Rows come sorted by ``order`` within their group; ``_at`` numbers them from 1. Rows that are placed by some of the keys need no exchange.
    A kernel gives one table, or several one after another. Columns of ``made_there`` are made where the rows have met, so what is large is not exchanged.
    """
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumns(made_there or {})

    def made(rows: pa.Table):
        out = kernel(rows)
        for table in [out] if isinstance(out, pa.Table) else out:
            yield from table.to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_at").to_numpy() == 1)
            if len(starts):  # all groups before the last start are complete
                last = int(starts[-1])
                done = pa.Table.from_batches([*held, batch.slice(0, last)])
                if done.num_rows:
                    yield from made(done)
                held = []
                batch = batch.slice(last)
            held.append(batch)
        done = pa.Table.from_batches(held) if held else None
        if done is not None and done.num_rows:
            yield from made(done)

    return placed.mapInArrow(run, schema)


def _label_band(reach: int, stride: int, lane: str | None):
    """Arrow kernel: adds component_id to the runs of bands of tiles, ordered by lane, row and start."""

    def label(table: pa.Table) -> pa.Table:
        y, start, stop = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        # Bands and layers are stacked far enough apart that no two of them touch.
        fresh = table.column("_at").to_numpy() == 1
        if lane is not None:
            owner = table.column(lane).to_numpy()
            fresh[1:] |= owner[1:] != owner[:-1]
        row = y - y.min() + np.cumsum(fresh) * (y.max() - y.min() + 2)
        src, dst = _touching(row, start, stop, reach)
        root = _settle(len(y), src, dst)
        return table.drop_columns("_at").append_column("component_id", pa.array(y[root] * stride + start[root]))

    return label


def label_components(
    runs: DataFrame, width: int, height: int | None = None, connectivity: int = 4,
    keys: list[str] = TILE, lane: str | None = None, band_rows: int = 256,
) -> DataFrame:
    """Adds ``component_id`` = smallest ``y*width+x`` of the run's component.

    Runs are labelled per horizontal band of a tile (a group of at most
    ``band_rows`` image rows). Only when a tile may be taller than one band are the
    bands stitched, with a graph that holds just the runs on both sides of each cut.
    ``lane`` separates layers of one tile that must not touch each other.
    """
    reach = 1 if connectivity == 8 else 0
    layout = [f for f in runs.schema.fields]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout)
    kernel, order = _label_band(reach, width, lane), [*([lane] if lane else []), "y", "x0"]
    if height is not None and height <= band_rows:
        return whole_groups(runs, keys, order, kernel, f"{shape}, component_id long")
    banded = runs.withColumn("_band", F.floor(F.col("y") / band_rows))
    local = cut(
        whole_groups(banded, [*keys, "_band"], order, kernel, f"{shape}, _band long, component_id long")
    )
    node = F.struct(*keys, *([lane] if lane else []), "component_id")
    low = local.filter((F.col("y") + 1) % band_rows == 0).select(
        *keys, *([lane] if lane else []), (F.col("y") + 1).alias("y"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), node.alias("src"))
    high = local.filter(F.col("y") % band_rows == 0).select(
        *keys, *([lane] if lane else []), "y", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), node.alias("dst"))
    seams = low.join(high, [*keys, *([lane] if lane else []), "y"]).filter(
        (F.col("bx0") < F.col("ax1") + reach) & (F.col("bx1") > F.col("ax0") - reach)
    )
    joined = connected_components(seams.select("src", "dst"))
    return (
        local.withColumn("node", node).join(joined, "node", "left")
        .withColumn("component_id", F.coalesce(F.col("component.component_id"), F.col("component_id")))
        .drop("node", "component", "_band")
    )


def component_areas(labelled: DataFrame, keys: list[str] = TILE) -> DataFrame:
    return labelled.groupBy(*keys, "component_id").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"))


def keep_large(labelled: DataFrame, min_area: int, keys: list[str] = TILE) -> DataFrame:
    """Runs of components with at least ``min_area`` pixels (no exchange: same keys)."""
    w = Window.partitionBy(*keys, "component_id")
    return labelled.withColumn("area", F.sum(F.col("x1") - F.col("x0")).over(w)).filter(F.col("area") >= min_area)


def area_filter(labelled: DataFrame, min_area: int, min_pos_area: int, keys: list[str] = TILE) -> DataFrame:
    """Component filter, then drop every run of a class whose remaining area is too small."""
    kept = keep_large(labelled, min_area, keys)
    total = F.sum(F.col("x1") - F.col("x0")).over(Window.partitionBy(*keys))
    return kept.withColumn("class_area", total).filter(F.col("class_area") >= min_pos_area)


def component_holes(labelled: DataFrame, width: int, height: int, keys: list[str] = TILE) -> DataFrame:
    """Runs enclosed by one component, with that component's id.

    A hole can only consist of gaps between two runs of the same component in the
    same row. A gap is open when the row above or below does not bracket it; a
    connected set of gaps is a hole when none of its members is open.
    """
    owner = [*keys, "component_id"]
    w = Window.partitionBy(*owner, "y").orderBy("x0")
    gaps = (
        labelled.select(*owner, "y", F.lag("x1").over(w).alias("x0"), F.col("x0").alias("x1"))
        .filter(F.col("x0").isNotNull())
    )
    extent = labelled.groupBy(*owner, "y").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    sides = extent.select(*owner, F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"), "left", "right")
    closed = (
        gaps.join(sides, [*owner, "y"], "left")
        .groupBy(*owner, "y", "x0", "x1")
        .agg(F.count_if((F.col("left") <= F.col("x0")) & (F.col("right") >= F.col("x1"))).alias("_sides"))
        .withColumnRenamed("component_id", "owner")
    )
    regions = label_components(closed, width, height, 4, keys, lane="owner").withColumnRenamed("component_id", "region")
    shut = F.min("_sides").over(Window.partitionBy(*keys, "owner", "region"))
    return (
        regions.withColumn("_shut", shut).filter(F.col("_shut") == 2)
        .select(*keys, F.col("owner").alias("component_id"), "region", "y", "x0", "x1")
    )


def fill_components(labelled: DataFrame, width: int, height: int, keys: list[str] = TILE) -> DataFrame:
    """Union of every component with its own holes filled, as merged runs."""
    holes = component_holes(labelled, width, height, keys)
    cover = labelled.select(*keys, "y", "x0", "x1").unionByName(holes.select(*keys, "y", "x0", "x1"))
    return combine({"m": cover}, F.col("m") > 0, keys)


def complement(runs: DataFrame, tiles: DataFrame, height: int, width: int, keys: list[str] = TILE) -> DataFrame:
    """Background runs of every tile in ``tiles``."""
    full = tiles.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(0).alias("x0"), F.lit(width).alias("x1"))
    return combine({"all": full, "m": runs}, (F.col("all") > 0) & (F.col("m") == 0), keys)


def fill_holes(runs: DataFrame, tiles: DataFrame, height: int, width: int, keys: list[str] = TILE) -> DataFrame:
    """Mask plus background 4-components that do not reach the tile border."""
    outside = label_components(complement(runs, tiles, height, width, keys), width, height, 4, keys)
    touches = F.max(
        ((F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x0") == 0) | (F.col("x1") == width)).cast("int")
    ).over(Window.partitionBy(*keys, "component_id"))
    holes = outside.withColumn("_edge", touches).filter(F.col("_edge") == 0).select(*keys, "y", "x0", "x1")
    cover = runs.select(*keys, "y", "x0", "x1").unionByName(holes)
    return combine({"m": cover}, F.col("m") > 0, keys)


def _window_count(mask: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """How many cells of the mask lie within ``radius`` along an axis; there are none outside."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (radius + 1, radius)
    total = np.cumsum(np.pad(mask, pad), axis=axis, dtype=np.int32)
    size = mask.shape[axis]
    upper, lower = [slice(None)] * 2, [slice(None)] * 2
    upper[axis], lower[axis] = slice(2 * radius + 1, 2 * radius + 1 + size), slice(0, size)
    return total[tuple(upper)] - total[tuple(lower)]


def _grow(mask: np.ndarray, radius: int) -> np.ndarray:
    return _window_count(_window_count(mask, radius, 1) > 0, radius, 0) > 0


def _shrink(mask: np.ndarray, radius: int) -> np.ndarray:
    full = 2 * radius + 1
    return _window_count(_window_count(mask, radius, 1) == full, radius, 0) == full


def _morph_band(steps: list[tuple[bool, int]], reach: int, height: int, width: int, band_rows: int, keys: list[str]):
    """Arrow kernel: all steps on one band of a tile, with ``reach`` more rows on both sides."""

    def run(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        top = int(table.column("_band")[0].as_py()) * band_rows
        first, last = max(0, top - reach), min(height, top + band_rows + reach)
        edges = np.zeros((last - first, width + 1), dtype=np.int32)
        np.add.at(edges, (y - first, x0), 1)
        np.add.at(edges, (y - first, x1), -1)
        mask = np.cumsum(edges, axis=1)[:, :width] > 0
        for grow, radius in steps:
            mask = (_grow if grow else _shrink)(mask, radius)
        own = mask[top - first: min(height, top + band_rows) - first]
        edge = np.diff(own.astype(np.int8), prepend=0, append=0, axis=1)
        row, start = np.nonzero(edge == 1)
        stop = np.nonzero(edge == -1)[1]
        out = table.select(keys).take(pa.array(np.zeros(len(row), dtype=np.int64)))
        for name, values in (("y", row + top), ("x0", start), ("x1", stop)):
            out = out.append_column(name, pa.array(values.astype(np.int32)))
        return out

    return run


def morph(runs: DataFrame, height: int, width: int, steps: list[tuple[bool, int]], keys: list[str] = TILE, band_rows: int = 256) -> DataFrame:
    """Square dilations (True, radius) and erosions (False, radius) in order, in one pass; outside the tile is background.

    What a row becomes depends on rows up to the sum of the radii away. So every run goes to its band of ``band_rows`` rows and to the bands
    that are so near, and a band is finished on its own, however tall the tile is.
    """
    reach = sum(radius for _, radius in steps)
    if not reach:
        return runs.select(*keys, "y", "x0", "x1")
    bands = F.sequence(F.floor(F.greatest(F.col("y") - reach, F.lit(0)) / band_rows), F.floor(F.least(F.col("y") + reach, F.lit(height - 1)) / band_rows))
    placed = clip(runs.select(*keys, "y", "x0", "x1"), height, width).withColumn("_band", F.explode(bands))
    shape = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)
    return placed.groupBy(*keys, "_band").applyInArrow(_morph_band(steps, reach, height, width, band_rows, keys), f"{shape}, y int, x0 int, x1 int")


def clean_mask(
    runs: DataFrame, tiles: DataFrame, height: int, width: int, *, opening: int = 0, closing: int = 0,
    dilation: int = 0, erosion: int = 0, fill: bool = False, min_area: int = 0, connectivity: int = 4,
    keys: list[str] = TILE,
) -> DataFrame:
    """Opening, closing, dilation, erosion, hole fill and component filter, in that order; all up to the fill are one pass."""
    steps = [(False, opening), (True, opening), (True, closing), (False, closing), (True, dilation), (False, erosion)]
    m = morph(runs, height, width, [(grow, radius) for grow, radius in steps if radius], keys)
    if fill:
        m = fill_holes(m, tiles, height, width, keys)
    if min_area:
        m = keep_large(label_components(m, width, height, connectivity, keys), min_area, keys).select(*keys, "y", "x0", "x1")
    return m
