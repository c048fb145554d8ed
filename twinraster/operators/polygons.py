"""Polygon cells: export from filled components, parsing and validation."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_blank
from ..session import cut
from ..sources.tables import ContractError, reject_any
from . import runs as R
from . import scoring as Q
from .geo import footprint_runs
from .rings import exterior_edges, ring_cells
from .sweep import alignment_mismatch

RING_TYPE = "array<array<array<double>>>"


def polygon_cells(labelled: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """(pair_id, class_name, cell): JSON exteriors of every component, holes filled."""
    return ring_cells(exterior_edges(labelled, width, height))


def prediction_rows(cells: DataFrame, population: DataFrame) -> DataFrame:
    """One row per tile: id and both polygon cells, empty text where nothing was found."""
    ids = population.select("pair_id").distinct()
    wide = cells.groupBy("pair_id").agg(*[
        F.max(F.when(F.col("class_name") == c, F.col("cell"))).alias(c) for c in ("new_building", "tree_removal")])
    return ids.join(wide, "pair_id", "left").select(
        F.col("pair_id").cast("string").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("new_building", "tree_removal")])


def empty_cell(cell: Column) -> Column:
    """Missing, blank, ``nan``, ``[]`` or ``null``."""
    return is_blank(cell) | F.trim(cell).isin("[]", "null")


def parse_cell(cell: Column) -> Column:
    return F.from_json(cell, RING_TYPE)


def _ring_points(ring: Column) -> Column:
    """Drops the repeated last point of a closed ring."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an open or closed ring."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, turned, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def _cross(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def ring_crosses(ring: Column) -> Column:
    """True when two non-neighbouring edges properly cross; tested inside the row."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n) + 1)

    def with_later(i):
        a, b = at(i), at(i + 1)
        later = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1)))
        return F.exists(later, lambda j: (_cross(a, b, at(j)) * _cross(a, b, at(j + 1)) < 0)
                        & (_cross(at(j), at(j + 1), a) * _cross(at(j), at(j + 1), b) < 0))

    return F.exists(F.sequence(F.lit(0), n - 1), with_later)


def rings(rows: DataFrame, cell: str, keep: list[str]) -> DataFrame:
    """One row per exterior with its first contract violation (NULL when sound)."""
    parsed = rows.filter(~empty_cell(F.col(cell))).withColumn("_p", parse_cell(F.col(cell)))
    bad_json = parsed.filter(F.col("_p").isNull()).select(*keep, F.lit(-1).alias("ring_no"), F.lit(None).cast("array<array<double>>").alias("ring"), F.lit("invalid polygon JSON").alias("reason"))
    each = parsed.filter(F.col("_p").isNotNull()).select(*keep, F.posexplode("_p").alias("ring_no", "_raw")).withColumn("ring", _ring_points(F.col("_raw")))
    points_ok = F.forall("_raw", lambda p: p.isNotNull() & (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    reason = (
        F.when(F.size("_raw") < 3, "fewer than three points").when(~F.coalesce(points_ok, F.lit(False)), "points must be finite pairs")
        .when(ring_crosses(F.col("ring")), "self-crossing").when(ring_area(F.col("ring")) <= 0, "no area")
    )
    return each.select(*keep, "ring_no", "ring", reason.alias("reason")).unionByName(bad_json)


def cell_runs(rows: DataFrame, classes: list[str] = Q.CLASSES) -> DataFrame:
    """(pair_id, class_name, y, x0, x1) of polygon cells, one column per class: the union of every cell's exteriors.

    A cell that breaks the contract fails the job. Exteriors are filled at pixel centres, which is exact for corners on
    the pixel grid, the only ones that exports hold.
    """
    cells = rows.select(F.col("id").alias("pair_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("class_name"), F.col(c).cast("string").alias("cell")) for c in classes])).alias("c")).select("pair_id", "c.*")
    found = rings(cells, "cell", R.TILE)
    reject_any(found.filter(F.col("reason").isNotNull()).select("pair_id", "class_name", "reason"), "polygon cells must be valid")
    each = footprint_runs(found.select(*R.TILE, "ring_no", F.array("ring").alias("rings")), [*R.TILE, "ring_no"])
    return R.combine({"m": each.drop("ring_no")}, F.col("m") > 0)


def _crossing_rings(points: np.ndarray) -> np.ndarray:
    """``ring_crosses`` of many open rings (ring, point, axis) of equal size."""
    crossed, n = np.zeros(len(points), dtype=bool), points.shape[1]
    ahead = np.roll(points, -1, axis=1)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for i in range(n - 2):
        later = slice(i + 2, n - 1 if i == 0 else n)
        a, b, c, d = points[:, i: i + 1], ahead[:, i: i + 1], points[:, later], ahead[:, later]
        crossed |= ((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any(axis=1)
    return crossed


def _bad_rings(x: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray, cells: int = 1_000_000) -> np.ndarray:
    """Open rings that cross themselves or have no area; ``cells`` bounds the points that are compared at once."""
    bad = np.zeros(len(size), dtype=bool)
    for n in np.unique(size):
        every = np.flatnonzero(size == n)
        for low in range(0, len(every), step := max(1, cells // int(n))):
            which = every[low: low + step]
            at = first[which][:, None] + np.arange(n)
            points = np.stack([x[at], y[at]], axis=2)
            ahead = np.roll(points, -1, axis=1)
            terms = points[..., 0] * ahead[..., 1] - ahead[..., 0] * points[..., 1]
            bad[which] = _crossing_rings(points) | (np.abs(np.cumsum(terms, axis=1)[:, -1]) / 2 <= 0)
    return bad


def _rows_of(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, first number, first row): rows low..high-1 of every owner under numbers of their own, one owner after another; ``owner`` is sorted."""
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    bottom, top = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
    return owner[start], np.cumsum(top - bottom) - (top - bottom), bottom


def _ring_runs(ring: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, y0: np.ndarray, y1: np.ndarray):
    """Runs (ring, y, x0, x1) of rings from their edges, as in ``geo.footprint_runs``; edges are ordered by ring and span the rows y0..y1-1."""
    count = y1 - y0
    e = np.repeat(np.arange(len(ring)), count)
    y = y0[e] + np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count)
    x = np.ceil(ax[e] + (y + 0.5 - ay[e]) / (by[e] - ay[e]) * (bx[e] - ax[e]) - 0.5).astype(np.int64)
    rings, number, bottom = _rows_of(ring, y0, y1)
    place = np.searchsorted(rings, ring)[e]
    left = x.min()
    span = int(x.max() - left) + 1
    order = np.sort((number[place] + y - bottom[place]) * span + x - left)  # crossings of a row come in pairs
    row, x = order[0::2] // span, order % span + left
    at = np.searchsorted(number, row, side="right") - 1
    keep = x[1::2] > x[0::2]
    return rings[at][keep], (row - number[at] + bottom[at])[keep], x[0::2][keep], x[1::2][keep]


def _union_areas(owner: np.ndarray, side: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, total: int) -> np.ndarray:
    """``scoring.AREAS`` of owners 0..total-1 from the runs of both sides, by one sweep; ``owner`` is sorted."""
    owners, number, bottom = _rows_of(owner, y - 1, y + 2)
    left = x0.min() - 1
    span, place = int(x1.max() - left) + 2, np.searchsorted(owners, owner)
    row = number[place] + y - bottom[place]
    events = []  # where, what it belongs to (side plain, side grown), and whether it ends, in one number
    for dy, grown in ((0, 0), (-1, 1), (0, 1), (1, 1)):
        at = (row + dy) * span - left
        kind = (side + 2 * grown) * 2
        events += [(at + x0 - grown) * 8 + kind, (at + x1 + grown) * 8 + kind + 1]
    events = np.sort(np.concatenate(events))
    where, kind = events >> 3, events & 7
    p, t, pg, tg = (np.cumsum((kind == 2 * k).astype(np.int8) - (kind == 2 * k + 1), dtype=np.int32)[:-1] > 0 for k in range(4))
    length, mine = np.diff(where), owners[np.searchsorted(number, where[:-1] // span, side="right") - 1]
    return np.stack([np.bincount(mine[m], length[m], total) for m in (p, t, p & t, p & tg, t & pg)]).astype(np.int64)


def _cell_areas(classes: list[str], crossings: int = 1_000_000):
    """Arrow kernel: ``scoring.AREAS`` of whole tiles from the parsed cells of both sides, and whether a tile and class breaks the contract: an id that
    does not stand once on each side, or a cell with a ring that ``rings`` gives a reason for. ``crossings`` bounds the row crossings that are held at once."""

    def run(table: pa.Table) -> pa.Table:
        fresh, side = table.column("_at").to_numpy() == 1, table.column("side").to_numpy().astype(np.int64)
        tile = np.cumsum(fresh) - 1
        tiles, many = int(fresh.sum()), len(classes)
        total = tiles * many
        once = (np.bincount(tile[side == 0], minlength=tiles) == 1) & (np.bincount(tile[side == 1], minlength=tiles) == 1)
        once &= table.column("id").take(pa.array(np.flatnonzero(fresh))).is_valid().to_numpy(zero_copy_only=False)
        bad, parts = np.repeat(~once, many), []
        flat = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(many):
            cells = table.column(f"_cell{i}").combine_chunks()
            unread = cells.is_null().to_numpy(zero_copy_only=False) & ~table.column(f"_empty{i}").to_numpy()
            bad[tile[unread] * many + i] = True
            ring = cells.flatten()
            point = ring.flatten()
            value = point.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
            cell_of, sizes, pairs = np.repeat(np.arange(len(tile)), flat(cells)), flat(ring), flat(point)
            ring_of = np.repeat(np.arange(len(sizes)), sizes)
            sound = sizes >= 3
            sound[ring_of[pairs != 2]] = False
            sound[ring_of[np.repeat(np.arange(len(pairs)), pairs)[~np.isfinite(value)]]] = False
            own = tile[cell_of] * many + i
            bad[own[~sound]] = True
            xy = value[np.repeat(sound[ring_of], pairs)].reshape(-1, 2)
            parts.append((own[sound], side[cell_of][sound], sizes[sound], xy))
        own, of, size = (np.concatenate(v) for v in list(zip(*parts))[:3])
        x, y = np.concatenate([p[3] for p in parts]).T
        areas = np.zeros((len(Q.AREAS), total), dtype=np.int64)
        if len(own):
            first = np.cumsum(size) - size
            last = first + size - 1
            closed = (x[first] == x[last]) & (y[first] == y[last])
            n = size - closed
            wrong = _bad_rings(x, y, first, n)
            bad[own[wrong]] = True
            order = np.argsort(own, kind="stable")
            order = order[~bad[own[order]]]
            own, of, n, first = own[order], of[order], n[order], first[order]
            r = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            a, b = first[r] + step, first[r] + (step + 1) % n[r]
            ax, ay, bx, by = x[a], y[a], x[b], y[b]
            y0, y1 = (np.ceil(f(ay, by) - 0.5).astype(np.int64) for f in (np.minimum, np.maximum))
            k = np.flatnonzero((ay != by) & (y1 > y0))
            edges = [v[k] for v in (r, ax, ay, bx, by, y0, y1)]
            upto, mine, low = np.cumsum(edges[6] - edges[5]), own[edges[0]], 0
            while low < len(k):  # whole tiles and classes at a time
                high = np.searchsorted(upto, (upto[low - 1] if low else 0) + crossings, side="right")
                high = np.searchsorted(mine, mine[max(high - 1, low)], side="right")
                ring, *runs = _ring_runs(*[v[low:high] for v in edges])
                if len(ring):
                    areas += _union_areas(own[ring], of[ring], *runs, total)
                low = int(high)
        out = pa.table({"pair_id": table.column("id").take(pa.array(np.repeat(np.flatnonzero(fresh), many))), "class_name": pa.array(classes * tiles, pa.string())})
        for name, values in [*zip(Q.AREAS, areas), ("bad", bad)]:
            out = out.append_column(name, pa.array(values))
        return out

    return run


def _reject_cells(predictions: DataFrame, truth: DataFrame, classes: list[str]) -> None:
    """Raises with examples of what breaks the contract of ``score_cells``."""
    for name, rows in (("prediction", predictions), ("ground truth", truth)):
        reject_any(rows.groupBy("id").count().filter("count > 1"), f"{name} ids must be unique")
    reject_any(alignment_mismatch(predictions.select("id"), truth.select("id")), "prediction ids differ from ground truth")
    for rows in (predictions, truth):
        cell_runs(rows, classes)
    raise ContractError("polygon cells must be valid")


def score_cells(predictions: DataFrame, truth: DataFrame, classes: list[str] = Q.CLASSES) -> DataFrame:
    """Class scores of polygon tables (id and a cell per class). Ids must be unique and the same on both sides.

    The cells of a tile meet as text, once, and are read, checked, filled and compared there, so only areas leave a tile. What breaks the contract
    is counted on the way and looked up only where there is any.
    """
    kind = truth.schema["id"].dataType
    both = [rows.select(F.col("id").cast(kind).alias("id"), F.lit(side).alias("side"), *[F.col(c).cast("string").alias(f"_text{i}") for i, c in enumerate(classes)])
            for side, rows in enumerate((predictions, truth))]
    parsed = {f"_empty{i}": empty_cell(F.col(f"_text{i}")) for i in range(len(classes))}
    parsed |= {f"_cell{i}": F.when(~parsed[f"_empty{i}"], parse_cell(F.col(f"_text{i}"))) for i in range(len(classes))}
    shape = f"pair_id {kind.simpleString()}, class_name string, {', '.join(f'{c} long' for c in Q.AREAS)}, bad boolean"
    areas = R.whole_groups(R.tile_partition(both[0].unionByName(both[1]), ["id"]), ["id"], ["side"], _cell_areas(classes), shape, parsed)
    counts = cut(Q.confusion(Q.outcomes_of_areas(areas, R.TILE, "bad"), ["class_name", "bad"]))
    if counts.filter("bad").limit(1).count():
        _reject_cells(predictions, truth, classes)
    return Q.class_scores(counts.drop("bad"))
