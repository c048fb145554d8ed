"""Boundaries of components as linked run ends, without a pixel table.

A component's boundary consists of the ends of its runs, taken as vertical edges of one row, and of horizontal stretches between
them. On the line between two rows, each run of the row above and of the row below begins and ends once; sorted along the
line, these events come in pairs, and the two events of a pair are joined by a stretch that has the component on one side
only. So following the boundary from edge to edge is one window over the events of a line. A closed walk over the
links is a ring, and the ring with the component's first cell is its exterior.
"""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import connected_components
from .runs import TILE, _settle, tile_partition

#: An edge: its row, its column and whether it is a left end (0) or a right end (1) of a run.
EDGE = ["y", "x", "side"]
NEXT = ["next_y", "next_x", "next_side"]


def boundary_links(labelled: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, component_id, y, x, side, next_y, next_x, next_side): every edge of a component and the one that follows it.

    Walks keep the component on their right: right ends are walked down, left ends up. Where cells of a component touch
    in a corner only, begins come before ends on the line: the walk crosses over to the other cell, so background doesn't leak through corners.
    ``labelled`` holds maximal runs; a window holds the runs of two neighbouring rows of one component.
    """
    end = lambda line, x, side, into: F.struct(F.lit(line).alias("line"), F.col(x).alias("x"), F.lit(side).alias("side"), F.lit(into).alias("into"))
    # a left end is walked from its lower line to its upper one, a right end from its upper to its lower
    ends = F.array(end(0, "x0", 0, True), end(1, "x0", 0, False), end(0, "x1", 1, False), end(1, "x1", 1, True))
    events = labelled.select(*keys, "component_id", "y", F.explode(ends).alias("_e")).select(
        *keys, "component_id", "y", (F.col("y") + F.col("_e.line")).alias("_line"), "_e.x", "_e.side", "_e.into")
    w = Window.partitionBy(*keys, "component_id", "_line").orderBy("x", "side", "y")
    here = F.struct(*EDGE)
    paired = events.select(*keys, "component_id", *EDGE, "into", F.row_number().over(w).alias("_n"), F.lead(here).over(w).alias("_after"), F.lag(here).over(w).alias("_before"))
    partner = F.when(F.col("_n") % 2 == 1, F.col("_after")).otherwise(F.col("_before"))
    return paired.filter("into").select(*keys, "component_id", *EDGE, *[partner[e].alias(n) for e, n in zip(EDGE, NEXT)])


def _codes(table: pa.Table, names: list[str], span: int) -> np.ndarray:
    y, x, side = (table.column(n).to_numpy().astype(np.int64) for n in names)
    return (y * span + x) * 2 + side


def _label_rings(width: int):
    """Arrow kernel: adds the first edge that each edge of a band reaches within the band, as one number."""
    span = width + 1

    def label(table: pa.Table) -> pa.Table:
        code, follow = _codes(table, EDGE, span), _codes(table, NEXT, span)
        order = np.argsort(code)
        place = np.minimum(np.searchsorted(code, follow, sorter=order), len(code) - 1)
        found = order[place]
        inside = code[found] == follow
        rank = np.empty(len(code), dtype=np.int64)  # nodes are numbered by code, so that the smallest number is the first edge
        rank[order] = np.arange(len(code))
        root = _settle(len(code), rank[inside], rank[found[inside]])
        return table.append_column("ring", pa.array(code[order][root[rank]]))

    return label


def label_rings(links: DataFrame, width: int, height: int | None = None, keys: list[str] = TILE, band_rows: int = 256) -> DataFrame:
    """Adds ``ring``: the number (y * (width + 1) + x) * 2 + side of the first edge of the ring that an edge lies on.

    Rings are closed within bands of ``band_rows`` rows by pointer jumping; where an image is taller than a band, the parts are stitched
    by the graph of the links that leave a band.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields)
    if height is not None and height <= band_rows:  # links can't leave the only band
        return links.groupBy(*keys).applyInArrow(_label_rings(width), f"{shape}, ring long")
    banded = links.withColumn("_band", F.floor(F.col("y") / band_rows))
    local = cut(banded.groupBy(*keys, "_band").applyInArrow(_label_rings(width), f"{shape}, _band long, ring long"))
    node = F.struct(*keys, "ring")
    leaving = local.filter(F.floor(F.col("next_y") / band_rows) != F.col("_band")).select(*keys, *[F.col(n).alias(e) for n, e in zip(NEXT, EDGE)], node.alias("src"))
    edges_at_cuts = local.filter((F.col("y") % band_rows == 0) | ((F.col("y") + 1) % band_rows == 0))
    seams = leaving.join(edges_at_cuts.select(*keys, *EDGE, node.alias("dst")), [*keys, *EDGE])
    joined = connected_components(seams.select("src", "dst"))
    return (
        local.withColumn("node", node).join(joined, "node", "left")
        .withColumn("ring", F.coalesce(F.col("component.ring"), F.col("ring"))).drop("node", "component", "_band")
    )


def exterior_edges(labelled: DataFrame, width: int, height: int | None = None, keys: list[str] = TILE, band_rows: int = 256) -> DataFrame:
    """Links of the outer ring of every component. ``component_id`` must be the smallest y*width+x of the component, as
    ``label_components`` gives it: its left end is the first edge of the outer ring."""
    # rows of a tile are placed together before and after the kernel, so that the windows around it need no exchange of their own
    placed = tile_partition(labelled.select(*keys, "component_id", "y", "x0", "x1"), keys)
    found = label_rings(boundary_links(placed, keys), width, height, keys, band_rows)
    first = (F.floor(F.col("component_id") / width) * (width + 1) + F.col("component_id") % width) * 2
    return tile_partition(found.filter(F.col("ring") == first).drop("ring"), keys)


def exterior_runs(edges: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, component_id, y, x0, x1): components with their holes filled, as maximal runs, from their outer edges: along a row they
    lead in and out by turns."""
    w = Window.partitionBy(*keys, "component_id", "y").orderBy("x")
    return edges.select(*keys, "component_id", "y", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), "side").filter("side = 0").drop("side")


def fill_exteriors(labelled: DataFrame, width: int, height: int | None = None, keys: list[str] = TILE, band_rows: int = 256) -> DataFrame:
    """Union of all components with their holes filled: what exported exteriors cover."""
    return exterior_runs(exterior_edges(labelled, width, height, keys, band_rows), keys)


def _walk(table: pa.Table) -> pa.Table:
    """Arrow kernel: the outer edges of one tile and class as JSON rings, in order of component."""
    x, y, side = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "side"))
    span = int(max(x.max(), table.column("next_x").to_numpy().max())) + 1
    code, follow, owner = _codes(table, EDGE, span), _codes(table, NEXT, span), table.column("component_id").to_numpy()
    order = np.lexsort((code, owner))
    code, owner, x, y, side, follow = code[order], owner[order], x[order], y[order], side[order], follow[order]
    by_code = np.argsort(code)
    step = by_code[np.searchsorted(code, follow, sorter=by_code)]
    first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    # list ranking: every edge jumps over twice as many links each time, until it stands on the last edge of its ring
    last = np.isin(step, first)
    jump, left = np.where(last, np.arange(len(code)), step), np.where(last, 0, 1)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        left = left + left[jump]
        jump = further
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(code)))
    walk = np.lexsort((-left, group))
    x, y, side, group = x[walk], y[walk], side[walk], group[walk]
    # an edge gives the corner where it begins and the one where it ends, but for those in the midst of a straight side
    begin, end = np.where(side == 0, y + 1, y), np.where(side == 0, y, y + 1)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(starts, append=len(group))
    ahead = np.arange(len(group)) + 1
    ahead[starts + sizes - 1] = starts
    back = np.empty_like(ahead)
    back[ahead] = np.arange(len(group))
    meets = (x == x[ahead]) & (end == begin[ahead]) & (side == side[ahead])
    corner = np.stack([np.stack([x, begin], 1), np.stack([x, end], 1)], 1).reshape(-1, 2)
    keep = np.stack([~meets[back], ~meets], 1).ravel()
    ring_of = np.repeat(group, 2)[keep]
    points = np.split(corner[keep], np.flatnonzero(np.diff(ring_of)) + 1)
    text = json.dumps([p.tolist() for p in points], separators=(",", ":"))
    return table.select([c for c in table.column_names if c in TILE]).slice(0, 1).append_column("cell", pa.array([text]))


def ring_cells(edges: DataFrame) -> DataFrame:
    """(pair_id, class_name, cell): the JSON exteriors of every tile and class; a group holds the run ends that its text lists."""
    pid = dict(edges.dtypes)["pair_id"]
    return edges.groupBy(*TILE).applyInArrow(_walk, f"pair_id {pid}, class_name string, cell string")
