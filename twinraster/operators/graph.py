"""Shared-key edges, spatial adjacency and connected components over DataFrames."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import ContractError, reject_any


def shared_key_edges(rows: DataFrame, keys: list[tuple[str, str]], id_col: str = "id") -> DataFrame:
    """One star edge per row and key value shared by at least two rows.

    ``keys`` are (namespace, column) pairs; columns of one namespace share values.
    The number of edges is linear in the rows whatever the key frequencies are.
    """
    stacked = rows.select(
        F.col(id_col).alias("id"),
        F.explode(
            F.array_distinct(F.array(*[
                F.struct(F.lit(ns).alias("namespace"), F.col(c).cast("string").alias("value")) for ns, c in keys
            ]))
        ).alias("k"),
    ).select("id", "k.namespace", "k.value").filter(F.col("value").isNotNull() & (F.col("value") != ""))
    centres = (
        stacked.groupBy("namespace", "value")
        .agg(F.min("id").alias("centre"), F.max("id").alias("_last"))
        .filter(F.col("centre") != F.col("_last"))
        .drop("_last")
    )
    return (
        stacked.join(centres, ["namespace", "value"])
        .filter(F.col("id") != F.col("centre"))
        .select("namespace", "value", F.col("id").alias("src"), F.col("centre").alias("dst"))
    )


def _forest(edges: int):
    """Arrow kernel: (hi, lo) links that connect what those of the input do, at most one per node and ``edges`` links that are held at once."""

    def spanned(table: pa.Table) -> pa.Table:
        ends = [table.column(c).combine_chunks() for c in ("hi", "lo")]
        codes = pa.concat_arrays(ends).dictionary_encode()
        hi, lo = np.split(codes.indices.to_numpy().astype(np.int64), 2)
        label = np.arange(len(codes.dictionary))
        used = np.zeros(len(hi), dtype=bool)
        while True:  # every set takes the first of the links that leave it; all sets that so meet become one
            a, b = label[hi], label[lo]
            k = np.flatnonzero(a != b)
            if not len(k):
                break
            first = np.full(len(label), len(hi))
            np.minimum.at(first, a[k], k)
            np.minimum.at(first, b[k], k)
            chosen = np.unique(first[first < len(hi)])
            used[chosen] = True
            while True:
                low = np.minimum(label[hi[chosen]], label[lo[chosen]])
                step = label.copy()
                np.minimum.at(step, label[hi[chosen]], low)
                np.minimum.at(step, label[lo[chosen]], low)
                while not np.array_equal(step, step[step]):
                    step = step[step]
                if np.array_equal(step[label], label):
                    break
                label = step[label]
        return table.filter(pa.array(used))

    def run(batches):
        held, count, fresh = [], 0, 0
        for batch in batches:
            held.append(batch)
            count, fresh = count + batch.num_rows, fresh + batch.num_rows
            if fresh >= edges:  # what is left is carried on, until it is mostly forest
                table = spanned(pa.Table.from_batches(held))
                if 2 * table.num_rows > count:
                    yield from table.to_batches()
                    table = table.slice(0, 0)
                held, count, fresh = table.to_batches(), table.num_rows, 0
        if count:
            yield from spanned(pa.Table.from_batches(held)).to_batches()

    return run


def spanning_links(links: DataFrame, edges: int = 200_000) -> DataFrame:
    """(hi, lo) links with the connected sets of ``links``: a task leaves out those that close a circle, so dense links come down to about one per node of a
    task before they are exchanged. Links are kept as they are, none is made up."""
    return links.mapInArrow(_forest(edges), links.schema)


def connected_components(edges: DataFrame, dense: bool = False) -> DataFrame:
    """(node, component) with component = smallest node of the connected set.

    With ``dense`` there may be many more links than nodes; circles among them are left out before the first exchange.
    Alternates two star contractions. Every step is a map-side combined ``min``
    followed by an equi-join against one row per node, so a hub with many
    neighbours never becomes one task's group; AQE splits its side of the join.
    """
    links = (
        edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .filter(F.col("hi") != F.col("lo"))
    )
    links = cut((spanning_links(links) if dense else links).distinct())
    signature = None
    while True:
        both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        nearest = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = (
            both.join(nearest, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        anchor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(anchor, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(rest.union(anchor.select("hi", F.col("m").alias("lo"))).distinct())
        current = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if current == signature:
            break
        signature = current
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


# Columns that tie rows to one place, by the namespace in which their values are compared.
LOCATION_KEYS = [
    ("region_id", "region_id"), ("image", "pre"), ("image", "post"), ("parent_id", "parent_id"), ("pair_id", "pair_id"), ("spatial_group", "spatial_group"),
    ("source_raster", "source_raster"), ("source_raster", "pre_source_raster"), ("source_raster", "post_source_raster"), ("source_raster", "pre_raster"),
    ("source_raster", "post_raster"), ("aoi_id", "aoi_id"), ("location_id", "location_id"),
]
BOX = ["w", "s", "e", "n"]


def location_edges(rows: DataFrame, keys: list[tuple[str, str]] | None = None, strategy: str = "region", buffer: float = 0.0, id_col: str = "id") -> DataFrame:
    """(src, dst) between rows that may show one place: shared keys (those of ``LOCATION_KEYS`` that ``rows`` has, unless given), the state with
    strategy ``state``, and boxes that touch or lie within ``buffer`` where ``rows`` have them (w, s, e, n, in metres of ``crs``).

    Every row needs a region, with strategy ``state`` a state, and a box and its CRS as soon as one row has a box; a buffer needs boxes.
    """
    named = keys if keys is not None else [k for k in LOCATION_KEYS if k[1] in rows.columns]
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    needed = [("region_id", "a geographic split needs region_id on every row")] + ([("state", "a state split needs state on every row")] if strategy == "state" else [])
    for column, message in needed:
        if column not in rows.columns:
            raise ContractError(message)
        reject_any(rows.filter(blank(column)).select(id_col), message)
    if strategy == "state":
        named = [*named, ("state", "state")]
    edges = shared_key_edges(rows, named, id_col).select("src", "dst")
    if not set(BOX) <= set(rows.columns):
        if buffer:
            raise ContractError("a geographic buffer needs bounds and a CRS")
        return edges
    whole = F.col("crs").isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in BOX])
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in BOX])
    seen = rows.agg(F.bool_or(some).alias("some"), F.bool_and(whole).alias("all")).first()
    if seen["some"] and not seen["all"]:
        raise ContractError("all rows need bounds and a CRS when there are any")
    if not seen["some"]:
        return location_edges(rows.drop(*BOX), keys, strategy, buffer, id_col)
    return edges.unionByName(box_adjacency(rows.select(F.col(id_col).alias("id"), *BOX, "crs"), buffer).select("src", "dst"))


def geographic_groups(rows: DataFrame, keys: list[tuple[str, str]] | None = None, strategy: str = "region", buffer: float = 0.0, id_col: str = "id") -> DataFrame:
    """``rows`` with ``group_id``: rows that may show one place, directly or through others, share a group."""
    return label_groups(rows, location_edges(rows, keys, strategy, buffer, id_col), id_col)


def label_groups(rows: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``group_id`` = smallest id of the row's connected set (itself when alone)."""
    parts = connected_components(edges.select("src", "dst"), dense=True)
    return (
        rows.join(parts.withColumnRenamed("node", id_col), id_col, "left")
        .withColumn("group_id", F.coalesce("component", F.col(id_col)))
        .drop("component")
    )


def box_adjacency(boxes: DataFrame, buffer: float = 0.0, cell: float = 64.0, id_col: str = "id") -> DataFrame:
    """Edges (src < dst) between boxes that touch, overlap or lie within ``buffer`` of each other.

    Copies of one box are linked to their smallest id, so a pile of copies costs one
    edge each. Cells double in size from level to level and a box lives on the first
    level whose cells are as large as it is, so it reaches four cells there at most,
    however large it is. Boxes meet on the level of the larger one, and a pair is kept
    only in the first cell both share. With a ``crs`` column only boxes of one meet.
    """
    own = ["crs"] if "crs" in boxes.columns else []
    sides = ["w", "s", "e", "n", *own]
    distinct = boxes.groupBy(*sides).agg(F.min(id_col).alias("id"))
    copies = (
        boxes.select(F.col(id_col).alias("dst"), *sides).join(distinct.withColumnRenamed("id", "src"), sides)
        .filter("src <> dst").select("src", "dst")
    )
    reach = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")) + 2 * buffer
    placed = distinct.withColumn("home", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(reach, F.lit(cell)) / cell))).cast("int"))
    # One row per level: their number is bounded by the exponents of a double.
    levels = sorted(r.home for r in placed.select("home").distinct().collect())
    step = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda c, sign: F.floor((F.col(c) + sign * buffer) / step)
    cells = (
        placed.withColumn("level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("home"))))
        .withColumns({"cx0": at("w", -1), "cx1": at("e", 1), "cy0": at("s", -1), "cy1": at("n", 1)})
        .withColumn("cx", F.explode(F.sequence("cx0", "cx1"))).withColumn("cy", F.explode(F.sequence("cy0", "cy1")))
    )
    a, b = cells.filter("level = home").alias("a"), cells.alias("b")
    dx = F.greatest(F.lit(0.0), F.col("b.w") - F.col("a.e"), F.col("a.w") - F.col("b.e"))
    dy = F.greatest(F.lit(0.0), F.col("b.s") - F.col("a.n"), F.col("a.s") - F.col("b.n"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("level", "cx", "cy")] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own]
    once = (F.col("b.home") < F.col("a.home")) | (F.col("b.home") == F.col("a.home")) & (F.col("a.id") < F.col("b.id"))
    first = (F.col("a.cx") == F.greatest("a.cx0", "b.cx0")) & (F.col("a.cy") == F.greatest("a.cy0", "b.cy0"))
    near = a.join(b, reduce(lambda p, q: p & q, same) & once).filter(first & (dx * dx + dy * dy <= buffer * buffer))
    return near.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst")).unionByName(copies)
