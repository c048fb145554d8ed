"""Component matching across views and stability evidence."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R

# When two components may be the same object, and the veto rules.
IOU_MIN, DRIFT_MAX, RATIO_MIN, RATIO_MAX = 0.2, 4.0, 0.25, 4.0
STABILITY_RULES = {"A": (3, 0.0), "B": (4, 0.0), "C": (3, 0.2), "D": (3, 0.3), "E": (3, 0.4)}


def component_shapes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component_id, area, cx, cy) from runs. Centroids are means of cell indices: one division of whole numbers, so that equal ones are equal to
    the last bit and ties between drifts stay ties."""
    n = (F.col("x1") - F.col("x0")).cast("long")
    mean = lambda twice: F.sum(n * twice) / F.lit(2.0) / F.sum(n)
    return labelled.groupBy(*keys, "component_id").agg(
        F.sum(n).cast("double").alias("area"), mean(F.col("x0") + F.col("x1") - 1).alias("cx"), mean(F.col("y") * 2).alias("cy"))


def overlap_by_component(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, overlap): one sweep whose running sums carry the active component ids.

    Within a layer no two components share a cell, so the running sum of
    ``+-(id+1)`` is the id that covers the segment.
    """
    def events(runs, mine, other):
        e = F.explode(F.array(F.struct(F.col("x0").alias("x"), (F.col("component_id") + 1).alias("d")),
                              F.struct(F.col("x1").alias("x"), (-(F.col("component_id") + 1)).alias("d"))))
        return runs.select(*keys, "y", e.alias("e")).select(*keys, "y", F.col("e.x").alias("x"), F.col("e.d").alias(mine), F.lit(0).cast("long").alias(other))

    both = events(a, "i", "j").unionByName(events(b, "j", "i"))
    w = Window.partitionBy(*keys, "y").orderBy("x")
    seg = both.select(*keys, F.col("x"), F.lead("x").over(w).alias("x1"), F.sum("i").over(w).alias("i"), F.sum("j").over(w).alias("j"))
    return (
        seg.filter((F.col("x1") > F.col("x")) & (F.col("i") > 0) & (F.col("j") > 0))
        .groupBy(*keys, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j")).agg(F.sum(F.col("x1") - F.col("x")).cast("double").alias("overlap"))
    )


def match_candidates(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, iou, drift) for pairs with enough overlap, or close centroids and similar size."""
    sa = component_shapes(a, keys).withColumnsRenamed({"component_id": "i", "area": "area_i", "cx": "xi", "cy": "yi"})
    sb = component_shapes(b, keys).withColumnsRenamed({"component_id": "j", "area": "area_j", "cx": "xj", "cy": "yj"})
    overlap = overlap_by_component(a, b, keys)
    cell = lambda c: F.floor(F.col(c) / DRIFT_MAX)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    near = sa.withColumn("gx", around("xi")).withColumn("gy", around("yi")).join(
        sb.withColumn("gx", cell("xj")).withColumn("gy", cell("yj")), [*keys, "gx", "gy"])
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    drift = F.sqrt(dx * dx + dy * dy)  # hypot may differ in the last bit between moves of equal length
    close = near.filter((drift <= DRIFT_MAX) & (F.col("area_j") / F.col("area_i")).between(RATIO_MIN, RATIO_MAX)).select(*keys, "i", "j", F.lit(0.0).alias("overlap"))
    pairs = overlap.unionByName(close).groupBy(*keys, "i", "j").agg(F.sum("overlap").alias("overlap"), F.bool_or(F.col("overlap") == 0).alias("_close"))
    full = pairs.join(sa, [*keys, "i"]).join(sb, [*keys, "j"])
    iou = F.col("overlap") / (F.col("area_i") + F.col("area_j") - F.col("overlap"))
    return (
        full.withColumn("iou", iou).withColumn("drift", drift)
        .filter((F.col("iou") >= IOU_MIN) | F.col("_close"))
        .select(*keys, "i", "j", "iou", "drift", "area_i", "area_j")
    )


def _walk(table: pa.Table) -> pa.Table:
    """Arrow kernel: the greedy walk over the ordered edges of tiles, classes and views."""
    used_i, used_j, taken = set(), set(), []
    for k, (at, i, j) in enumerate(zip(*(table.column(c).to_pylist() for c in ("_at", "i", "j")))):
        if at == 1:
            used_i, used_j = set(), set()
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            taken.append(k)
    return table.drop_columns("_at").take(pa.array(taken, pa.int64()))


def greedy_match(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matching in the total order (-iou, drift, i, j), in one pass over the edges of each group of ``keys``. A group holds
    the neighbouring components of one tile and class, which the image bounds."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields)
    return R.whole_groups(edges, keys, [F.desc("iou"), "drift", "i", "j"], _walk, shape)


def match_components(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return greedy_match(match_candidates(a, b, keys), keys)


def view_stability(identity: DataFrame, auxiliary: DataFrame, views: int, appearance: DataFrame | None = None) -> DataFrame:
    """Persistence, overlap, area and drift statistics of identity components over ``views`` auxiliary views.

    ``auxiliary`` holds labelled runs with a ``view`` column (1..views). ``appearance`` holds labelled runs of a map of its own: it says which
    components it shows too (``appearance_matched``, null without it) and counts in no other statistic.
    """
    keys = [*R.TILE, "view"]
    last = views if appearance is None else views + 1
    if appearance is not None:
        columns = [*keys, "component_id", "y", "x0", "x1"]
        auxiliary = auxiliary.select(columns).unionByName(appearance.withColumn("view", F.lit(last)).select(columns))
    copies = identity.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(last))))
    found = match_components(copies, auxiliary, keys).withColumn("component_id", F.col("i"))
    own = component_shapes(identity, R.TILE)
    # the component itself is one more entry with its area, so that mean and spread come from one merge of central moments
    entries = found.select(*R.TILE, "component_id", "view", "iou", "drift", F.col("area_j").alias("area")).unionByName(
        own.select(*R.TILE, "component_id", F.lit(0).alias("view"), F.lit(None).cast("double").alias("iou"), F.lit(None).cast("double").alias("drift"), "area"))
    counted = F.col("view") <= views
    only = lambda c: F.when(counted, F.col(c))
    t = entries.groupBy(*R.TILE, "component_id").agg(
        F.max(F.when(F.col("view") == 0, F.col("area"))).alias("component_area"), F.count_if(counted).alias("n"), F.coalesce(F.sum(only("iou")), F.lit(0.0)).alias("_iou"),
        F.min(only("iou")).alias("_min"), F.max(only("iou")).alias("_max"), F.avg(only("area")).alias("mean"), F.stddev_pop(only("area")).alias("std"),
        F.avg(only("drift")).alias("_d"), F.max(only("drift")).alias("_dm"), F.bool_or(~counted).alias("_shown"))
    n, zero = F.col("n"), F.lit(0.0)
    return t.select(
        *R.TILE, "component_id", "component_area", n.alias("persistence_count"), (n / (views + 1)).alias("persistence_fraction"),
        (F.col("_iou") / views).alias("mean_matching_iou"), F.when(n == views + 1, F.col("_min")).otherwise(0.0).alias("minimum_matching_iou"),
        F.coalesce("_max", zero).alias("maximum_matching_iou"), F.col("mean").alias("matching_area_mean"), F.col("std").alias("area_std"), (F.col("std") / F.col("mean")).alias("area_cv"),
        F.coalesce("_d", zero).alias("centroid_mean_drift"), F.coalesce("_dm", zero).alias("centroid_max_drift"),
        (F.lit(None).cast("boolean") if appearance is None else F.col("_shown")).alias("appearance_matched"))


def identity_confidence(identity: DataFrame, maps: DataFrame) -> DataFrame:
    """Mean and largest probability of every identity component, and ``largest_confidence``: the mean of the largest component of its tile and class
    (of the first one, if several are as large)."""
    cells = R.to_pixels(identity.select(*R.TILE, "component_id", "y", "x0", "x1")).join(maps.select(*R.TILE, "y", "x", "p"), [*R.TILE, "y", "x"])
    own = cells.groupBy(*R.TILE, "component_id").agg(F.avg("p").alias("original_mean_probability"), F.max("p").alias("original_max_probability"), F.count(F.lit(1)).alias("_n"))
    largest = own.groupBy(*R.TILE).agg(F.max_by("original_mean_probability", F.struct("_n", -F.col("component_id"))).alias("largest_confidence"))
    return own.drop("_n").join(largest, R.TILE)


def view_probabilities(identity: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Mean, mean pixelwise spread and consensus share of all views over identity components."""
    cells = R.to_pixels(identity.select(*R.TILE, "component_id", "y", "x0", "x1")).join(maps, [*R.TILE, "y", "x"])
    per = cells.groupBy(*R.TILE, "component_id", "y", "x").agg(
        F.avg("p").alias("m"), F.stddev_pop("p").alias("s"), F.count_if(F.col("p") >= threshold).alias("k"))
    return per.groupBy(*R.TILE, "component_id").agg(
        F.avg("m").alias("tta_prob_mean"), F.avg("s").alias("tta_prob_std"), F.avg((F.col("k") >= 3).cast("double")).alias("consensus_fraction"))


def stability_verdicts(features: DataFrame, rules: dict[str, tuple[int, float]] = STABILITY_RULES, appearance_consistency: bool = False) -> DataFrame:
    """Every component under every rule: ``keep`` when persistent and overlapping enough and, with ``appearance_consistency``, matched in the
    appearance view, without which the job fails."""
    table = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(n).alias("n"), F.lit(float(t)).alias("t")) for k, (n, t) in rules.items()])
    out = features.withColumn("_r", F.explode(table))
    keep = (F.col("persistence_count") >= F.col("_r.n")) & (F.col("mean_matching_iou") >= F.col("_r.t"))
    if appearance_consistency:
        missing = F.raise_error(F.lit("appearance consistency needs the appearance view")).cast("boolean")
        keep = keep & F.coalesce(F.col("appearance_matched"), missing)
    return out.withColumn("rule", F.col("_r.rule")).withColumn("keep", keep).drop("_r")


def reverse_evidence(forward: DataFrame, backward: DataFrame, reverse_maps: DataFrame, threshold: float) -> DataFrame:
    """Reverse-time support of forward components.

    Each component is matched on its own: the best candidate by the total order wins.
    """
    px = R.to_pixels(forward.select(*R.TILE, "component_id", "y", "x0", "x1")).join(reverse_maps, [*R.TILE, "y", "x"])
    stats = px.groupBy(*R.TILE, "component_id").agg(
        F.count(F.lit(1)).cast("double").alias("area"), F.avg("p").alias("reverse_mean_prob"), F.max("p").alias("reverse_max_prob"),
        F.avg((F.col("p") >= threshold).cast("double")).alias("reverse_overlap_fraction"))
    edges = match_candidates(forward, backward, R.TILE)
    best = edges.groupBy(*R.TILE, F.col("i").alias("component_id")).agg(
        F.min_by(F.struct("iou", "area_j"), F.struct((-F.col("iou")).alias("a"), "drift", "j")).alias("b"))
    t = stats.join(best, [*R.TILE, "component_id"], "left")
    other = F.coalesce(F.col("b.area_j"), F.lit(0.0))
    return t.select(*stats.columns, F.coalesce(F.col("b.iou"), F.lit(0.0)).alias("reverse_matching_iou"),
                    F.when(other > 0, F.col("area") / other).otherwise(10.0).alias("area_ratio_forward_reverse"))
