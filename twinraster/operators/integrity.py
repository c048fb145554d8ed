"""Label integrity, scope masks, dataset distribution, shifts and edit diagnostics."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reasons
from . import manifest as M
from . import runs as R
from .ordering import exact_quantiles

IGNORED = -100


def in_scope(label: Column, valid: Column, reviewed: Column) -> Column:
    """The label, or -100 outside the scope; what is unknown is inside."""
    inside = F.coalesce(F.coalesce(valid, F.lit(True)) & F.coalesce(reviewed, F.lit(True)), F.lit(True))
    return F.when(inside, label).otherwise(IGNORED)


def scoped_labels(labels: DataFrame, scope: DataFrame, keys: list[str] = ("pair_id", "y", "x")) -> DataFrame:
    """Labels outside the scope become -100; pixels without a scope row are inside."""
    s = scope.select(*keys, F.col("valid").alias("_valid"), F.col("reviewed").alias("_reviewed"))
    return labels.join(s, list(keys), "left").withColumn("label", in_scope(F.col("label"), F.col("_valid"), F.col("_reviewed"))).drop("_valid", "_reviewed")


def exclusive_label(building: Column, tree: Column) -> Column:
    """0/1/2; NULL where the classes overlap, which is an annotation error."""
    return F.when(building & tree, None).when(building, 1).when(tree, 2).otherwise(0)


def label_issues(pixels: DataFrame, declared: DataFrame) -> DataFrame:
    """(pair_id, severity, reason) from (pair_id, building, tree, label) pixels and declared flags."""
    s = pixels.groupBy("pair_id").agg(
        F.count_if(F.col("building") & F.col("tree")).alias("overlap"), F.count_if(F.col("label") == 1).alias("b"), F.count_if(F.col("label") == 2).alias("t"),
        F.count_if(F.col("label") == IGNORED).alias("ignored"), F.count_if(F.col("label") >= 0).alias("seen"), F.bool_and("same").alias("same"))
    j = s.join(declared, "pair_id", "left")
    says = lambda c: F.coalesce(F.col(c), F.lit(False))
    issue = lambda cond, sev, why: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(why).alias("reason")))
    found = F.filter(F.array(
        issue(F.col("overlap") > 0, "error", "overlapping change classes"),
        issue(says("building_present") & (F.col("b") == 0), "error", "new_building: declared positive but empty mask"),
        issue(says("tree_present") & (F.col("t") == 0), "error", "tree_removal: declared positive but empty mask"),
        issue(F.col("ignored") > 0, "warning", "partial review scope; excluded from validation"),
        issue(F.col("seen") == 0, "error", "no reviewed label pixels"),
        issue(F.col("same"), "info", "identical pre/post; legitimate no-change only when reviewed")), lambda i: i.isNotNull())
    return j.select("pair_id", F.explode(found).alias("i")).select("pair_id", "i.severity", "i.reason")


COUNTS = ["background_pixels", "new_building_pixels", "tree_removal_pixels", "valid_pixels", "ignored_pixels", "new_building_components", "tree_removal_components"]


def _count_samples(table: pa.Table) -> pa.Table:
    """Arrow kernel: ``COUNTS`` of whole samples from their labels, ordered by row and column."""
    at, y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("_at", "y", "x"))
    label = table.column("label").fill_null(IGNORED - 1).to_numpy().astype(np.int64)  # a label that is missing counts nowhere
    first = np.flatnonzero(at == 1)
    sample = np.cumsum(at == 1) - 1
    count = lambda which: np.bincount(sample[which], minlength=len(first))
    pieces = []
    for wanted in (1, 2):
        k = np.flatnonzero(label == wanted)
        row = sample[k] * (y.max(initial=0) - y.min(initial=0) + 2) + y[k]  # an empty row between samples
        head = (np.diff(row, prepend=-1) != 0) | (np.diff(x[k], prepend=-2) != 1)
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(k)) - 1
        src, dst = R._touching(row[begin], x[k][begin], x[k][end] + 1, 1) if len(k) else (begin, begin)
        root = R._settle(len(begin), src, dst)
        pieces.append(np.bincount(sample[k][begin][root == np.arange(len(root))], minlength=len(first)))
    out = table.select(["pair_id"]).take(pa.array(first))
    for name, column in zip(COUNTS, [count(label == 0), count(label == 1), count(label == 2), count(label >= 0), count(label == IGNORED), *pieces]):
        out = out.append_column(name, pa.array(column.astype(np.int64)))
    return out


def sample_distribution(labels: DataFrame, width: int, height: int, band_rows: int = 256) -> DataFrame:
    """Per sample: category, pixel counts and 8-connected component counts. Samples of at most ``band_rows`` rows and columns are counted where
    their labels meet; components of larger ones go through runs."""
    if max(width, height) <= band_rows:
        kind = labels.schema["pair_id"].dataType.simpleString()
        out = R.whole_groups(labels.select("pair_id", "y", "x", "label"), ["pair_id"], ["y", "x"], _count_samples, f"pair_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}")
    else:
        counts = labels.groupBy("pair_id").agg(
            F.count_if(F.col("label") == 0).alias("background_pixels"), F.count_if(F.col("label") == 1).alias("new_building_pixels"), F.count_if(F.col("label") == 2).alias("tree_removal_pixels"),
            F.count_if(F.col("label") >= 0).alias("valid_pixels"), F.count_if(F.col("label") == IGNORED).alias("ignored_pixels"))
        marked = labels.filter("label in (1, 2)").select("pair_id", F.when(F.col("label") == 1, "new_building").otherwise("tree_removal").alias("class_name"), "y", "x")
        lab = R.label_components(R.to_runs(R.tile_partition(marked)), width, height, 8, band_rows=band_rows)
        pieces = lab.groupBy("pair_id").agg(*[F.countDistinct(F.when(F.col("class_name") == c, F.col("component_id"))).alias(f"{c}_components") for c in ("new_building", "tree_removal")])
        out = counts.join(pieces, "pair_id", "left").fillna(0, ["new_building_components", "tree_removal_components"])
    return out.withColumn("category", M.category(F.col("new_building_pixels") > 0, F.col("tree_removal_pixels") > 0))


def distribution_totals(samples: DataFrame) -> DataFrame:
    """One row of dataset totals and pixel ratios."""
    cat = lambda c: F.count_if(F.col("category") == c)
    t = samples.agg(
        F.count(F.lit(1)).alias("valid_samples"), cat("negative").alias("background_only"), cat("new_building").alias("new_building_only"), cat("tree_removal").alias("tree_removal_only"), cat("both").alias("both_classes"),
        F.sum("background_pixels").alias("background_pixels"), F.sum("new_building_pixels").alias("building_pixels"), F.sum("tree_removal_pixels").alias("tree_pixels"),
        F.count_if(F.col("new_building_pixels") == 0).alias("empty_building_masks"), F.count_if(F.col("tree_removal_pixels") == 0).alias("empty_tree_masks"))
    total = F.col("background_pixels") + F.col("building_pixels") + F.col("tree_pixels")
    return t.withColumn("building_ratio", F.col("building_pixels") / total).withColumn("tree_ratio", F.col("tree_pixels") / total)


def shift_summary(shifts: DataFrame, limit: float = 4.0) -> DataFrame:
    """Quantiles of reliable shift magnitudes and the number of large ones."""
    m = F.when(F.col("reliable"), F.col("magnitude"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    sums = shifts.agg(F.count(F.lit(1)).alias("estimated"), F.count(m).alias("reliable"), F.avg(m).alias("mean"), F.max(m).alias("max"), F.count_if(m > limit).alias("high_shift"))
    names = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    q = exact_quantiles(shifts.filter("reliable"), "magnitude", list(names.values()))
    q = q.agg(*[F.max(F.when(F.col("share") == v, F.col("quantile"))).alias(n) for n, v in names.items()])
    return one(sums).join(one(q), "_k").drop("_k")


def edit_diagnostics(pixels: DataFrame) -> DataFrame:
    """Changed share inside and outside the truth, distinct colours inside, constant-fill flag.

    ``pixels`` has pair_id, inside, pre_r.. post_b. Colours are counted after a
    distinct on (pair, side, colour), so no colour list is held per pair.
    """
    gap = sum((F.abs(F.col(f"pre_{c}") - F.col(f"post_{c}")) for c in "rgb"), F.lit(0.0))
    rates = pixels.groupBy("pair_id").agg(
        F.avg(F.when(F.col("inside"), (gap > 0).cast("double"))).alias("changed_inside"), F.avg(F.when(~F.col("inside"), (gap > 0).cast("double"))).alias("changed_outside"))
    sides = pixels.filter("inside").select("pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in "rgb"]) for s in ("pre", "post")])).alias("v"))
    colours = sides.distinct().groupBy("pair_id").agg(F.count_if(F.col("v.side") == "pre").alias("pre_colors"), F.count_if(F.col("v.side") == "post").alias("post_colors"))
    return rates.join(colours, "pair_id").withColumn("constant_fill", F.least("pre_colors", "post_colors") <= 1)


def category_violations(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """(pair_id, reason): declared category against masks, and rules for negatives."""
    actual = M.category(F.col("has_building"), F.col("has_tree"))
    j = rows.join(flags, "pair_id")
    declared = F.when(F.col("category").isin("real_negative", "negative"), "negative").otherwise(F.col("category"))
    why = reasons(
        (declared != actual, "category differs from masks"),
        ((F.col("category") == "real_negative") & ~(F.coalesce("accepted", F.lit(False)) & F.coalesce("full_review", F.lit(False))), "real negative lacks accepted full review"),
        ((F.col("category") == "negative") & ~F.col("identical"), "synthetic negative differs from its source"))
    return j.select("pair_id", F.explode(why).alias("reason"))
