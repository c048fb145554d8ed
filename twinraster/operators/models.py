"""Feature contracts, weights, logistic fits, scoring and evidence-based filtering."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, reasons, sigmoid
from ..session import cut
from . import runs as R

# Masses of the label x origin strata and the out-of-fold grid.
STRATUM_MASS = {(1, True): 0.5, (1, False): 0.5, (0, True): 0.75, (0, False): 0.25}
OOF_GRID = [round(0.20 + 0.05 * i, 2) for i in range(13)]
RECALL_FLOOR = {"new_building": (0.88, 0.55), "tree_removal": (0.94, 0.20)}


# --- contracts ------------------------------------------------------------------------

def candidate_violations(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) for shares outside [0, 1], negative areas and non-finite values."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))
    out = lambda c: bad(c) | (F.col(c) < 0) | (F.col(c) > 1)
    why = reasons(*[(out(c), c) for c in ("score", "confidence", "stability", "reverse")], (bad("area") | (F.col("area") < 0), "area"))
    return candidates.select(*keys, F.explode(why).alias("reason"))


def lenient(features: DataFrame, names: list[str]) -> DataFrame:
    """Missing or non-finite features count as 0."""
    safe = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    return features.withColumns({n: safe(n) if n in features.columns else F.lit(0.0) for n in names})


def parameter_violations(parameters: DataFrame, schema: list[str] | None = None) -> DataFrame:
    """(model, reason) of a parameter table (model, feature, pos, mean, scale, weight, lower, upper, threshold)."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf"))
    row = F.explode(reasons(
        (~(finite("mean") & finite("scale") & finite("weight")), "values must be finite"),
        (F.col("scale") <= 0, "scale must be positive"),
        (F.col("lower") > F.col("upper"), "support bounds are reversed"),
        (~F.col("threshold").between(0, 1), "threshold must be in [0,1]"),
    ))
    per_row = parameters.select("model", row.alias("reason")).distinct()
    repeated = parameters.groupBy("model", "feature").count().filter("count > 1").select("model", F.lit("duplicate feature").alias("reason")).distinct()
    out = per_row.unionByName(repeated)
    if schema is not None:
        expected = F.array_position(F.array(*[F.lit(n) for n in schema]), F.col("feature")) - 1
        wrong = parameters.filter(expected != F.col("pos")).select("model", F.lit("feature order differs").alias("reason")).distinct()
        short = parameters.groupBy("model").agg(F.countDistinct("feature").alias("n")).filter(F.col("n") != len(schema)).select("model", F.lit("feature list differs").alias("reason"))
        out = out.unionByName(wrong).unionByName(short)
    return out


# --- weights and moments -----------------------------------------------------------------

def stratum_weights(rows: DataFrame, cls: str = "class_name", label: str = "label", real: str = "real") -> DataFrame:
    """Adds ``weight``: both labels carry half the mass; origins share it in fixed proportion. The table of strata, a row per class, label and origin, is
    broadcast: rows exchanged by stratum would meet in a handful of tasks."""
    mass = F.when((F.col(label) == 0) & F.col(real), STRATUM_MASS[(0, True)]).when((F.col(label) == 0), STRATUM_MASS[(0, False)]).otherwise(0.5)
    sizes = rows.groupBy(cls, label, real).agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", mass)
    share = F.col("_m") / F.sum("_m").over(Window.partitionBy(cls, label))
    total = F.sum("_n").over(Window.partitionBy(cls))
    table = sizes.withColumn("weight", 0.5 * share / F.col("_n") * total).select(cls, label, real, "weight")
    return rows.join(F.broadcast(table), [cls, label, real])


def weighted_moments(rows: DataFrame, by: list[str], names: list[str], weight: str = "weight", floor: float = 1e-3) -> DataFrame:
    """(by, feature, mean, scale, lower, upper); spreads are taken around the mean in a second pass, so large values keep their digits. The means, a row per
    group and feature, are broadcast to that pass."""
    long = rows.select(*by, F.col(weight).alias("w"), F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])))
    g = long.groupBy(*by, "feature").agg(
        F.sum("w").alias("_w"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"), F.min("v").alias("lower"), F.max("v").alias("upper"))
    g = cut(g)
    off = F.col("v") - F.col("mean")
    spread = long.join(F.broadcast(g.select(*by, "feature", "mean")), [*by, "feature"]).groupBy(*by, "feature").agg(F.sum(F.col("w") * off * off).alias("_q"))
    return g.join(spread, [*by, "feature"]).select(*by, "feature", "mean", F.greatest(F.sqrt(F.col("_q") / F.col("_w")), F.lit(floor)).alias("scale"), "lower", "upper")


# --- logistic fits --------------------------------------------------------------------------

def _sums(table: DataFrame, work, width: int) -> np.ndarray:
    """Adds up a vector of partial sums computed per Arrow batch; ``width`` numbers reach the driver."""
    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                y, w, held, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "held", "n"))
                total += work(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), y, w, held, n)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(width, dtype=np.int32)), "v": pa.array(total)})

    rows = table.mapInArrow(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.pos] = r.v
    return out


def design(rows: DataFrame, names: list[str], label: str, weight: Column | None = None, held: Column | None = None) -> DataFrame:
    """Checkpointed (x, y, w, held, n) table; the last entry of ``x`` is the intercept. Equal rows are one row that counts ``n`` times, as every pass of a
    fit goes over the table."""
    features = [f"_x{i}" for i in range(len(names))]
    given = rows.select(*[F.col(c).cast("double").alias(x) for c, x in zip(names, features)], F.col(label).cast("double").alias("y"),
                        (F.lit(1.0) if weight is None else weight).alias("w"), (F.lit(-1) if held is None else held).cast("int").alias("held"))
    equal = given.groupBy(*given.columns).agg(F.count(F.lit(1)).alias("n"))
    return cut(equal.select(F.array(*features, F.lit(1.0)).alias("x"), "y", "w", "held", "n"))


def fold_moments(table: DataFrame, d: int, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of every model's training rows, and its label counts; the spread is summed around the mean."""
    def first(x, y, w, held, n):
        return np.concatenate([np.concatenate([m @ x[:, :d], [m.sum(), m @ y]]) for m in (np.where(held != k, n, 0) for k in range(models))])

    t = _sums(table, first, models * (d + 2)).reshape(models, d + 2)
    count = t[:, d]
    mean = t[:, :d] / count[:, None]

    def second(x, y, w, held, n):
        return np.concatenate([np.where(held != k, n, 0) @ (x[:, :d] - mean[k]) ** 2 for k in range(models)])

    spread = np.sqrt(_sums(table, second, models * d).reshape(models, d) / count[:, None])
    return mean, np.where(spread > 1e-6, spread, 1.0), count, t[:, d + 1]


#: Fixed values of the verifier fit: largest logit, smallest curvature, ridge and tolerance.
LOGIT_CLIP, CURVATURE_FLOOR, RIDGE, TOLERANCE = 40.0, 1e-8, 1e-8, 1e-8


def fit_logistic(table: DataFrame, d: int, models: int = 1, l2: float = 1.0, max_iter: int = 100, tol: float = TOLERANCE, standardise: bool = True, balanced: bool = True):
    """Newton steps for ``models`` logistic fits at once; model k leaves out rows with ``held == k``.

    One job per step returns gradients and Hessians, another the penalised losses before and after the step; where the whole step raises the loss, a third
    one tries its parts, halved up to 26 times. The longest part that doesn't raise the loss is taken. What a job returns depends on the number of features only,
    and the d x d solves run on the driver. ``converged`` tells a fit that stopped moving from one that ran out of steps.
    """
    mean, scale, n, pos = fold_moments(table, d, models)
    if not standardise:
        mean, scale = np.zeros_like(mean), np.ones_like(scale)
    beta = np.zeros((models, d + 1))
    size = (d + 1) * (d + 2)
    penalty = np.diag([l2] * d + [0.0])
    parts = 0.5 ** np.arange(1, 27)
    live = set(range(models))

    def rows_of(k, x, y, w, held, n_equal):
        m = held != k
        z = np.column_stack([(x[m, :d] - mean[k]) / scale[k], np.ones(m.sum())])
        # Balanced weights give both labels the same total.
        return z, y[m], w[m] * n_equal[m] * (np.where(y[m] == 1, n[k] / (2 * max(pos[k], 1)), n[k] / (2 * max(n[k] - pos[k], 1))) if balanced else 1.0)

    for _ in range(max_iter):
        current, active = beta.copy(), sorted(live)

        def slopes(*rows):
            out = []
            for k in active:
                z, label, wk = rows_of(k, *rows)
                p = 1 / (1 + np.exp(-np.clip(z @ current[k], -LOGIT_CLIP, LOGIT_CLIP)))
                h = wk * np.maximum(p * (1 - p), CURVATURE_FLOOR)
                out += [z.T @ (wk * (p - label)), (z.T @ (h[:, None] * z)).ravel()]
            return np.concatenate(out)

        sums = _sums(table, slopes, size * len(active)).reshape(len(active), size)
        steps = {
            k: np.linalg.solve(row[d + 1:].reshape(d + 1, d + 1) + penalty + np.eye(d + 1) * RIDGE, row[:d + 1] + penalty @ beta[k])
            for row, k in zip(sums, active)}

        def losses(chosen, lengths):
            """Penalised losses of some models at ``lengths`` of their steps."""
            def work(*rows):
                out = []
                for k in chosen:
                    z, label, wk = rows_of(k, *rows)
                    logits = (z @ current[k])[:, None] - (z @ steps[k])[:, None] * lengths
                    out.append((wk[:, None] * (np.logaddexp(0, logits) - label[:, None] * logits)).sum(axis=0))
                return np.concatenate(out)

            along = _sums(table, work, len(lengths) * len(chosen)).reshape(len(chosen), len(lengths))
            tried = [current[k] - lengths[:, None] * steps[k] for k in chosen]
            return {k: loss + 0.5 * ((t @ penalty) * t).sum(axis=1) for k, loss, t in zip(chosen, along, tried)}

        ends = losses(active, np.array([0.0, 1.0]))
        worse = [k for k in active if not ends[k][1] <= ends[k][0]]
        shorter = losses(worse, parts) if worse else {}
        for k in active:
            good = np.flatnonzero(shorter[k] <= ends[k][0]) if k in shorter else None
            taken = 1.0 if good is None else parts[good[0]] if len(good) else 0.0
            beta[k] -= taken * steps[k]
            if taken * np.abs(steps[k]).max() < tol:
                live.discard(k)
        if not live:
            break
    return [{"mean": mean[k].tolist(), "scale": scale[k].tolist(), "weights": beta[k, :-1].tolist(), "bias": float(beta[k, -1]), "converged": k not in live} for k in range(models)]


def linear_logit(names: list[str], model: dict) -> Column:
    total = F.lit(float(model["bias"]))
    for n, m, s, w in zip(names, model["mean"], model["scale"], model["weights"]):
        total = total + (F.col(n) - float(m)) / float(s) * float(w)
    return total


def linear_probability(names: list[str], model: dict, limit: float = 50.0) -> Column:
    return sigmoid(linear_logit(names, model), limit)


def supported_probability(names: list[str], model: dict, limit: float = 60.0) -> Column:
    """1 when any feature lies outside the range seen in training, else the logistic score."""
    outside = F.lit(False)
    for n, lo, hi in zip(names, model["lower"], model["upper"]):
        outside = outside | (F.col(n) < float(lo)) | (F.col(n) > float(hi))
    return F.when(outside, 1.0).otherwise(linear_probability(names, model, limit))


def out_of_fold(rows: DataFrame, names: list[str], label: str, fold: str, k: int, l2: float) -> tuple[DataFrame, dict]:
    """(rows with ``oof``, model on all rows); all fold models are fitted together."""
    fits = fit_logistic(design(rows, names, label, held=F.col(fold)), len(names), k + 1, l2)
    score = F.lit(None).cast("double")
    for i in range(k):
        score = F.when(F.col(fold) == i, linear_probability(names, fits[i], 30.0)).otherwise(score)
    return rows.withColumn("oof", score), fits[k]


def threshold_grid(scored: DataFrame, label: str, grid: list[float] = OOF_GRID, by: list[str] = ()) -> DataFrame:
    """Confusion and rates per threshold (and group of ``by``), from one count per (bucket of passed thresholds, label)."""
    levels = sorted(grid)
    passed = F.size(F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda t: t <= F.col("oof")))
    counts = scored.groupBy(*by, passed.alias("bucket"), (F.col(label) == 1).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    t = counts.withColumn("l", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(levels)])))
    hit = F.col("bucket") > F.col("l.i")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = t.groupBy(*by, F.col("l.v").alias("threshold")).agg(
        total(hit & F.col("y")).alias("tp"), total(hit & ~F.col("y")).alias("fp"), total(~hit & F.col("y")).alias("fn"), total(~hit & ~F.col("y")).alias("tn"))
    one = lambda c: F.greatest(c, F.lit(1))
    p, r = F.col("tp") / one(F.col("tp") + F.col("fp")), F.col("tp") / one(F.col("tp") + F.col("fn"))
    return g.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn(
        "f1", F.round(2 * p * r / F.greatest(p + r, F.lit(1e-6)), 4)).withColumn("fp_reduction", F.round(F.col("tn") / one(F.col("tn") + F.col("fp")), 4))


def choose_operating_points(grid: DataFrame) -> DataFrame:
    """(class_name, threshold) from a grid by class: strongest false-alarm reduction above the class's recall floor and up to its highest
    threshold, then the best F1, then the lowest threshold. Where none qualifies, the best F1 for buildings and the highest threshold allowed for trees."""
    of_class = lambda k: reduce(lambda rest, c: F.when(F.col("class_name") == c, RECALL_FLOOR[c][k]).otherwise(rest), RECALL_FLOOR, F.lit(None).cast("double"))
    ok = (F.col("recall") >= of_class(0)) & (F.col("threshold") <= of_class(1))
    low = (-F.col("threshold")).alias("low")
    best = grid.groupBy("class_name").agg(
        F.max_by("threshold", F.when(ok, F.struct("fp_reduction", "f1", low))).alias("chosen"), F.max_by("threshold", F.struct("f1", low)).alias("best_f1"),
        F.max(F.when(F.col("threshold") <= of_class(1), F.col("threshold"))).alias("highest"))
    fallback = F.when(F.col("class_name") == "tree_removal", F.col("highest")).otherwise(F.col("best_f1"))
    return best.select("class_name", F.coalesce("chosen", fallback).alias("threshold"))


# --- labels, filters, veto ---------------------------------------------------------------------

# Shares of a component inside the truth, seen by the review, and its overlap with the truth.
POSITIVE_SHARE, NEGATIVE_SHARE, SEEN_SHARE, POSITIVE_IOU = 0.40, 0.05, 0.95, 0.25


def label_candidates(facts: DataFrame) -> DataFrame:
    """Adds ``label`` (1, 0 or -1 = unknown) from n, overlap, reviewed, partial, total_truth and category."""
    share = F.col("overlap") / F.greatest("n", F.lit(1))
    seen = F.col("reviewed") / F.col("n")
    iou = F.col("overlap") / F.greatest(F.col("n") + F.col("total_truth") - F.col("overlap"), F.lit(1))
    label = (
        F.when(F.col("n") == 0, -1).when(F.col("category").isin("real_negative", "negative"), 0)
        .when(F.col("partial"), F.when(share >= POSITIVE_SHARE, 1).when((seen >= SEEN_SHARE) & (share < NEGATIVE_SHARE), 0).otherwise(-1))
        .when(F.col("total_truth") == 0, 0)
        .when((share >= POSITIVE_SHARE) | (iou >= POSITIVE_IOU), 1).when(share < NEGATIVE_SHARE, 0).otherwise(-1))
    return facts.withColumn("label", label)


def candidate_facts(labelled: DataFrame, truth: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(owner, n, overlap, reviewed, total_truth) from run tables in one sweep per layer set."""
    own = [*R.TILE, "component_id"]
    w = Window.partitionBy(*R.TILE, "y").orderBy("x")
    ends = lambda df, cols: df.select(*R.TILE, "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("s")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("s")))).alias("e"), *cols).select(
        *R.TILE, "y", F.col("e.x").alias("x"), *[(F.col("e.s") * F.col(c)).alias(c) for c in ("o", "t", "r")])
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    layers = ends(labelled, [(F.col("component_id") + 1).alias("o"), zero.alias("t"), zero.alias("r")]).unionByName(ends(truth, [zero.alias("o"), one.alias("t"), zero.alias("r")]))
    if reviewed is not None:
        layers = layers.unionByName(ends(reviewed, [zero.alias("o"), zero.alias("t"), one.alias("r")]))
    seg = layers.select(*R.TILE, (F.lead("x").over(w) - F.col("x")).alias("len"), *[F.sum(c).over(w).alias(c) for c in ("o", "t", "r")]).filter("len > 0")
    hit = lambda c: F.sum(F.when(F.col(c) > 0, F.col("len")).otherwise(0)).cast("long")
    facts = seg.filter("o > 0").groupBy(*R.TILE, (F.col("o") - 1).alias("component_id")).agg(F.sum("len").cast("long").alias("n"), hit("t").alias("overlap"), hit("r").alias("reviewed"))
    total = R.area(truth).withColumnRenamed("area", "total_truth")
    return facts.join(total, R.TILE, "left").fillna(0, ["total_truth"]).select(*own, "n", "overlap", "reviewed", "total_truth")


def filter_components(scored: DataFrame, keep: Column, min_pos_area: float) -> DataFrame:
    """Kept components; a class is cleared when what is left of it is too small."""
    kept = scored.filter(keep)
    alive = kept.groupBy(*R.TILE).agg(F.sum("area").alias("_a")).filter(F.col("_a") >= min_pos_area).select(*R.TILE)
    return kept.join(alive, R.TILE, "left_semi")


def pair_veto(rows: DataFrame, verdicts: DataFrame, cells: list[str]) -> DataFrame:
    """Empty every class cell of rejected pairs; pairs without a verdict pass."""
    j = rows.join(verdicts.select("pair_id", "keep_pair"), "pair_id", "left")
    ok = F.coalesce("keep_pair", F.lit(True))
    return j.select(*[F.when(ok, F.col(c)).otherwise("").alias(c) if c in cells else F.col(c) for c in rows.columns])


def veto_records(records: DataFrame, verdicts: DataFrame, min_pos_area: float = 0.0) -> DataFrame:
    """Component records (pair_id, class_name, area, kept) with ``kept`` as it is after both gates: false for every component of a rejected pair, and for
    those of a class of whose kept components too little area is left, as its cell is emptied."""
    j = records.join(verdicts.select("pair_id", "keep_pair"), "pair_id", "left").withColumn("kept", F.coalesce(F.col("kept"), F.lit(False)) & F.coalesce("keep_pair", F.lit(True))).drop("keep_pair")
    left = j.groupBy(*R.TILE).agg((F.sum(F.when(F.col("kept"), F.col("area")).otherwise(0.0)) >= min_pos_area).alias("_enough"))
    return j.join(left, R.TILE).withColumn("kept", F.col("kept") & F.col("_enough")).drop("_enough")


def separation(candidates: DataFrame, features: list[str], margins: list[float]) -> DataFrame:
    """Mean of each feature for true and other candidates per class, with a separation flag."""
    g = candidates.groupBy("class_name").agg(*[F.avg(F.when(F.col("has_truth") == b, F.col(f))).alias(f"{f}_{n}") for f in features for b, n in ((True, "true"), (False, "other"))])
    return g.select("*", *[(F.col(f"{f}_true") - F.col(f"{f}_other") >= m).alias(f"{f}_separates") for f, m in zip(features, margins)])
