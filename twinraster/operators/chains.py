"""Multi-step jobs built from the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources import tables as S
from . import graph as G
from . import integrity as I
from . import manifest as M
from . import runs as R
from . import scoring as Q
from . import splits as P
from . import sweep as W


def build_dataset(rows: DataFrame, keys: list[tuple[str, str]], path: str, fraction: float = 0.2, seed: int = 0, dry_run: bool = False,
                  strategy: str = "region", buffer: float = 0.0, one_sided: bool = False) -> DataFrame:
    """Eligible rows, group-safe split, leakage assertion and CSV sinks; returns counts per outcome. Groups also follow boxes and states, as
    ``graph.geographic_groups`` says. Rows of a single group can't be split: that is an error, or with ``one_sided`` all of them are training rows."""
    labelled = G.geographic_groups(rows, keys, strategy, buffer)
    approved, excluded = M.split_by_eligibility(labelled)
    split = cut(P.fraction_split(approved, "group_id", fraction, seed))
    if not one_sided:
        P.both_sides(split)
    S.reject_any(P.leakage_groups(split, "group_id"), "train and validation share a group")
    if not dry_run:
        text = [c for c, t in split.dtypes if t == "string"]
        S.write_report_csv(split, path + "/split", text)
        S.write_report_csv(excluded, path + "/excluded", [c for c in excluded.columns if c in text or c == "exclusion_reason"])
    return split.groupBy(F.col("split").alias("outcome")).count().unionAll(
        excluded.agg(F.count(F.lit(1)).alias("count")).select(F.lit("excluded"), "count"))


def decide(maps: DataFrame, presence: DataFrame, *, width: int, height: int, pixel: float, presence_min: float | None, min_area: int, min_pos_area: int,
           stable: DataFrame | None = None, keep_pairs: DataFrame | None = None) -> DataFrame:
    """Presence gate, mask, components, area filter, component veto and pair veto in one plan.

    ``stable`` holds (owner) rows that may stay, ``keep_pairs`` the pairs that may stay.
    Gates run before pixels and components so that vetoed tiles are pruned early.
    """
    px = maps.filter(F.col("p") >= pixel)
    if presence_min is not None:
        px = px.join(presence.filter(F.col("presence") >= presence_min), R.TILE, "left_semi")
    if keep_pairs is not None:
        px = px.join(keep_pairs, "pair_id", "left_semi")
    lab = R.keep_large(R.label_components(R.to_runs(R.tile_partition(px)), width, height), min_area)
    if stable is not None:
        lab = lab.join(stable, [*R.TILE, "component_id"], "left_semi")
    total = F.sum(F.col("x1") - F.col("x0")).over(Window.partitionBy(*R.TILE))
    return lab.withColumn("_t", total).filter(F.col("_t") >= min_pos_area).select(*R.TILE, "component_id", "y", "x0", "x1")


def validate(pred: DataFrame, truth: DataFrame, population: DataFrame, width: int, height: int | None = None, objective=None) -> DataFrame:
    """Guards, outcomes and the report over exported exteriors; ``objective`` is any DataFrame -> DataFrame over outcomes.

    ``pred`` holds labelled runs, ``truth`` runs. Both are scored as the polygons that an export would hold: every component with its holes
    filled, and none of the truth too small to count.
    """
    population = cut(population.select(*R.TILE))  # read by both guards and by the outcomes
    S.reject_any(population.groupBy(*R.TILE).count().filter("count > 1"), "population rows must be unique")
    areas = cut(Q.exterior_areas(pred, truth, width, height))
    found = areas.filter("pred_area > 0").select(F.col("pair_id").alias("id"))
    S.reject_any(W.alignment_mismatch(found, population.select(F.col("pair_id").alias("id"))).filter("side = 'extra'"), "predictions outside the population")
    out = Q.outcomes_of_areas(population.join(areas, R.TILE, "left").fillna(0, Q.AREAS))
    return out.transform(objective) if objective is not None else Q.final_score(Q.class_scores(Q.confusion(out, ["class_name"])))


def compare_rules(kept: DataFrame, truth: DataFrame, population: DataFrame, rules: list[str], min_area: float = Q.MIN_PREDICTION_AREA) -> DataFrame:
    """Class metrics per (population, rule): every rule in one plan.

    ``kept`` has runs with a ``rule`` column; ``population`` has a ``population`` column.
    """
    keys = [*R.TILE, "rule"]
    every = F.explode(F.array(*[F.lit(r) for r in rules]))
    out = Q.tile_outcomes(kept.select(*keys, "y", "x0", "x1"), truth.withColumn("rule", every), population.select(*R.TILE).withColumn("rule", every), keys, min_area)
    out = out.join(population.select(*R.TILE, "population"), R.TILE)
    scored = Q.class_scores(Q.confusion(out, ["population", "rule", "class_name"]))
    return scored.join(Q.no_change_counts(out, ["population", "rule"]).select("population", "rule", "no_change_count", "no_change_fp_any"), ["population", "rule"])


def audit_dataset(rows: DataFrame, keys: list[tuple[str, str]], labels: DataFrame, shifts: DataFrame, path: str, width: int, height: int, buffer: float = 0.0) -> DataFrame:
    """Provenance, groups, leakage, duplicates, distribution and shifts; 7 CSV and 5 JSON outputs; verdict row.

    ``rows`` carries id, pair_id, split and content_hash besides the manifest columns.
    """
    audited = cut(G.label_groups(M.provenance(rows), G.location_edges(rows, keys, buffer=buffer)))
    samples = cut(I.sample_distribution(labels, width, height))
    leaks = cut(P.leakage_groups(audited, "group_id"))
    members = P.leakage_members(audited, "group_id", ["year_pre", "year_post"]).withColumn("reason", F.lit("shared spatial/source group"))
    copies = cut(P.duplicate_content(audited, "content_hash"))
    repeated = P.duplicate_pairs(audited.select("id", "content_hash", "doc_id"), ["content_hash"], "doc_id")
    issues = repeated.select("id", F.lit("warning").alias("severity"), F.concat(F.lit("duplicate pair: "), "previous_id").alias("reason")).unionByName(
        shifts.filter(F.col("reliable") & (F.col("magnitude") > 4)).select("id", F.lit("warning").alias("severity"), F.lit("alignment shift >4 pixels").alias("reason")))
    text = [c for c, t in audited.dtypes if t in ("string", "boolean", "bigint", "int")]
    S.write_report_csv(audited, f"{path}/audited_manifest", [c for c in S.manifest_columns(text) if c in audited.columns])
    S.write_report_csv(audited, f"{path}/sample_provenance", ["id", "source", "region_id", "year_pre", "year_post", "synthetic", "mock", "license_status", "audit_status", "audit_training_eligible", "audit_reason"])
    S.write_report_csv(issues, f"{path}/suspicious_samples", ["id", "severity", "reason"])
    S.write_report_csv(members, f"{path}/spatial_leakage", ["group_id", "id", "split", "n_opposite", "reason"])
    S.write_report_csv(members.withColumn("span", F.concat_ws("->", "year_pre", "year_post")), f"{path}/temporal_leakage", ["group_id", "id", "split", "span", "n_opposite", "reason"])
    S.write_report_csv(shifts, f"{path}/alignment", ["id", "magnitude", "reliable"])
    S.write_report_csv(samples, f"{path}/sample_distribution", ["pair_id", "category", "valid_pixels", "ignored_pixels", "new_building_pixels", "tree_removal_pixels", "new_building_components", "tree_removal_components"])
    totals = I.distribution_totals(samples)
    S.write_report_json(totals, f"{path}/class_distribution.json")
    S.write_report_json(leaks, f"{path}/split_audit.json")
    S.write_report_json(I.shift_summary(shifts), f"{path}/alignment.json")
    S.write_report_json(copies, f"{path}/duplicate_images.json")
    S.write_report_json(audited.filter("synthetic").groupBy("source").count(), f"{path}/synthetic_audit.json")
    one = lambda df: df.withColumn("_k", F.lit(1))
    people = audited.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if("mock").alias("mock_samples"), F.count_if(~F.col("audit_training_eligible")).alias("ineligible_samples"))
    bad = leaks.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("leaks"))
    partial = samples.join(audited.filter("split = 'val'").select("pair_id"), "pair_id", "left_semi").agg(F.count_if(F.col("ignored_pixels") > 0).alias("partial_val_samples"), F.count(F.lit(1)).alias("_v"))
    usable = audited.join(samples.select("pair_id"), "pair_id", "left_semi").agg(F.count(F.lit(1)).alias("usable_samples"))
    odd = issues.agg(F.countDistinct("id").alias("suspicious_samples"))
    table = one(totals)
    for part in (people, bad, partial, usable, odd):
        table = table.join(one(part), "_k")
    return M.readiness(table.drop("_k", "_v"))
