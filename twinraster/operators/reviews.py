"""Applying review decisions to a manifest: every decision is judged first, then rows are accepted or queued."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true, present, reasons
from ..sources.tables import PREDICTION_FIELDS, ContractError, reject_any

MASKS = PREDICTION_FIELDS[1:]
# The source that may be accepted, how names of unrefined evidence begin, and what accepted rows are marked with.
REAL_SOURCE = "NAIP"
CANDIDATE_NAMES = "^(proposed_|hansen_|building_footprint_reference)"
IMAGERY_LICENSE = "USDA NAIP public domain"
ABSENCE_LICENSE = "NAIP public-domain observations; empty absence masks"
DECISION_FIELDS = ["status", "confidence", "notes", "board", "full_tile_reviewed", "alignment_review", "class", "masks", "label_license", "negative_type"]


def review_issues(rows: DataFrame, decisions: DataFrame, evidence: str = "") -> DataFrame:
    """(id, reason) per broken rule of ``decisions`` (id and ``DECISION_FIELDS``; ``masks`` maps a class to a file) on the manifest ``rows`` (id, source and,
    if there is one, synthetic). ``evidence`` documents the licence of the imagery; without it nothing can be accepted."""
    named = rows.select("id", F.col("source").alias("_source"), (is_true(F.col("synthetic").cast("string")) if "synthetic" in rows.columns else F.lit(False)).alias("_synthetic"), F.lit(True).alias("_known"))
    counts = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    t = decisions.join(counts, "id", "left").join(named.dropDuplicates(["id"]), "id", "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    accept, no_change = sure(F.col("status") == "accept"), sure(F.col("class") == "no_change")
    masks = F.coalesce(F.map_keys("masks"), F.array().cast("array<string>"))
    names = F.transform(F.coalesce(F.map_values("masks"), F.array().cast("array<string>")), lambda v: F.regexp_extract(v, "([^/]*)$", 1))
    why = reasons(
        (F.col("_known").isNull(), "unknown id"), (F.coalesce(F.col("_n"), F.lit(2)) > 1, "duplicate id"),
        (~sure(F.col("status").isin("accept", "review", "reject")), "status"), (~sure(F.col("confidence").isin("HIGH", "MEDIUM", "LOW")), "confidence"), (~present(F.col("notes")), "notes"),
        (accept != sure(F.col("confidence") == "HIGH"), "only explicit HIGH decisions are accepted"),
        (accept & (F.col("_synthetic") | ~sure(F.col("_source") == REAL_SOURCE)), f"real {REAL_SOURCE} pairs only"),
        (accept & ~(sure(F.col("full_tile_reviewed")) & present(F.col("board"))), "full-tile review and board"),
        (accept & ~present(F.col("alignment_review")), "alignment decision"), (accept & F.lit(not evidence.strip()), "imagery licence evidence"),
        (accept & no_change & (F.size(masks) > 0), "no_change carries masks"),
        (accept & ~no_change & (F.array_sort(masks) != F.array(*map(F.lit, sorted(MASKS)))), "both reviewed masks and no others"),
        (accept & ~no_change & ~present(F.col("label_license")), "label licence"),
        (accept & ~no_change & F.exists(names, lambda n: n.rlike(CANDIDATE_NAMES)), "candidate evidence is no final mask"),
    )
    return t.select("id", F.explode(why).alias("reason"))


def apply_reviews(rows: DataFrame, decisions: DataFrame, reviewer: str, method: str, evidence: str = "") -> tuple[DataFrame, DataFrame]:
    """(accepted, queue): manifest rows with their decisions. Any broken rule fails the job before anything is decided.

    Accepted rows hold the reviewed masks (``absent`` for a decision of no change), reviewer, method and verified licences in place of audit columns; the queue holds rows
    without a decision (``pending``, UNREVIEWED) and those to review again or rejected.
    """
    if not reviewer.strip() or not method.strip():
        raise ContractError("record the reviewer and the review method")
    reject_any(review_issues(rows, decisions, evidence), "review decisions break the rules")
    joined = rows.join(decisions.select("id", F.struct(*DECISION_FIELDS).alias("_d")), "id", "left")
    said = lambda name: F.col(f"_d.{name}")
    decided = F.col("_d").isNotNull()
    mine = lambda text: F.when(decided, F.lit(text))
    t = joined.withColumns({
        "review_status": F.coalesce(said("status"), F.lit("pending")), "confidence": F.coalesce(said("confidence"), F.lit("UNREVIEWED")),
        "reviewer": mine(reviewer), "review_method": mine(method), "review_notes": said("notes"), "review_board": F.when(decided, F.coalesce(said("board"), F.lit("")))})
    queue = t.filter(F.col("review_status") != "accept").drop("_d")
    quiet = F.coalesce(said("class") == "no_change", F.lit(False))
    accepted = t.filter(F.col("review_status") == "accept").withColumns({
        **{c: F.when(quiet, "absent").otherwise(F.try_element_at(said("masks"), F.lit(c))) for c in MASKS},
        "label_status": F.lit("reviewed"), "label_source": F.lit(reviewer), "mask_source": F.lit(reviewer), "license_status": F.lit("public_domain"), "license_source": F.lit(evidence),
        "imagery_license": F.lit(IMAGERY_LICENSE), "label_license": F.coalesce(said("label_license"), F.lit(ABSENCE_LICENSE)), "license_review_status": F.lit("verified"),
        "provenance_status": F.lit("verified"), "synthetic": F.lit(False), "alignment_review": said("alignment_review"), "negative_type": F.coalesce(said("negative_type"), F.lit(""))})
    return accepted.drop("_d", "audit_training_eligible", "audit_status", "audit_reason"), queue
