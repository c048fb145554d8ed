"""Manifest predicates, verdicts and review rules as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_reason, is_true, present, reasons

# Licence, source and label vocabularies.
APPROVED_LICENSES = ["public_domain", "cc_by_4.0", "commercial_ok", "verified_commercial"]
EXCLUDED_SOURCES = ["levir", "levir_cd", "levir_cd+", "aihub", "ai_hub"]
LOSS_ONLY_SOURCES = ["hansen", "gfc", "hansen_gfc"]
UNREVIEWED_LABELS = ["candidate", "weak_unreviewed", "unreviewed"]
MOCK_TOKENS = ["mock", "demo", "fixture", "test"]
REQUIRED_PROVENANCE = [
    "source", "pre_source", "post_source", "mask_source", "region_id", "year_pre", "year_post",
    "resolution_m", "license_source", "source_url", "label_status", "reviewer",
]


def _get(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def source_tokens(source: Column) -> Column:
    """Normalised parts of a ``a+b`` source cell."""
    return F.transform(F.split(F.coalesce(source, F.lit("")), r"\+"), lambda s: F.replace(F.lower(F.trim(s)), F.lit("-"), F.lit("_")))


def _overlaps(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def is_mock(source: Column) -> Column:
    return _overlaps(F.split(F.lower(F.coalesce(source, F.lit(""))), "_"), MOCK_TOKENS)


# Why a row may not be trained on, in the order of the rules.
ELIGIBILITY_TEXTS = [
    "dataset audit has not approved this sample",
    "source excluded pending competition-compatible rights",
    "missing source provenance",
    "commercial license not verified",
    "Hansen is candidate mining only",
    "labels require high-resolution review",
    "partial weak labels require a review_mask path",
]


def eligibility_reason(df: DataFrame) -> Column:
    """First failing training rule, or ``approved``."""
    tokens = source_tokens(_get(df, "source"))
    licence = F.when(F.col("license_status").isNull(), "unknown").otherwise(F.lower("license_status")) if "license_status" in df.columns else F.lit("unknown")
    return first_reason(
        "approved",
        ((F.lower(_get(df, "audit_status")) == "unverified")
         | F.lower(_get(df, "audit_training_eligible")).isin("false", "0", "no"),
         ELIGIBILITY_TEXTS[0]),
        (_overlaps(tokens, EXCLUDED_SOURCES), ELIGIBILITY_TEXTS[1]),
        (F.trim(_get(df, "source")) == "", ELIGIBILITY_TEXTS[2]),
        (~licence.isin(*APPROVED_LICENSES), ELIGIBILITY_TEXTS[3]),
        (_overlaps(tokens, LOSS_ONLY_SOURCES) | (_get(df, "label_source") == "hansen"), ELIGIBILITY_TEXTS[4]),
        (F.lower(_get(df, "label_status")).isin(*UNREVIEWED_LABELS), ELIGIBILITY_TEXTS[5]),
        ((_get(df, "training_scope") == "review_mask_only") & (_get(df, "review_mask") == ""),
         ELIGIBILITY_TEXTS[6]),
    )


def training_eligibility(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", eligibility_reason(df)).withColumn("eligible", F.col("reason") == "approved")


def split_by_eligibility(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved rows, excluded rows with ``exclusion_reason``)."""
    judged = training_eligibility(df)
    return (judged.filter("eligible").drop("eligible", "reason"),
            judged.filter(~F.col("eligible")).drop("eligible").withColumnRenamed("reason", "exclusion_reason"))


def provenance(df: DataFrame) -> DataFrame:
    """Adds synthetic, mock, audit_status, audit_training_eligible, audit_reason (all reasons, in order)."""
    geographic = ((_get(df, "bounds") != "") & (_get(df, "crs") != "")) | (_get(df, "aoi_id") != "") | (_get(df, "location_id") != "")
    missing = F.filter(F.array(
        *[F.when(F.trim(_get(df, name)) == "", F.lit(name)) for name in REQUIRED_PROVENANCE],
        F.when(~geographic, F.lit("geographic_evidence"))), lambda m: m.isNotNull())
    pre, post = F.expr("try_cast(trim({}) as int)".format("year_pre") if "year_pre" in df.columns else "cast(null as int)"), \
        F.expr("try_cast(trim({}) as int)".format("year_post") if "year_post" in df.columns else "cast(null as int)")
    size = F.expr("try_cast(trim(resolution_m) as double)" if "resolution_m" in df.columns else "cast(null as double)")
    known = pre.isNotNull() & post.isNotNull() & size.isNotNull()
    bad = (pre >= post) | F.isnan(size) | (size == float("inf")) | (size <= 0)
    why = F.filter(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))),
        F.when(is_mock(_get(df, "source")), F.lit("mock imagery/labels; dates and regions are invented")),
        F.when(eligibility_reason(df) != "approved", eligibility_reason(df)),
        F.when(~_get(df, "label_status").isin("reviewed", "verified"), F.lit("labels not explicitly reviewed")),
        F.when((_get(df, "provenance_status") != "verified") | (_get(df, "license_review_status") != "verified"),
               F.lit("documented provenance/license review not verified")),
        F.when(~known, F.lit("acquisition interval/resolution unverified")).when(bad, F.lit("invalid acquisition interval/resolution")),
    ), lambda m: m.isNotNull())
    synthetic = F.lower(_get(df, "synthetic")).isin("true", "1") | F.lower(_get(df, "source")).contains("synthetic")
    return (
        df.withColumn("_why", why)
        .withColumn("synthetic", synthetic).withColumn("mock", is_mock(_get(df, "source")))
        .withColumn("audit_status", F.when(F.size("_why") > 0, "unverified").otherwise("verified"))
        .withColumn("audit_training_eligible", F.size("_why") == 0)
        .withColumn("audit_reason", F.array_join("_why", "; ")).drop("_why")
    )


def bounds_reason(bounds: Column, geographic: bool = False) -> Column:
    """NULL for valid ``[w,s,e,n]`` arrays, else what is wrong."""
    w, s, e, n = (F.get(bounds, F.lit(i)) for i in range(4))
    finite = F.forall(bounds, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rule = F.when(bounds.isNull() | (F.size(bounds) != 4) | ~F.coalesce(finite, F.lit(False)), "four finite coordinates required")
    rule = rule.when((w >= e) | (s >= n), "bounds must increase")
    if geographic:
        rule = rule.when((w < -180) | (e > 180) | (s < -90) | (n > 90), "WGS84 range exceeded")
    return rule


def category(has_building: Column, has_tree: Column) -> Column:
    return (F.when(has_building & has_tree, "both").when(has_building, "new_building")
            .when(has_tree, "tree_removal").otherwise("negative"))


def presence_labels(flags: DataFrame) -> DataFrame:
    """Adds ``presence`` and ``presence_valid`` to (has_pixels, has_review_mask, declared_absent, masked_source)."""
    present_ = F.col("has_pixels")
    valid = ~(F.col("has_review_mask") & ~present_ & ~F.col("declared_absent")) & ~F.col("masked_source")
    return flags.withColumn("presence", present_).withColumn("presence_valid", valid)


# --- review decisions -----------------------------------------------------------

def review_violations(decisions: DataFrame) -> DataFrame:
    """(id, reason) per broken review rule."""
    accept = F.col("status") == "accept"
    no_change = F.col("class") == "no_change"
    why = reasons(
        (~F.coalesce(F.col("status").isin("accept", "review", "reject"), F.lit(False)), "status"),
        (~F.coalesce(F.col("confidence").isin("HIGH", "MEDIUM", "LOW"), F.lit(False)), "confidence"),
        (~present(F.col("notes")), "notes"),
        (accept != (F.col("confidence") == "HIGH"), "accept requires HIGH and HIGH requires accept"),
        (accept & ~(F.col("full_tile_reviewed") & present(F.col("board"))), "full tile review and board"),
        (accept & ~present(F.col("alignment_review")), "alignment note"),
        (accept & ~no_change & ~present(F.col("label_license")), "label licence"),
        (accept & no_change & (F.col("n_masks") > 0), "no_change carries masks"),
        (accept & ~no_change & (F.col("n_masks") < 2), "positive lacks masks"),
    )
    return decisions.select("id", F.explode(why).alias("reason"))


def apply_reviews(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manifest with review outcome; rows without a decision are pending."""
    return manifest.join(decisions.select("id", "status", "confidence", "class"), "id", "left").select(
        *[manifest[c] for c in manifest.columns],
        F.coalesce("status", F.lit("pending")).alias("review_status"),
        F.coalesce("confidence", F.lit("UNREVIEWED")).alias("review_confidence"),
        F.col("class").alias("review_class"),
    )


# --- readiness ------------------------------------------------------------------

# What keeps a dataset from being ready, in order.
BLOCKER_TEXTS = [
    "No reviewed no-change samples for false-positive control",
    "No reviewed new_building masks; target class is missing",
    "No reviewed tree_removal masks; target class is missing",
    "No real training dataset; available samples are mock/demo only",
    "Unverified provenance/license/label review; excluded from training readiness",
    "Image/mask integrity errors",
    "Geographic/temporal isolation is not established or leakage exists",
    "Validation contains partially reviewed masks",
]


def readiness(totals: DataFrame) -> DataFrame:
    """Verdict row from audit totals (one row in, one row out)."""
    blockers = reasons(
        (F.col("background_only") == 0, BLOCKER_TEXTS[0]),
        (F.col("building_pixels") == 0, BLOCKER_TEXTS[1]),
        (F.col("tree_pixels") == 0, BLOCKER_TEXTS[2]),
        ((F.col("total_samples") == 0) | (F.col("mock_samples") == F.col("total_samples")),
         BLOCKER_TEXTS[3]),
        (F.col("ineligible_samples") > 0, BLOCKER_TEXTS[4]),
        (F.col("usable_samples") != F.col("total_samples"), BLOCKER_TEXTS[5]),
        (F.col("leaks") > 0, BLOCKER_TEXTS[6]),
        (F.col("partial_val_samples") > 0, BLOCKER_TEXTS[7]),
    )
    return totals.withColumn("blockers", blockers).withColumn(
        "readiness",
        F.when(F.size("blockers") > 0, "NOT READY").when(F.col("suspicious_samples") > 0, "READY WITH WARNINGS").otherwise("READY"))
