"""op1: quality rules over all documents."""
from __future__ import annotations

from . import register
from .common import table
from .quality_rules import COUNTS, judge


@register("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
