"""op7: near-duplicate classes of all documents."""
from __future__ import annotations

from . import register
from .common import table
from .near_dedup import near_duplicates


@register("op7_near_dedup")
def op7_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
