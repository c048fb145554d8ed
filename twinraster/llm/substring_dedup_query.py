"""op3: removal of repeated 35-word windows over all documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import register
from .common import table
from .substring_dedup import remove_repeated_windows


@register("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
