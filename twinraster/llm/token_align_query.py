"""op12: byte-level tokens and sentence pieces of all documents, aligned."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import register
from .common import stored, table
from .token_align import align, scored

MERGES, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


@register("op12_token_align")
def op12_token_align(spark, sf_dir):
    return aligned_counts(table(spark, sf_dir, "documents"))


def aligned_counts(docs):
    """Counts of tokens, groups and links of ``docs`` (doc_id, text), their counts in the corpus and the digest of the groups."""
    import public_tokenizers  # its files are needed to run this query, not to list it

    found = align(docs.select("doc_id", "text"), public_tokenizers.path(MERGES), public_tokenizers.path(MODEL))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(found.withColumn("groups_sha256", digest).drop("text", "groups"), "token-align")
    return scored(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
