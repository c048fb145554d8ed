"""op5: byte-level BPE over all documents, encoded and decoded again."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import register
from .byte_bpe import encode_decode
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


@register("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def round_trip(docs):
    """Counts and digests of the whole texts of ``docs`` (doc_id, text), encoded and decoded with the public vocabulary."""
    import public_tokenizers  # its files are needed to run this query, not to list it

    path = public_tokenizers.path(VOCABULARY)
    return encode_decode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
