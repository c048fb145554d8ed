"""op13: streaming byte-level BPE over all documents, encoded and decoded again."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import register
from .common import table
from .stream_bpe import decode, encode

VOCABULARY = "byte_bpe_50k.json"


@register("op13_stream_bpe")
def op13_stream_bpe(spark, sf_dir):
    return streamed(table(spark, sf_dir, "documents"))


def streamed(docs):
    """Counts and digests of the whole texts of ``docs`` (doc_id, text), encoded and decoded with the public vocabulary."""
    import public_tokenizers  # its files are needed to run this query, not to list it

    path = public_tokenizers.path(VOCABULARY)
    encoded = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
