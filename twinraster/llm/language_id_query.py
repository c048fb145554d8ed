"""op9: the language of all documents, learned from three of four folds."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import register
from .common import table
from .language_id import fold, identify, train

HELD_OUT = 2


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    return predicted(table(spark, sf_dir, "documents"))


def predicted(docs):
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
