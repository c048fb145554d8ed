"""op6: candidate secrets in all documents, with the forest's verdict."""
from __future__ import annotations

from . import register
from .common import table
from .secrets_scan import scan


@register("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
