"""op2: all pages written as WARC records, indexed, looked up and read back."""
from __future__ import annotations

import pyarrow as pa

from ..session import scratch_path
from . import register
from .common import stored, table
from .warc import lookup, read_records, resolved, url_key, write_archives, write_index


@register("op2_warc_index")
def op2_warc_index(spark, sf_dir):
    return through_archives(table(spark, sf_dir, "pages"))


def keyed(pages):
    """(url_key, page_id) of pages: what to ask the index for."""

    def run(batches):
        for batch in batches:
            keys = [url_key(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0)], names=["url_key", "page_id"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url").mapInArrow(run, "url_key string, page_id bigint")


def through_archives(pages):
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    write_index(spark, folder)
    records = stored(read_records(spark, folder, lookup(keyed(pages), folder)), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
