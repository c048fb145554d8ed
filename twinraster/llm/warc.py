"""Web archives with deduplicated payloads, and a two-level capture index over them.

An archive is a run of gzip members, one WARC record each; members are kept as rows (archive, offset, member), so any store that
Spark writes holds them and a filter on archive and offset reads a range. Joined in order of offset they are a ``.warc.gz``.

The index sorts reversed-host URL keys over all partitions and packs them into compressed blocks; the sparse directory keeps
the first key of every block. A lookup finds the partitions that can hold its key by their first keys (a list bounded by the
number of partitions), binary-searches their slices of the directory, opens the blocks these name (one, unless captures with
equal key and id go on over several) and binary-searches those.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import texts

#: Bytes after which an archive is closed, entries of an index block, and rows of an index partition.
ARCHIVE_BYTES, BLOCK_ENTRIES, PARTITION_ROWS = 64 << 20, 512, 500_000
DATE = "2024-01-01T00:00:00Z"
#: Stands for a null page id in index order, below all others.
NO_ID = -(2**63)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_RECORD = "archive string, offset bigint, length bigint, page_id bigint, url_key string, member binary"


def url_key(url: str | None) -> str:
    """Host labels reversed, port, then path and query: pages of one host, and of its subdomains, sort together. Scheme, user
    and fragment don't count; a null or empty URL is the empty key; what can't be parsed is its own key, lower-cased."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(kind: str, page_id: int | None, url: str | None, digest: str, block: bytes, extra: dict[str, str]) -> bytes:
    """One record as a gzip member of its own."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {"WARC-Type": kind, "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": clean, **extra,
            "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one member; a member cut short or altered is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("record and its Content-Length differ")
    return headers, rest[:size]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Writes a record per row below ``folder``. Of equal payloads of at least ``min_bytes`` bytes the one of largest id is a
    response and the others are revisits of it; all smaller ones are responses.

    Payloads are compared by SHA-256. Only records travel, compressed, and within a batch only one of equal payloads has
    one, so a payload that a third of all rows share is moved a few times at most. Defined cases: a null payload is empty; a
    row with a null id is never the response of a group that has an id, and several with none are all responses; rows
    that repeat the largest id are responses all; other columns are not kept.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("same"))
    groups = cut(
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("same")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("response").isNotNull()).drop("n"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, same = part.column(0).to_pylist(), part.column(3).to_pylist()
                largest: dict[str, int] = {}
                for i, s in zip(ids, same):
                    largest[s] = max(largest.get(s, NO_ID), NO_ID if i is None else i)
                members, digests = [], []
                for i, url, payload, s in zip(ids, part.column(1).to_pylist(), texts(part.column(2)), same):
                    digests.append(payload_digest(payload))
                    needed = len(payload) < min_bytes or (NO_ID if i is None else i) == largest[s]
                    members.append(_record("response", i, url, digests[-1], _HTTP + payload, {}) if needed else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(digests), pa.array(members, pa.binary())],
                    names=["page_id", "url", "same", "digest", "member"])

    packed = rows.mapInArrow(pack, "page_id bigint, url string, same string, digest string, member binary")

    def lay_out(batches):
        task, number, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out = []
            for page_id, url, _, digest, member, response in zip(*[c.to_pylist() for c in batch.columns]):
                if response is not None and page_id != response:
                    member = _record("revisit", page_id, url, digest, b"", {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(response)})
                if offset >= ARCHIVE_BYTES:
                    number, offset = number + 1, 0
                out.append((f"{task:06d}-{number:04d}", offset, len(member), page_id, url_key(url), member))
                offset += len(member)
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["archive", "offset", "length", "page_id", "url_key", "member"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    joined = packed.join(groups.select(F.col("same").alias("same_"), "response"), F.col("same") == F.col("same_"), "left")
    joined.select("page_id", "url", "same", "digest", "member", "response").mapInArrow(lay_out, _RECORD).write.parquet(f"{folder}/archives")


def archive_bytes(spark: SparkSession, folder: str, archive: str):
    """The members of one archive in order: joined, a ``.warc.gz`` file. At most ``ARCHIVE_BYTES`` and one record."""
    rows = spark.read.parquet(f"{folder}/archives").filter(F.col("archive") == archive).orderBy("offset").select("member")
    yield from (bytes(r.member) for r in rows.toLocalIterator())


def write_index(spark: SparkSession, folder: str) -> None:
    """Writes the blocks and the directory of all captures in ``folder``."""
    captures = spark.read.parquet(f"{folder}/archives").select(
        "url_key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "archive", "offset", "length")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // PARTITION_ROWS))

    def pack(batches):
        task, number, held = TaskContext.get().partitionId(), 0, []
        names = ["part", "block", "first_key", "first_id", "entries", "data"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def block():
            data = zlib.compress(pa.ipc.serialize_pandas(pd.DataFrame(held, columns=["url_key", "page_id", "archive", "offset", "length"]), preserve_index=False).to_pybytes())
            row = (task, (task << 32) + number, held[0][0], held[0][1], len(held), data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) == BLOCK_ENTRIES:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    blocks = captures.repartitionByRange(parts, "url_key", "page_id", "archive", "offset").sortWithinPartitions("url_key", "page_id", "archive", "offset")
    schema = "part int, block bigint, first_key string, first_id bigint, entries bigint, data binary"
    blocks.mapInArrow(pack, schema).write.parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/blocks").select("part", "block", "first_key", "first_id").write.parquet(f"{folder}/directory")


def _entries(data: bytes) -> pd.DataFrame:
    return pa.ipc.deserialize_pandas(pa.py_buffer(zlib.decompress(data)))


def _covering(firsts: list[tuple], key: tuple) -> range:
    """Places in the sorted ``firsts`` whose run of entries can hold ``key``: every one that starts with it, and the one before."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def lookup(requests: DataFrame, folder: str) -> DataFrame:
    """(url_key, page_id, archive, offset, length) of the captures asked for by (url_key, page_id); null ids ask for captures
    without one. Each request is answered once, whatever number of times it comes; what isn't there gives no row; captures
    with equal key and id are all found, over whatever number of blocks and partitions they are spread."""
    spark = requests.sparkSession
    directory = spark.read.parquet(f"{folder}/directory")
    roots = [(r.k.first_key, r.k.first_id, r.part) for r in directory.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("k")).collect()]
    roots.sort()
    starts, parts = [r[:2] for r in roots], [r[2] for r in roots]
    asked = requests.select(F.coalesce("url_key", F.lit("")).alias("url_key"), F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page_id")).distinct()

    def place(batches):
        for batch in batches:
            spans = [_covering(starts, ask) for ask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            row = pa.array([i for i, span in enumerate(spans) for _ in span], pa.int64())
            named = pa.array([parts[at] for span in spans for at in span], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), named], names=["url_key", "page_id", "part"])

    def find_block(slots: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        slots = slots.sort_values(["first_key", "first_id", "block"])
        firsts = list(zip(slots["first_key"], slots["first_id"]))
        spans = [_covering(firsts, x) for x in zip(asks["url_key"], asks["page_id"])]
        row, at = [i for i, span in enumerate(spans) for _ in span], [a for span in spans for a in span]
        return asks[["url_key", "page_id"]].iloc[row].assign(block=slots["block"].to_numpy()[at] if len(at) else [])

    def find_entries(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = ["url_key", "page_id", "archive", "offset", "length"]
        if not len(block) or not len(asks):
            return pd.DataFrame(columns=columns)
        entries = _entries(block["data"].iloc[0])
        keys = list(zip(entries["url_key"], entries["page_id"]))
        found = []
        for ask in zip(asks["url_key"], asks["page_id"]):
            at = bisect_right(keys, ask) - 1
            while at >= 0 and keys[at] == ask:
                found.append(at)
                at -= 1
        return entries.iloc[found][columns]

    placed = asked.mapInArrow(place, "url_key string, page_id bigint, part int")
    named = directory.groupBy("part").cogroup(placed.groupBy("part")).applyInPandas(find_block, "url_key string, page_id bigint, block bigint")
    blocks = spark.read.parquet(f"{folder}/blocks").select("block", "data")
    return blocks.groupBy("block").cogroup(named.groupBy("block")).applyInPandas(
        find_entries, "url_key string, page_id bigint, archive string, offset bigint, length bigint")


def read_records(spark: SparkSession, folder: str, captures: DataFrame) -> DataFrame:
    """The records at the ranges (archive, offset, length) of ``captures``: page_id, url_key, record_type, refers_to,
    payload_digest and payload_bytes, null for a revisit, whose payload its response holds. Every payload read is held
    against its digest. All members are decoded where they are scanned and only the decoded facts are joined: a full read in place
    of range reads, whatever number of captures is asked for."""

    def decode(batches):
        for batch in batches:
            out = []
            for archive, offset, length, member in zip(*[c.to_pylist() for c in batch.columns]):
                headers, block = parse_record(member)
                number = lambda name: int(x) if (x := headers.get(name, "")[len("<urn:page:"): -1]) else None
                digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), None
                if headers["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    size = len(payload)
                    if payload_digest(payload) != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                out.append((archive, offset, length, number("warc-record-id"), headers["warc-type"], number("warc-refers-to"), digest, size))
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["archive", "offset", "length", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])

    schema = "archive string, offset bigint, length bigint, page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint"
    records = spark.read.parquet(f"{folder}/archives").select("archive", "offset", "length", "member").mapInArrow(decode, schema)
    return records.join(captures.select("archive", "offset", "length", "url_key"), ["archive", "offset", "length"])


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes`` of revisits taken from their responses (joined on id and digest)."""
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    joined = records.join(cut(sizes), ["refers_to", "payload_digest"], "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).drop("size")
