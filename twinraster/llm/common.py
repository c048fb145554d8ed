"""Helpers shared by the operators: reading tables, byte-level words and vectorised hashes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: used where several later steps read the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` without the named columns, followed by them."""
    names = {n for n, _ in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])


def with_arrays(batch: pa.RecordBatch, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` without the named columns, followed by them."""
    names = [n for n in batch.schema.names if n not in arrays]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(arrays.values()), names=names + list(arrays))


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice); ``x`` is uint64 and is not changed."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, with the byte offsets of their starts and ends.

    Splitting bytes cuts at exactly these blanks. The hash (xxh3) isn't linear in the bytes: no arrangement of them makes words alike.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank))
    bounds = np.concatenate([[0] if not blank[0] else [], edge + 1, [len(raw)] if not blank[-1] else []]).astype(np.int64)
    starts, ends = bounds[0::2], bounds[1::2]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), dtype=_U, count=len(starts)), starts, ends


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per ``size`` consecutive words; a shorter text with a word is one shingle, a text without words has none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, dtype=_U)
    for j in range(size):
        out = out * _U(0x2545F4914F6CDD1D) + words[j: j + len(out)]
    return mix(out ^ _U(size))
