"""Byte-level BPE in two tiers.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry takes one probe. Tier two
merges the bytes of a miss as a doubly linked list with a heap of (rank, position). Each text is encoded in one task row by
row, so a lost executor costs a recomputed partition and nothing else. The vocabulary is a parameter: its file bounds
what is broadcast.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import extended, mix, with_arrays

_U = np.uint64
#: Characters looked at in one go; a text of any length is walked window by window.
WINDOW = 1 << 18
#: Distinct pre-tokens a task remembers before it starts anew.
REMEMBERED = 500_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines; ranks must be 0..n-1 and hold all 256 single bytes."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    tokens = [ranks[i] for i in range(len(ranks))]
    if len(set(tokens)) != len(tokens) or sum(len(t) == 1 for t in tokens) != 256:
        raise ValueError("ranks must be distinct tokens and hold every single byte")
    return tokens


class PerfectHash:
    """Minimal perfect hash of byte strings by displacement: n keys fill slots 0..n-1 without a gap.

    Buckets are placed from the largest down, each with the first seed that sends its keys to free slots; buckets of one
    key take the slots that are left and store the slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        hashes = self.hash(keys)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two keys share a 64-bit hash")
        self.buckets = max(1, self.n // 4)
        bucket = (hashes % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.seed = np.zeros(self.buckets, dtype=np.int64)
        self.owner = np.full(self.n, -1, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[first[b]: first[b + 1]]
            if len(mine) < 2:
                break
            seed, step = 0, 64
            while True:  # a block of seeds at once: the last buckets of two keys need thousands of tries
                tried = self._slots(hashes[mine][None, :], np.arange(seed, seed + step)[:, None])
                fits = np.flatnonzero((self.owner[tried] < 0).all(axis=1))
                fits = [f for f in fits if len(set(tried[f].tolist())) == len(mine)]
                if fits:
                    seed, slots = seed + int(fits[0]), tried[fits[0]]
                    break
                seed, step = seed + step, min(4096, step * 2)
            self.seed[b], self.owner[slots] = seed, mine
        free = iter(np.flatnonzero(self.owner < 0))
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.seed[b], self.owner[slot] = -1 - slot, order[first[b]]
        self.fingerprint = hashes[self.owner]

    @staticmethod
    def hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=_U, count=len(keys))

    def _slots(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(hashes + seeds.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(self.n)).astype(np.int64)

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The only key number each string can have, or -1 where the fingerprint differs; callers compare the bytes."""
        hashes = self.hash(keys)
        seeds = self.seed[(hashes % _U(self.buckets)).astype(np.int64)]
        slots = np.where(seeds < 0, -1 - seeds, self._slots(hashes, np.maximum(seeds, 0)))
        return np.where(self.fingerprint[slots] == hashes, self.owner[slots], -1)


class Vocabulary:
    """Both tiers, and the tokens for decoding."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = PerfectHash(tokens)
        rank = {t: i for i, t in enumerate(tokens)}
        self.single = [rank[bytes([b])] for b in range(256)]
        #: (left rank, right rank) as one integer -> rank of the two together
        self.joined = {
            rank[t[:k]] << 32 | rank[t[k:]]: r for r, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank
        }

    def merge(self, word: bytes) -> list[int]:
        """Ranks of a pre-token: again and again the lowest-ranked adjacent pair, the leftmost first, becomes one."""
        joined = self.joined.get
        part = [self.single[b] for b in word]
        n = len(part)
        pairs = map(joined, [a << 32 | b for a, b in zip(part, part[1:])])
        heap = [r << 32 | i for i, r in enumerate(pairs) if r is not None]
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            r, i = divmod(heappop(heap), 1 << 32)
            j = after[i]
            if j >= n or joined(part[i] << 32 | part[j]) != r:
                continue  # what stands here now is another pair
            part[i], part[j] = r, -1
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                s = joined(r << 32 | part[k])
                if s is not None:
                    heappush(heap, s << 32 | i)
            h = before[i]
            if h >= 0:
                s = joined(part[h] << 32 | r)
                if s is not None:
                    heappush(heap, s << 32 | h)
        return [p for p in part if p >= 0]

    def resolve(self, words: list[bytes]) -> list[list[int]]:
        """Ranks of each pre-token: one vectorised probe for all, merges for those that are no vocabulary entry."""
        found = self.whole.probe(words).tolist()
        return [[f] if f >= 0 and self.tokens[f] == w else self.merge(w) for f, w in zip(found, words)]


class Encoder:
    """Encodes texts with a memory of pre-tokens seen before, kept as rows of one flat array of ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        ids = self.vocabulary.resolve([w.encode("utf-8") for w in words])
        rows, total = len(self.row), self.used + sum(map(len, ids))
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * total, dtype=np.int32)])
        if rows + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start[: rows + 1], np.zeros(2 * (rows + len(words) + 1), dtype=np.int64)])
        self.flat[self.used: total] = [i for one in ids for i in one]
        self.start[rows + 1: rows + 1 + len(words)] = self.used + np.cumsum([len(one) for one in ids])
        self.used = total
        self.row.update(zip(words, range(rows, rows + len(words))))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, a window at a time. The last four of a window are looked at again in the next one,
        as what follows them can change them; a window that is nearly all one match is doubled."""
        at, size = 0, WINDOW
        while at < len(text):
            found = self.find(text, at, at + size)
            if at + size < len(text):
                found = found[:-4]
                if not found:
                    size *= 2
                    continue
            if not found:
                return
            yield found
            at, size = at + sum(map(len, found)), WINDOW

    def ids(self, text: str) -> np.ndarray:
        parts = []
        for found in self.pieces(text):
            if len(self.row) > REMEMBERED:
                self._forget()
            new = [w for w in dict.fromkeys(found) if w not in self.row]
            if new:
                self._learn(new)
            rows = np.fromiter(map(self.row.__getitem__, found), dtype=np.int64, count=len(found))
            starts = self.start[rows]
            sizes = self.start[rows + 1] - starts
            ends = np.cumsum(sizes)
            parts.append(self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary(load_ranks(path)))


def _encoding(shared, pattern: str, text_col: str, ids_col: str, drop: bool = False):
    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                each = [encoder.ids(t) if t else np.zeros(0, dtype=np.int32) for t in column.slice(at, 256).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                yield with_arrays(part.drop_columns([text_col]) if drop else part, {ids_col: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each), pa.int32()))})

    return run


def _decoding(shared, ids_col: str, bytes_col: str):
    def run(batches):
        tokens = pa.array(shared.value.tokens, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(part.schema.get_field_index(ids_col))
                sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()])
                found = tokens.take(column.flatten())
                stops = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
                offsets = stops[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
                data = found.buffers()[2] if len(found) else pa.py_buffer(b"")
                yield with_arrays(part, {bytes_col: pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), data])})

    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the token ids of the whole text, each match of ``pattern`` separately.

    ``pattern`` must match every character (as the usual pre-tokenisers do). Defined cases: a null or empty text has no
    ids; text that looks like a special token is ordinary text; an existing ``ids_col`` is replaced; other columns pass.
    """
    return docs.mapInArrow(_encoding(_shared(docs.sparkSession, path), pattern, text_col, ids_col), extended(docs, (ids_col, "array<int>")))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with ``bytes_col`` (binary): the token bytes of ``ids_col`` joined. Null or empty ids give empty bytes;
    an id outside the vocabulary is an error, as nothing can stand for it; an existing ``bytes_col`` is replaced."""
    return rows.mapInArrow(_decoding(_shared(rows.sparkSession, path), ids_col, bytes_col), extended(rows, (bytes_col, "binary")))


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` without the texts, in one Python worker a task: the vocabulary is held once and ids don't go through the JVM in between."""
    shared = _shared(docs.sparkSession, path)
    there, back = _encoding(shared, pattern, text_col, ids_col, drop=True), _decoding(shared, ids_col, bytes_col)
    shape = extended(docs.drop(text_col), (ids_col, "array<int>"), (bytes_col, "binary"))
    return docs.mapInArrow(lambda batches: back(there(batches)), shape)
