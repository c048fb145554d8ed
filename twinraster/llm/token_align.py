"""Alignment of two tokenizers' tokens over the same text.

Both tokenizers cover the bytes of a text; where a token of each ends at the same byte they share a cut, and the cuts divide the
text into groups. Cuts are found by divide and conquer: of an interval between two shared cuts, the shared end nearest to its middle
is located by bisecting the other side's ends, and both halves are treated alike, until an interval holds no cut and is
a group. All intervals of a slice of documents go through a level together, so a level is a few array operations.

How often two ids are linked in the corpus is a table as large as the vocabularies allow, so it is not broadcast. Documents are
taken in blocks; each block knows the pairs it holds, fetches their counts by one join, and its documents look them up there.
"""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, with_arrays
from .stream_bpe import Encoder, MergeList
from .units import UnitMemory, unit_keys

#: Documents and bytes of text of a block; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 19
#: Units whose tokens a worker remembers.
REMEMBERED = 1 << 17
_COLUMNS = [
    ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups", "string"), ("block", "bigint"),
    ("link_pair", "array<int>"), ("link_times", "array<int>"), ("block_a", "array<int>"), ("block_b", "array<int>"), ("block_links", "array<bigint>"),
]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A whose ends are ends of B too, in order, and the numbers of those tokens of B.

    ``ends_a`` and ``ends_b`` are rising byte offsets; the intervals ``lo`` to ``hi`` (numbers of A's tokens, end excluded), in order, lie
    between shared cuts, so their last ends are shared.
    """
    match = np.full(len(ends_a), -1, dtype=np.int64)
    match[hi - 1] = np.searchsorted(ends_b, ends_a[hi - 1])
    last_b = match[hi - 1]
    first_b = np.concatenate([[-1], last_b[:-1]]) + 1
    while len(lo):
        some = (last_b > first_b) & (hi - lo > 1)  # both sides end inside
        lo, hi, first_b, last_b = lo[some], hi[some], first_b[some], last_b[some]
        cut, cut_b = _nearest(ends_a, ends_b, lo, hi - 1)
        found = cut >= 0
        lo, hi, first_b, last_b, cut, cut_b = (v[found] for v in (lo, hi, first_b, last_b, cut, cut_b))
        match[cut] = cut_b
        # halves stay in order, so that neighbouring searches touch neighbouring memory
        lo, hi = np.stack([lo, cut + 1], 1).ravel(), np.stack([cut + 1, hi], 1).ravel()
        first_b, last_b = np.stack([first_b, cut_b + 1], 1).ravel(), np.stack([cut_b, last_b], 1).ravel()
    cuts = np.flatnonzero(match >= 0)
    return cuts, match[cuts]


def _nearest(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of tokens of A the one nearest to its middle whose end B shares, and B's token there; -1 where there is none. The
    part around the middle that is looked at grows fourfold until it holds a cut or is the interval."""
    middle = (lo + hi - 1) // 2
    at = np.searchsorted(ends_b, ends_a[middle])
    hit = ends_b[at] == ends_a[middle]
    out, out_b = np.where(hit, middle, -1), np.where(hit, at, -1)
    todo, width = np.flatnonzero(~hit & (hi - lo > 1)), 1
    while len(todo):
        first, last = np.maximum(lo[todo], middle[todo] - width), np.minimum(hi[todo], middle[todo] + width + 1)
        size = last - first
        start = np.cumsum(size) - size
        token = np.repeat(first - start, size) + np.arange(int(size.sum()))
        at = np.searchsorted(ends_b, ends_a[token])
        far = token - np.repeat(middle[todo], size)
        far = np.where(ends_b[at] == ends_a[token], np.abs(far) * 2 + (far > 0), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(far, start)
        hit = best < np.iinfo(np.int64).max
        chosen = middle[todo[hit]] + np.where(best[hit] % 2 == 1, best[hit] // 2, -(best[hit] // 2))
        out[todo[hit]], out_b[todo[hit]] = chosen, at[start[hit] + chosen - first[hit]]
        todo = todo[~hit & ((first > lo[todo]) | (last < hi[todo]))]
        width *= 4
    return out, out_b


class Sides:
    """Both tokenizers. ``merges`` is a byte-level vocabulary, ``model`` the bytes of a sentence-piece model; both stand for space+text."""

    def __init__(self, merges: MergeList, model: bytes):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        b = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode("utf-8") for i, n in enumerate(names)]
        # a space mark inside a piece could join two units; such models get whole texts
        self.cut = not any("▁" in n.lstrip("▁") for n in names)
        self.bytes = [pa.array([t or b"" for t in merges.tokens], pa.binary()), pa.array(b, pa.binary())]
        self.length = [merges.length, np.array([len(t) for t in b], dtype=np.int64)]
        self.encoder = Encoder(merges)
        self.encoder.words.entries = REMEMBERED
        self.memory = UnitMemory(self._both, REMEMBERED)
        ids = [str(i) for n in map(len, self.bytes) for i in range(n)]
        #: every id of A, then of B, with each of the four signs that can follow it
        self.printed = pa.array([i + sign for i in ids for sign in (",", "|", ";", "")], pa.binary())

    def _both(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, then of B (counted on from those of A), of every unit."""
        a, n_a = self.encoder._learn(keys)
        found = self.pieces.encode(keys, num_threads=1)
        b = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        n_b = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        out = np.empty(len(a) + len(b), dtype=np.int32)
        of_b = np.repeat(np.tile([False, True], len(keys)), np.stack([n_a, n_b], 1).ravel())
        out[~of_b], out[of_b] = a, b + len(self.bytes[0])
        return out, n_a + n_b

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts in one array, and how many each text has. A text whose joined bytes differ from space+text, on
        either side, has no ids."""
        units = [unit_keys(t, spaced=True) if self.cut else [t] if t else [] for t in texts]
        found, sizes = self.memory.ids(list(chain.from_iterable(units)))
        text_stops = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, units)])]
        of_b = found >= len(self.bytes[0])
        b_before = np.concatenate([[0], np.cumsum(of_b)])[text_stops]
        want = [b" " + t.encode("utf-8") if t else b"" for t in texts]
        sides, good = [], np.ones(len(texts), dtype=bool)
        for ids, stops, tokens, length in zip((found[~of_b], found[of_b] - len(self.bytes[0])), (text_stops - b_before, b_before), self.bytes, self.length):
            joined = tokens.take(pa.array(ids)).buffers()[2].to_pybytes() if len(ids) else b""
            ends = np.concatenate([[0], np.cumsum(length[ids])])[stops].tolist()
            good &= [joined[a:b] == w for a, b, w in zip(ends, ends[1:], want)]
            sides.append((ids, np.diff(stops)))
        if good.all():
            return sides
        return [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in sides]

    def align(self, texts: list[str]) -> dict[str, np.ndarray | pa.Array]:
        """Counts, printed groups and linked pairs of ids of each text, and all pairs of the slice."""
        (a, n_a), (b, n_b) = self.encode(texts)
        rows = len(texts)
        ends_a, ends_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        last = np.cumsum(n_a)
        has = n_a > 0
        cuts, cuts_b = shared_cuts(ends_a, ends_b, (last - n_a)[has], last[has])  # a group is known by its last tokens
        text_of = np.repeat(np.arange(rows), n_a)
        stop_b = cuts_b + 1
        group_a = np.repeat(np.arange(len(cuts)), np.diff(cuts, prepend=-1))
        group_b = np.repeat(np.arange(len(cuts)), np.diff(stop_b, prepend=0))
        # links: the text falls into stretches between neighbouring ends of either side; each lies in one token of A and one of B
        both = np.concatenate([ends_a, ends_b])
        order = np.argsort(both, kind="stable")
        of_a = order < len(ends_a)
        first = np.flatnonzero(np.diff(both[order], prepend=-1))
        in_a = np.cumsum(of_a)[first] - of_a[first]  # ends of A that lie before
        in_b = first - in_a
        width = len(self.bytes[1])
        pairs, place = np.unique(a[in_a].astype(np.int64) * width + b[in_b], return_inverse=True)
        # the same pair twice in a text is one entry with a number
        entry = np.sort(text_of[in_a] * max(1, len(pairs)) + place)
        fresh = np.flatnonzero(np.diff(entry, prepend=-1))
        times = np.diff(fresh, append=len(entry))
        owner, place_of = np.divmod(entry[fresh], max(1, len(pairs)))
        # printed groups: A's tokens of a group, then B's
        final = np.zeros(len(cuts), dtype=bool)
        final[np.flatnonzero(np.diff(text_of[cuts], append=-1))] = True
        sign_a, sign_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        sign_a[cuts], sign_b[stop_b - 1] = 1, np.where(final, 3, 2)
        printed = np.empty(len(a) + len(b), dtype=np.int64)
        printed[np.arange(len(a)) + np.concatenate([[0], stop_b])[group_a]] = a.astype(np.int64) * 4 + sign_a
        printed[np.arange(len(b)) + (cuts + 1)[group_b]] = (b.astype(np.int64) + len(self.bytes[0])) * 4 + sign_b
        found = self.printed.take(pa.array(printed))
        stops = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
        groups = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(stops[np.cumsum([0, *(n_a + n_b)])].astype(np.int32)), found.buffers()[2] if len(found) else pa.py_buffer(b"")])
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_of[cuts], minlength=rows), "n_links": np.bincount(text_of[in_a], minlength=rows), "groups": groups,
            "link_pair": _lists(place_of.astype(np.int32), np.bincount(owner, minlength=rows)), "link_times": _lists(times.astype(np.int32), np.bincount(owner, minlength=rows)),
            "pairs": np.stack(np.divmod(pairs, width)), "pair_links": np.bincount(place, minlength=len(pairs)),
        }


class _Shared:
    """What is broadcast; a worker process makes its tokenizers from it once, for all its tasks."""

    def __init__(self, merges: MergeList, model: bytes):
        self.parts, self._sides = (merges, model), None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self._sides = parts, None

    def sides(self) -> Sides:
        if self._sides is None:
            self._sides = Sides(*self.parts)
        return self._sides


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _on_first(values: np.ndarray, kind: pa.DataType, rows: int) -> pa.Array:
    """A list column that holds ``values`` in its first row and null in the others."""
    return pa.array([values] + [None] * (rows - 1), pa.list_(kind))


def align(docs: DataFrame, merges_path: str, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the tokens of both tokenizers aligned over the whole text.

    Adds ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A and B by group), and for ``link_counts`` and
    ``scored`` the column ``block``, the linked pairs of ids of the text (``link_pair``: place among the pairs of its block; ``link_times``) and, on
    one row of each block, the pairs themselves. Those of these names that ``docs`` has are replaced; other columns and repeated rows pass. Special tokens are plain text.
    A text that is null, empty, or not what its joined tokens say, has no tokens: zeros, an empty ``groups``, no links.
    """
    context = docs.sparkSession.sparkContext
    with open(model_path, "rb") as file:
        shared = context.broadcast(_Shared(MergeList(merges_path), file.read()))

    def run(batches):
        sides, part_id, number = shared.value.sides(), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            reach = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                stop = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + BLOCK_BYTES))
                stop = min(max(stop, at + 1), at + BLOCK_ROWS, len(texts))
                found = sides.align([t or "" for t in texts.slice(at, stop - at).to_pylist()])
                pairs, links = found.pop("pairs"), found.pop("pair_links")
                rows = stop - at
                found = {k: v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for k, v in found.items()}
                found["block"] = pa.array(np.full(rows, part_id << 32 | number, dtype=np.int64))
                found |= {"block_a": _on_first(pairs[0], pa.int32(), rows), "block_b": _on_first(pairs[1], pa.int32(), rows), "block_links": _on_first(links, pa.int64(), rows)}
                yield with_arrays(batch.slice(at, rows), {name: found[name] for name, _ in _COLUMNS})
                at, number = stop, number + 1

    return docs.mapInArrow(run, extended(docs, *_COLUMNS))


def _block_pairs(aligned: DataFrame) -> DataFrame:
    """One row (block, place, a_id, b_id, links) per pair of ids that a block holds linked."""
    zipped = F.arrays_zip("block_a", "block_b", "block_links")
    each = aligned.filter("block_a IS NOT NULL").select("block", F.posexplode(zipped).alias("place", "pair"))
    return each.select("block", "place", F.col("pair.block_a").alias("a_id"), F.col("pair.block_b").alias("b_id"), F.col("pair.block_links").alias("links"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best): how many links of the corpus hold the two ids, and whether no other id of A has more with that id of B."""
    counts = _block_pairs(aligned).groupBy("a_id", "b_id").agg(F.sum("links").alias("links"))
    most = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of the columns of blocks and links: over the links of a text, how many are best for
    their id of B, and the sum of their counts in the corpus. ``aligned`` is read twice, so it should be a written table."""
    valued = _block_pairs(aligned).drop("links").join(link_counts(aligned), ["a_id", "b_id"]).select(F.col("block").alias("of_block"), "place", "links", "best")
    kept = [c for c in aligned.columns if c not in {"link_pair", "link_times", "block_a", "block_b", "block_links", "block", "n_best", "count_sum"}]
    schema = T.StructType([aligned.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def look_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        links, best = np.zeros(pairs.num_rows, dtype=np.int64), np.zeros(pairs.num_rows, dtype=np.int64)
        place = pairs["place"].to_numpy()
        links[place], best[place] = pairs["links"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
        entries, times = texts["link_pair"].combine_chunks(), texts["link_times"].combine_chunks()
        at, n = entries.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        stops = np.cumsum([0, *entries.value_lengths().to_numpy()])
        sums = [np.diff(np.concatenate([[0], np.cumsum(n * values[at])])[stops]) for values in (best, links)]
        return texts.select(kept).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    texts = aligned.select(*kept, "block", "link_pair", "link_times")
    return texts.groupBy("block").cogroup(valued.groupBy("of_block")).applyInArrow(look_up, schema)
