"""Exact removal of word windows that occur more than once, by suffix automata over shards of the corpus.

The corpus is its own reference. Sending every document past the automaton of every shard would grow with the square of the
corpus, so text is routed to the one shard that can match it: each window of ``n`` words is owned by its anchor, the ``k``-word
gram of lowest hash in it (the leftmost of equals), and equal windows own equal anchors. Windows in a row with one anchor
form a piece, and every window lies in exactly one piece.

1. Anchors are counted; those that occur once own no repeated window and drop out.
2. Equal pieces are counted. A piece that occurs twice or more is repeated throughout.
3. For anchors with several different pieces, one copy of each goes to the anchor's shard. A shard builds the suffix automaton
   of its pieces, weighted with their numbers of occurrences, and streams the pieces through it: the state that holds the
   last ``n`` words tells how often this window occurs.
4. An anchor with more than ``MAX_PIECES`` different pieces (a passage that very many documents share, in ever new context) is
   no longer one shard's: its windows are counted by their own hash, which splits the group evenly.

All repeated windows of a document are united and their words removed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import extended, mix, shingle_hashes, stored, texts, with_arrays, word_hashes

_U = np.uint64
WINDOW, GRAM = 35, 6
#: Different pieces of one anchor that a shard takes, and words of an automaton before the next shard begins.
MAX_PIECES, SHARD_WORDS = 512, 50_000
_STEP = 0xD6E8FEB86659FD93


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of words times powers, the powers and their inverses: the hash of any run of words in constant time."""
    inverse = pow(_STEP, -1, 2**64)
    powers, inverses = np.full(len(words), _STEP, dtype=_U), np.full(len(words), inverse, dtype=_U)
    powers[0] = inverses[0] = 1
    powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
    sums = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * powers, out=sums[1:])
    return sums, powers, inverses


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` words."""
    sums, _, inverses = _prefix(words)
    return mix((sums[n:] - sums[:-n]) * inverses[: len(words) - n + 1])


def pieces(words: np.ndarray, n: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, piece hash) of the pieces of one document, in order."""
    windows = len(words) - n + 1
    if windows <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    grams = shingle_hashes(words, k)
    span = n - k + 1  # grams in a window
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)  # of equal hashes the leftmost is lower
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: windows], low[span - width: span - width + windows])
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [windows]]))
    sums, _, inverses = _prefix(words)
    whole = mix((sums[first + count + n - 1] - sums[first]) * inverses[first] ^ count.astype(_U))
    return grams[at[first]], first, count, whole


class SuffixAutomaton:
    """Suffix automaton of sequences of integers, each with a weight: how often any run of them occurs in all, weighted.

    The sequences are strung together with separators of their own, so no run spans two of them.
    """

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        last = 0
        for number, (sequence, weight) in enumerate(zip(sequences, weights)):
            for symbol in sequence:
                last = self._extend(last, symbol, weight)
            last = self._extend(last, -1 - number, 0)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _extend(self, last: int, symbol: int, weight: int) -> int:
        step, link, length, count = self.next, self.link, self.length, self.count
        new = len(length)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        count.append(weight)
        state = last
        while state >= 0 and symbol not in step[state]:
            step[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = step[state][symbol]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                twin = len(length)
                step.append(dict(step[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                count.append(0)
                link[target] = link[new] = twin
                while state >= 0 and step[state].get(symbol) == target:
                    step[state][symbol] = twin
                    state = link[state]
        return new

    def occurrences(self, sequence: list[int], n: int) -> Iterator[int]:
        """For each run of ``n`` symbols, in order: the weight of its occurrences in the sequences (0 if it has none)."""
        state = matched = 0
        for at, symbol in enumerate(sequence, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            target = self.next[state].get(symbol)
            if target is not None:
                state, matched = target, matched + 1
            while state and self.length[self.link[state]] >= n:
                state = self.link[state]
                matched = min(matched, self.length[state])
            if at >= n:
                yield self.count[state] if matched >= n else 0


def _shard_spans(rows: list[tuple], n: int) -> Iterator[tuple]:
    """(id, version, start, stop) of repeated windows in the pieces of one shard that occur once as a whole."""
    numbers: dict[int, int] = {}
    sequences = [[numbers.setdefault(w, len(numbers)) for w in np.frombuffer(words, dtype=np.int64).tolist()] for *_, words, _ in rows]
    automaton = SuffixAutomaton(sequences, [occurs for *_, occurs in rows])
    for (_, row_id, version, first, _, occurs), sequence in zip(rows, sequences):
        if occurs == 1:
            twice = np.fromiter(automaton.occurrences(sequence, n), dtype=np.int64) > 1
            edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]])))
            for start, stop in zip(edges[0::2].tolist(), edges[1::2].tolist()):
                yield row_id, version, first + start, first + stop + n - 1


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``docs`` with the text's kept words joined by one space, and ``n_words`` and ``n_removed`` (long).

    A word goes if a window of ``n`` consecutive words that covers it also starts anywhere else in the table, the same
    document included; windows are judged on the input. Words are runs without ASCII blanks, unchanged. Defined cases:
    null, empty and blank texts have no words and become the empty text; a text of fewer than ``n`` words keeps all; every
    row is a document of its own, so rows that repeat id and text remove each other's windows; null ids take part; columns
    of ``docs`` named ``n_words`` or ``n_removed`` are replaced, other columns pass.
    """
    id_type = docs.schema[id_col].dataType
    version = F.hash(F.col(text_col))
    row_id = F.coalesce(F.col(id_col), F.xxhash64(F.col(text_col)).cast(id_type))
    rows = docs.select(row_id.alias("id"), version.alias("version"), F.col(text_col).alias("text"))
    key = f"id {id_type.simpleString()}, version int"

    def find(batches):
        for batch in batches:
            found = [pieces(word_hashes(t or b"")[0], n, k) for t in texts(batch.column(2))]
            each = np.array([len(f[0]) for f in found])
            flat = [np.concatenate([f[i] for f in found]) for i in range(4)]
            where = pa.array(np.repeat(np.arange(len(found)), each))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array(flat[0].view(np.int64)), pa.array(flat[3].view(np.int64)),
                 pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))],
                names=["id", "version", "anchor", "piece", "first", "windows"])

    found = rows.mapInArrow(find, f"{key}, anchor bigint, piece bigint, first int, windows int")
    twice = cut(found.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    candidates = stored(found.join(twice, "anchor"), "pieces")
    counted = stored(
        candidates.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("occurs"), F.min(F.struct("id", "version", "first", "windows")).alias("one")),
        "piece-counts")
    whole = candidates.join(cut(counted.filter("occurs > 1").select("anchor", "piece")), ["anchor", "piece"]).select(
        "id", "version", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (n - 1)).alias("stop"))

    varied = cut(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter("different > 1"))
    asked = counted.join(varied, "anchor").select("anchor", "occurs", (F.col("different") > MAX_PIECES).alias("hot"), "one.*")
    per_row = asked.groupBy("id", "version").agg(F.collect_list(F.struct("anchor", "occurs", "hot", "first", "windows")).alias("asked"))

    def fetch(batches):
        """Of each piece asked for its words, or of a hot anchor the hashes of its windows."""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for row_id, v, text, pieces_asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), part.column(3).to_pylist()):
                    words = word_hashes(text)[0]
                    hashes = window_hashes(words, n).view(np.int64)
                    for p in pieces_asked:
                        first, stop = p["first"], p["first"] + p["windows"]
                        held = (None, hashes[first: stop]) if p["hot"] else (words[first: stop + n - 1].tobytes(), None)
                        out.append((row_id, v, p["anchor"], p["occurs"], first, *held))
                columns = list(zip(*out)) or [[]] * 7
                kinds = [part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "version", "anchor", "occurs", "first", "words", "hashes"])

    fetched = stored(
        rows.join(per_row.hint("shuffle_hash"), ["id", "version"]).select("id", "version", "text", "asked")
        .mapInArrow(fetch, f"{key}, anchor bigint, occurs bigint, first int, words binary, hashes array<bigint>"),
        "piece-words")

    def match(batches):
        """Shards are cut between anchors, so all pieces of an anchor share an automaton."""
        shard, size, names = [], 0, ["id", "version", "start", "stop"]

        def done():
            columns = list(zip(*_shard_spans(shard, n))) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            kinds = [batch.column(1).type, pa.int32(), pa.int32(), pa.int32()]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SHARD_WORDS and row[0] != shard[-1][0]:
                    yield done()
                    shard, size = [], 0
                shard.append(row)
                size += len(row[4]) // 8
        if shard:
            yield done()

    # rows that repeat id and text are fetched more than once, but each stands for one piece already counted
    regular = fetched.filter(F.col("words").isNotNull()).dropDuplicates(["anchor", "id", "version", "first"])
    spans = (
        regular.select("anchor", "id", "version", "first", "words", "occurs").repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(match, f"{key}, start int, stop int")
    )
    hot = (
        fetched.filter(F.col("hashes").isNotNull()).dropDuplicates(["anchor", "id", "version", "first"])
        .select("id", "version", "occurs", "first", F.posexplode("hashes").alias("at", "hash"))
    )
    hot_twice = cut(hot.groupBy("hash").agg(F.sum("occurs").alias("n")).filter("n > 1").select("hash"))
    hot_spans = hot.filter("occurs = 1").join(hot_twice, "hash").select(
        "id", "version", (F.col("first") + F.col("at")).alias("start"), (F.col("first") + F.col("at") + n).alias("stop"))

    gone = whole.union(spans).union(hot_spans).groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))

    def remove(batches):
        for batch in batches:
            where = batch.schema.get_field_index("__text")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, n_words, n_removed = [], [], []
                for text, spans_gone in zip(texts(part.column(where)), part.column(where + 1).to_pylist()):
                    words = (text or b"").split()
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans_gone or ():
                        edge[s["start"]] += 1
                        edge[s["stop"]] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    kept.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s))
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(stays.sum()))
                yield with_arrays(part.select([c for c in part.schema.names if c not in ("__text", "__gone")]), {
                    text_col: pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    joined = (
        docs.withColumn("id__", row_id).withColumn("version__", version)
        .join(gone.select(F.col("id").alias("id__"), F.col("version").alias("version__"), F.col("gone").alias("__gone")).hint("shuffle_hash"), ["id__", "version__"], "left")
        .select(*others, F.col(text_col).alias("__text"), "__gone")
    )
    return joined.mapInArrow(remove, extended(joined.drop("__text", "__gone"), (text_col, "string"), ("n_words", "bigint"), ("n_removed", "bigint")))
