"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Text goes in piece by piece and token ids come out as soon as nothing that may follow can change them. Two lookaheads make
that possible, and both are constants. A match of the splitting pattern is settled once two characters behind its end are
known. Inside a match, a token is settled once more than ``lookahead`` bytes behind its end are known; that number
is computed from the list of merges. What is held back, and so the memory besides input and output, doesn't grow with the text.

The lookahead. A merge list is proper if every rule joins single bytes or results of earlier rules, so merges happen in order
of rank. Let one text be continued in two ways, and let a boundary between two of its bytes be merged away in one
of them, by a rule (u, v), but not by that rule in the other. Then either v isn't complete within the known text, or a boundary inside v or
at its end fares differently at a lower rank (or one further left does, which then stands for it). So an influence travels left
along rules of rising rank, each reaching from its boundary to one within its right part, where the bytes of both
rules agree. The longest such chain bounds how far from the end of the known text a boundary can still change.
"""
from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import extended, mix, with_arrays
from .units import BARE, UnitMemory, unit_keys

#: The pattern of the byte-level pre-tokenizer: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters fed at once, and the length from which an unfinished match goes to the byte transducer while it is read.
CHUNK, OPEN = 1 << 16, 1 << 12
#: Bytes of a word up to which words are merged together: four for each character that a remembered word may have.
SHORT = 192
#: Characters of text whose units are looked up together.
BATCH = 1 << 20
_KINDS = [regex.compile(k) for k in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The number of bytes behind a boundary that settle it, for a proper merge list in order of rank.

    ``reach`` of a rule is how far right of its boundary a cause can lie. A rule (u, v) can hang on an earlier rule
    (p, q) whose boundary lies after ``o`` bytes of v if p and v[:o] agree from the right and q and v[o:] from the left, one
    being an end of the other. Four tables hold the largest reach by the bytes that must agree.
    """
    both: dict[tuple[bytes, bytes], int] = {}  # ends of p, starts of q
    left: dict[tuple[bytes, bytes], int] = {}  # whole p, starts of q
    right: dict[tuple[bytes, bytes], int] = {}  # ends of p, whole q
    whole: dict[tuple[bytes, bytes], int] = {}
    longest = 0
    for u, v in merges:
        reach = len(v)
        for o in range(1, len(v) + 1):
            a, b = v[:o], v[o:]
            found = both.get((a, b), 0)
            for k in range(o):
                found = max(found, left.get((a[k:], b), 0))
            for e in range(1, len(b) + 1):
                found = max(found, right.get((a, b[:e]), 0))
                for k in range(o):
                    found = max(found, whole.get((a[k:], b[:e]), 0))
            if found:
                reach = max(reach, o + found)
        for e in range(len(v) + 1):
            for k in range(len(u)):
                key = u[k:], v[:e]
                both[key] = max(both.get(key, 0), reach)
            left[u, v[:e]] = max(left.get((u, v[:e]), 0), reach)
        for k in range(len(u)):
            right[u[k:], v] = max(right.get((u[k:], v), 0), reach)
        whole[u, v] = max(whole.get((u, v), 0), reach)
        longest = max(longest, reach)
    return longest


class MergeList:
    """Tokens, merges, added tokens and the lookahead of a byte-level BPE file. Its size is that of the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE without normaliser, prefix space and fallbacks is known")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        number = {as_bytes(t): i for t, i in model["vocab"].items()}
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        made = {bytes([b]) for b in range(256)}
        for u, v in merges:
            if u not in made or v not in made or u + v in made:
                raise ValueError(f"the merge list is not proper at {u + v!r}")
            made.add(u + v)
        self.single = np.array([number[bytes([b])] for b in range(256)], dtype=np.int32)
        #: pair of ids -> rank and id of the two together
        self.joined = {(number[u], number[v]): (rank, number[u + v]) for rank, (u, v) in enumerate(merges)}
        self.made = np.array([number[u + v] for u, v in merges], dtype=np.int32)
        # the same pairs as a hash table with linear probing, for whole arrays of pairs
        self.slots, self.slot_rank = np.full(max(16, 4 * len(merges)), -1, dtype=np.int64), np.zeros(max(16, 4 * len(merges)), dtype=np.int64)
        keys = np.array([a << 32 | b for a, b in self.joined], dtype=np.int64)
        for rank, slot in enumerate((mix(keys.astype(np.uint64)) % np.uint64(len(self.slots))).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.slot_rank[slot] = keys[rank], rank
        self.lookahead = sufficient_lookahead(merges)
        self.added: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("added tokens that look at their neighbours are not known")
            self.added[token["content"]] = token["id"]
        content = {i: t for t, i in number.items()}
        content |= {i: as_bytes(t) if all(c in letters for c in t) else t.encode("utf-8") for t, i in self.added.items()}
        self.tokens = [content.get(i) for i in range(max(content) + 1)]
        self.length = np.array([len(t or b"") for t in self.tokens], dtype=np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``len(made)`` where no rule joins them."""
        key = a.astype(np.int64) << 32 | b
        slot = (mix(key.astype(np.uint64)) % np.uint64(len(self.slots))).astype(np.int64)
        found = self.slots[slot]
        out = np.where(found == key, self.slot_rank[slot], len(self.made))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.slots)
            found = self.slots[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short runs of bytes in one array, and how many each run has. Every round merges the pair of lowest
        rank of each run, at all its places from the left."""
        n, none = len(words), len(self.made)
        part = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(n), np.fromiter(map(len, words), dtype=np.int64, count=n))
        rank = np.full(len(part), none, dtype=np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(part[inner], part[inner + 1])
        done_word, done_part = [], []
        while len(part):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(part)))
            ready = low == none
            if ready.any():
                done_word.append(word[ready])
                done_part.append(part[ready])
                part, word, rank, low = part[~ready], word[~ready], rank[~ready], low[~ready]
            at = np.flatnonzero(rank == low)
            if not len(at):
                break
            if (np.diff(at) == 1).any():  # of overlapping places every other one counts, from the left
                fresh = np.diff(at, prepend=-2) != 1
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 0]
            part[at] = self.made[rank[at]]
            keep = np.ones(len(part), dtype=bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # where a word ends no pair begins
            new = (np.cumsum(keep) - 1)[at]
            part, word, rank = part[keep], word[keep], rank[keep]
            changed = np.zeros(len(part) + 1, dtype=bool)
            changed[new] = changed[new - 1] = True  # before the first stands the last, which is left out
            near = np.flatnonzero(changed[: len(part) - 1])
            same = word[near] == word[near + 1]
            near, last = near[same], near[~same]
            rank[last] = none
            rank[near] = self._rank(part[near], part[near + 1])
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word, part = np.concatenate(done_word), np.concatenate(done_part)
        return part[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def merge(self, data: bytes) -> list[int]:
        """Ids of a long run of bytes: the pair of lowest rank, the leftmost first, becomes one, until none is left."""
        joined, parts = self.joined.get, self.single[np.frombuffer(data, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r[0], i) for i, r in enumerate(map(joined, zip(parts, parts[1:]))) if r]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            found = joined((parts[i], parts[j])) if j >= 0 and parts[i] is not None else None
            if found is None or found[0] != rank:
                continue  # this pair is gone
            parts[i], parts[j], k = found[1], None, after[j]
            after[i] = k
            for a, b in ((before[i], i), (i, k)):
                near = joined((parts[a], parts[b])) if a >= 0 and b >= 0 else None
                if near:
                    heappush(heap, (near[0], a))
            if k >= 0:
                before[k] = i
        return [p for p in parts if p is not None]


class ByteTransducer:
    """Bytes of one match in, settled ids out. Holds at most ``window`` bytes, beyond the lookahead, between two calls."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self.merges, self.held = merges, b""
        self.window = window or 4 * merges.lookahead + 4096

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at: at + self.window]
            if len(self.held) > self.window:
                ids = self.merges.merge(self.held)
                ends = np.cumsum(self.merges.length[ids])
                settled = int(np.searchsorted(ends, len(self.held) - self.merges.lookahead))  # ends with more than the lookahead behind them
                out += ids[:settled]
                self.held = self.held[int(ends[settled - 1]) if settled else 0:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class Encoder:
    """Texts in, ids out: added tokens, then units, then matches of the pattern, then bytes."""

    def __init__(self, merges: MergeList, chunk: int = CHUNK, open_from: int = OPEN, window: int | None = None):
        self.merges, self.chunk, self.open_from, self.window = merges, chunk, open_from, window
        self.find = regex.compile(PATTERN)
        self.words = UnitMemory(self._merge_words)
        self.units = UnitMemory(self._learn)
        names = sorted(merges.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.reach = max(map(len, names), default=1) - 1  # characters that may begin an added token

    def _merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Short words all at once; the long ones, which stand last, one by one through the byte transducer."""
        data = [w.encode("utf-8") for w in words]
        short = next((k for k, w in enumerate(data) if len(w) > SHORT), len(data))
        ids, sizes = self.merges.merge_words(data[:short])
        rest = []
        for word in data[short:]:
            machine = ByteTransducer(self.merges, self.window)
            rest.append(machine.feed(word) + machine.close())
        if rest:
            ids = np.concatenate([ids, *[np.array(r, dtype=np.int32) for r in rest]])
            sizes = np.concatenate([sizes, [len(r) for r in rest]])
        return ids, sizes

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.find.findall(k[1:] if k[0:1] == BARE else " " + k) for k in keys]
        ids, sizes = self.words.ids([w for words in found for w in words])
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, found)])]
        return ids, np.diff(stops)

    def parts(self, chunks: Iterator[str]) -> Iterator[list[str] | list[int]]:
        """Lists of unit keys or of ids, in order, for the text that the chunks make up."""
        held = ""
        machine, kind = None, None
        for chunk in chain(chunks, [None]):
            final = chunk is None
            held += chunk or ""
            hit = True
            while hit:
                # up to the next added token everything is known; else up to where one could begin
                hit = self.special.search(held) if self.special else None
                stop = hit.start() if hit else len(held) if final else max(0, len(held) - self.reach)
                used, out, machine, kind = self._advance(held[:stop], final or hit is not None, machine, kind)
                yield from out
                held = held[used:]
                if hit:
                    yield [self.merges.added[hit.group()]]
                    held = held[len(hit.group()):]

    def _advance(self, text: str, ended: bool, machine, kind):
        """What of ``text`` is used, the parts it makes, and the match left open (its byte transducer and kind of characters)."""
        out, at = [], 0
        if machine is not None:
            run = kind.match(text)
            stop = run.end() if run else 0
            if stop < len(text) or ended:
                if kind is _KINDS[3] and stop < len(text):
                    stop -= 1  # white space leaves its last character to what follows
                out.append(machine.feed(text[:stop].encode("utf-8")) + machine.close())
                at, machine = stop, None
            else:
                stop = max(0, len(text) - 1)
                out.append(machine.feed(text[:stop].encode("utf-8")))
                return stop, out, machine, kind
        if ended:
            if at < len(text):
                out.append(unit_keys(text[at:], spaced=False))
            return len(text), out, None, None
        # everything before the last place where a unit starts is settled
        cut = text.rfind(" ", at, len(text) - 1)
        while cut > at and (text[cut + 1].isspace() or text[cut - 1] == " "):
            cut = text.rfind(" ", at, cut)
        if cut > at:
            out.append(unit_keys(text[at:cut], spaced=False))
            at = cut
        if len(text) - at <= self.open_from:
            return at, out, None, None
        ids, last = [], None
        for m in self.find.finditer(text, at):
            last = m
            if m.end() > len(text) - 2:
                break
            ids.append(m.group())
            at = m.end()
        out.append(self.words.ids(ids)[0].tolist())
        if last is not None and last.end() == len(text) and len(text) - at > self.open_from:
            kind = next(k for k in _KINDS if k.match(text, len(text) - 1))
            machine = ByteTransducer(self.merges, self.window)
            out.append(machine.feed(text[at:-1].encode("utf-8")))
            at = len(text) - 1
        return at, out, machine, kind

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        ids: list[np.ndarray] = []
        keys: list[str] = []
        owner: list[int] = []  # text number and number of keys, by turns
        counts = np.zeros(len(texts), dtype=np.int64)
        waiting = 0

        def look_up():
            nonlocal keys, owner, waiting
            found, sizes = self.units.ids(keys)
            stops = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *owner[1::2]])]
            np.add.at(counts, owner[0::2], np.diff(stops))
            ids.append(found)
            keys, owner, waiting = [], [], 0

        for number, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= self.chunk and (self.special is None or not self.special.search(text)):
                parts, size = [unit_keys(text, spaced=False)], len(text)
            else:
                parts, size = self.parts(text[a: a + self.chunk] for a in range(0, len(text), self.chunk)), self.chunk
            for part in parts:
                if part and isinstance(part[0], str):
                    keys += part
                    owner += [number, len(part)]
                    waiting += size
                    if waiting > BATCH:
                        look_up()
                elif part:
                    look_up()
                    ids.append(np.array(part, dtype=np.int32))
                    counts[number] += len(part)
        look_up()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


class TextMachine:
    """Bytes in, text out: holds the start of an unfinished character between two calls; what can be no character becomes
    U+FFFD, one per longest possible start, as the common decoders do."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def close(self) -> str:
        return self._machine.decode(b"", final=True)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the ids of the whole text, added tokens in it included.

    Defined cases: a null or empty text has no ids; an existing ``ids_col`` is replaced; other columns and repeated rows pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MergeList(path))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = encoder.encode(column.slice(at, 256).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield with_arrays(part, {ids_col: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))})

    return docs.mapInArrow(run, extended(docs, (ids_col, "array<int>")))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col`` (string): the text of the ids. Null or empty ids give an empty text; an id outside the
    vocabulary is an error, as nothing can stand for it; an existing ``text_col`` is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(MergeList(path).tokens)

    def run(batches):
        tokens = pa.array(shared.value, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(part.schema.get_field_index(ids_col))
                out = []
                for ids in (column.slice(k, 1).flatten() for k in range(part.num_rows)):
                    machine, text = TextMachine(), []
                    for start in range(0, len(ids), CHUNK):
                        found = tokens.take(ids.slice(start, CHUNK))
                        if found.null_count:
                            raise ValueError("an id outside the vocabulary")
                        stops = np.frombuffer(found.buffers()[1], dtype=np.int32)
                        text.append(machine.feed(found.buffers()[2].slice(0, int(stops[len(found)])).to_pybytes()))
                    text.append(machine.close())
                    out.append("".join(text))
                yield with_arrays(part, {text_col: pa.array(out, pa.string())})

    return rows.mapInArrow(run, extended(rows, (text_col, "string")))
