"""Independent units of a text, and a bounded memory of what an encoder makes of them.

A unit starts before every single space that stands between a character other than a space and one that is not white space.
No match of the usual byte-level pattern crosses such a place (the space belongs to what follows it), and no piece of a
vocabulary whose space marks stand only at the start of pieces does. A text is then encoded unit by unit, each distinct unit once.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np

_ROUGH = re.compile(r" \s")
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Stands before a unit that has no leading space; no text holds a lone surrogate.
BARE = "\udc00"


def unit_keys(text: str, spaced: bool) -> list[str]:
    """The units of ``text``, each without its leading space. With ``spaced`` the text counts as having a space before it;
    otherwise its first unit has none and is marked with ``BARE``."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or _ROUGH.search(text):
        cuts = [m.start() for m in _CUT.finditer(text)]
        keys = [text[a + 1: b] for a, b in zip([-1, *cuts], [*cuts, len(text)])]
    else:
        keys = text.split(" ")
    if not spaced:
        keys[0] = BARE + keys[0]
    return keys


class UnitMemory:
    """Ids of units: ``learn`` encodes the units not seen before (all ids in one array, and how many each has); results are
    kept as rows of one flat array.

    At most ``entries`` units of at most ``longest`` characters are remembered; then the memory starts anew. Longer units are
    encoded every time.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = 1 << 18, longest: int = 48):
        self.learn, self.entries, self.longest = learn, entries, longest
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.used = self.rows = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, rows = self.used + len(ids), self.rows + len(sizes)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * total, dtype=np.int32)])
        if rows + 1 > len(self.start):
            self.start = np.concatenate([self.start[: self.rows + 1], np.zeros(2 * rows, dtype=np.int64)])
        self.flat[self.used: total] = ids
        self.start[self.rows + 1: rows + 1] = self.used + np.cumsum(sizes)
        numbers = np.arange(self.rows, rows)
        self.used, self.rows = total, rows
        return numbers

    def ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``keys`` in one array, and how many each key has."""
        if not keys:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.row) > self.entries:
            self._forget()
        new = list(set(keys).difference(self.row))
        mark = self.rows
        if new:
            new.sort(key=len)  # the long ones stand last
            self.row.update(zip(new, self._add(*self.learn(new)).tolist()))
        out = self._gather(np.fromiter(map(self.row.__getitem__, keys), dtype=np.int64, count=len(keys)))
        short = bisect_right(new, self.longest, key=len)
        for key in new[short:]:
            del self.row[key]
        self.rows = mark + short
        self.used = int(self.start[self.rows])
        if len(self.flat) > max(1 << 24, 4 * self.used):
            self.flat = self.flat[: 2 * self.used + 1].copy()
        return out

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.start[rows]
        sizes = self.start[rows + 1] - starts
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])], sizes
