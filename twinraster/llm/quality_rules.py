"""Quality rules: an isolation forest over rule statistics.

Every document gets the same few statistics in one map over its whole text. A forest of random splits is grown on the good
rows of a bounded labelled sample; documents that few splits isolate are anomalous. Good and bad rows of that sample set the
threshold. The second map scores all documents against the broadcast forest (its size is fixed by the parameters).
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, shingle_hashes, texts, with_arrays, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_ratio", "upper_ratio", "repeat_ratio", "dup_line_ratio", "wordless_ratio")
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bounds of the fit: labelled rows used, trees, and rows each tree sees.
MAX_LABELLED, TREES, TREE_ROWS = 8192, 100, 256
#: A good labelled row that the threshold would reject weighs as much as so many bad rows that it keeps.
GOOD_WEIGHT = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def statistics(text: bytes | None) -> tuple:
    """``COUNTS`` and then ``RATIOS`` of one whole text; all zero for null, empty or blank text."""
    words, starts, ends = word_hashes(text or b"")
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    raw = np.frombuffer(text, dtype=np.uint8)
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    blanks = len(raw) - int((ends - starts).sum())
    chars = int(((raw & 0xC0) != 0x80).sum()) - blanks
    symbols, upper = int(_SYMBOL[raw].sum()), int(_UPPER[raw].sum())
    repeated = 0
    if n >= 3:
        _, inverse, counts = np.unique(shingle_hashes(words, 3), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, dtype=bool)
        for j in range(3):
            covered[j: j + len(twice)] |= twice
        repeated = int(covered.sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    copies = len(lines) - len(set(lines))
    wordless = int((letters[ends] == letters[starts]).sum())
    return (n, chars, symbols, copies, repeated, symbols / chars, upper / max(1, int(letters[-1])), repeated / n, copies / len(lines), wordless / n)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS`` (long) and ``RATIOS`` (double); columns of those names are replaced."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = zip(*[statistics(t) for t in texts(part.column(part.schema.get_field_index(text_col)))])
                kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)
                yield with_arrays(part, {c: pa.array(v, k) for c, v, k in zip(COUNTS + RATIOS, rows, kinds)})

    return docs.mapInArrow(run, extended(docs, *[(c, "long") for c in COUNTS], *[(c, "double") for c in RATIOS]))


def base_failed():
    """The rules that need no model."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows: what a leaf that still holds ``n`` rows adds to its depth."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def features(ratios: np.ndarray) -> np.ndarray:
    """The ``RATIOS`` on a scale that suits even splits: roots spread shares that are small even in junk, squares shrink
    shares that a short clean text can reach by chance. All lie in 0..1."""
    return np.stack([np.sqrt(ratios[:, 0]), ratios[:, 1], ratios[:, 2] ** 2, ratios[:, 3] ** 2, np.sqrt(ratios[:, 4])], axis=1)


class IsolationForest:
    """Random splits as complete binary trees in arrays: children of node i are 2i+1 and 2i+2.

    A cut is drawn over the node's whole box inside 0..1 and not only between its rows: space without rows then gets short
    paths, whereas a cut inside the rows' range could never tell a value far outside it from the largest value inside.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 17):
        rng = np.random.default_rng(seed)
        size, width = min(tree_rows, len(rows)), rows.shape[1]
        self.depth = max(1, math.ceil(math.log2(max(2, size))))
        nodes = 2 ** (self.depth + 1) - 1
        self.norm = expected_path(size) or 1.0
        self.feature = np.full((trees, nodes), -1, dtype=np.int32)
        self.cut = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            open_nodes = [(0, 0, rows[rng.choice(len(rows), size, replace=False)], np.zeros(width), np.ones(width))]
            while open_nodes:
                node, depth, mine, low, high = open_nodes.pop()
                if depth == self.depth or len(mine) < 2:
                    self.path[t, node] = depth + expected_path(len(mine))
                    continue
                f = rng.integers(width)
                c = rng.uniform(low[f], high[f])
                self.feature[t, node], self.cut[t, node] = f, c
                below, above = high.copy(), low.copy()
                below[f] = above[f] = c
                right = mine[:, f] > c
                open_nodes += [(2 * node + 1, depth + 1, mine[~right], low, below), (2 * node + 2, depth + 1, mine[right], above, high)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1 per row; higher is more anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (rows[every, np.maximum(f, 0)] > cut[at]))
            total += path[at]
        return 2.0 ** (-total / (len(self.feature) * self.norm))


def calibrated(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold above which documents go: least weighted error on labelled rows, halfway to the next score, and the
    highest of equals. Without a bad row nothing goes; without a good row there is nothing to tell bad rows from, nor then."""
    if good.all() or not good.any():
        return math.inf
    levels = np.unique(scores)
    lost = np.array([GOOD_WEIGHT * (good & (scores > level)).sum() + (~good & (scores <= level)).sum() for level in levels])
    best = int(len(levels) - 1 - np.argmin(lost[::-1]))
    return float((levels[best] + levels[best + 1]) / 2) if best + 1 < len(levels) else math.inf


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality"):
    """(forest, threshold) from at most ``MAX_LABELLED`` labelled documents that pass the base rules, in hash order.

    Rows without an id or a label don't count; an id with two labels counts as bad. Without usable rows: (None, inf).
    """
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("good")).dropna()
        .groupBy("id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    )
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = (
        with_statistics(some, "text").filter(~base_failed())
        .groupBy("id").agg(F.min("good").alias("good"), *[F.max(c).alias(c) for c in RATIOS]).orderBy("id").collect()
    )
    if not rows:
        return None, math.inf
    table, good = features(np.array([[r[c] for c in RATIOS] for r in rows])), np.array([r.good > 0 for r in rows])
    if not good.any():
        return None, math.inf
    forest = IsolationForest(table[good])
    return forest, calibrated(forest.score(table), good)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS``, ``RATIOS``, ``base_failed``, ``anomaly`` (0 to 1) and ``kept``.

    ``kept`` is false if ``base_failed``, else whether ``anomaly`` is at most the calibrated threshold. Defined cases: null,
    empty and blank texts fail the base rules; equal texts get equal verdicts; rows out are rows in; columns of ``docs``
    with one of these names are replaced; an empty ``labels`` leaves the verdict to the base rules.
    """
    forest, threshold = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    found = with_statistics(docs, text_col)

    def run(batches):
        for batch in batches:
            rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in RATIOS], axis=1)
            yield with_arrays(batch, {"anomaly": pa.array(shared.value.score(features(rows)))})

    if forest is None:
        scored = found.withColumn("anomaly", F.lit(0.0))
    else:
        scored = found.mapInArrow(run, extended(found, ("anomaly", "double")))
    failed = base_failed()
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") <= F.lit(threshold)))
