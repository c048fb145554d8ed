"""Language identification with a blended-spectrum presence kernel.

The kernel of two texts is the number of byte n-grams (n = 1 to 4) that occur in both, over the geometric mean of the numbers
that occur in each. Landmark texts give Nystroem features, and ridge regression on them, one target per language, is kernel
ridge regression one-versus-rest. As a kernel row is linear in the presence bits of a text, landmarks and weights fold into
one table of n-gram weights per language, and a batch of texts is scored by one product of a sparse presence matrix with it.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, mix, texts, with_arrays

_U = np.uint64
#: Bits per n: 1-grams and 2-grams have a place of their own, longer ones share 2^16 places by hash.
_OFFSET = {1: 0, 2: 256, 3: 256 + 65_536, 4: 256 + 2 * 65_536}
WIDTH = 256 + 3 * 65_536
#: Bounds of the fit: labelled rows per language and in all, landmarks over all languages, ridge.
ROWS_PER_LANGUAGE, MAX_ROWS, LANDMARKS, RIDGE = 400, 8000, 240, 1e-2
#: Languages whose n-gram weights are folded into one table; with more, texts are scored through the landmarks, which gives the same
#: outputs without a table of all n-grams by all languages.
MAX_FOLDED = 100
UNDETERMINED = "und"

_KEEP = np.zeros(256, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_KEEP[_KEEP == 0] = 32


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def present(text: bytes) -> np.ndarray:
    """Sorted places of the n-grams in a text: ASCII letters lower-cased, everything else below 128 one blank."""
    raw = _KEEP[np.frombuffer(text, dtype=np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])] if len(raw) else raw
    raw = np.concatenate([[32], raw, [32]]).astype(_U)
    seen = np.zeros(WIDTH, dtype=bool)
    code = raw
    seen[code.astype(np.int64)] = True
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        code = (code[:-1] << _U(8)) | raw[n - 1:]
        place = code if n == 2 else mix(code * _U(2 * n + 1)) & _U(0xFFFF)
        seen[place.astype(np.int64) + _OFFSET[n]] = True
    return np.flatnonzero(seen).astype(np.int32)


class Landmarks:
    """Landmark texts by the n-grams they hold: a sparse presence matrix."""

    def __init__(self, places: list[np.ndarray]):
        every = np.concatenate(places)
        order = np.argsort(every, kind="stable")
        self.of = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])[order]
        self.first = np.searchsorted(every[order], np.arange(WIDTH + 1)).astype(np.int64)
        self.roots = np.sqrt(np.array([len(p) for p in places]))

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row per text: the n-grams it shares with each landmark, over the geometric mean of their numbers."""
        out = np.zeros((len(texts), len(self.roots)))
        for row, places in enumerate(texts):
            sizes = self.first[places + 1] - self.first[places]
            skip = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            held = self.of[np.repeat(self.first[places] - skip, sizes) + np.arange(sizes.sum())]
            out[row] = np.bincount(held, minlength=len(self.roots)) / self.roots / np.sqrt(len(places))
        return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray | None  # WIDTH x languages
    landmarks: Landmarks | None = None
    alpha: np.ndarray | None = None  # landmarks x languages

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        """One row of ridge outputs per text: the product of the scaled presence matrix with the folded weights, or of the
        kernel to the landmarks with theirs."""
        if self.weights is None:
            return self.landmarks.kernel(places) @ self.alpha
        sizes = np.array([len(p) for p in places])
        gathered = self.weights[np.concatenate(places)]
        sums = np.add.reduceat(gathered, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return sums / np.sqrt(sizes)[:, None]


def fit(places: list[np.ndarray], labels: list[str]) -> Model | None:
    """Kernel ridge on Nystroem features. Landmarks are spread evenly over the languages, in the order given."""
    languages = sorted(set(labels))
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    of = np.array([number[x] for x in labels])
    share = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([np.flatnonzero(of == c)[:share] for c in range(len(languages))])

    landmarks = Landmarks([places[c] for c in chosen])
    every = landmarks.kernel(places)
    between = every[chosen]
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nystroem: features = kernel to landmarks times this root
    features = every @ root
    targets = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = 1.0 / np.bincount(of)[of]  # each language weighs the same
    gram = (features * balance[:, None]).T @ features + RIDGE * np.eye(features.shape[1]) / len(languages)
    alpha = root @ np.linalg.solve(gram, (features * balance[:, None]).T @ targets)
    if len(languages) > MAX_FOLDED:
        return Model(languages, None, landmarks, alpha)
    weights = np.zeros((WIDTH, len(languages)))
    for c, row in zip(chosen, alpha):
        weights[places[c]] += row / np.sqrt(len(places[c]))
    return Model(languages, weights.astype(np.float32))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of every language from ``ROWS_PER_LANGUAGE`` rows of each (fewer if they would pass ``MAX_ROWS``, one at least) in hash order of their ids (rows without id, letters or
    language are passed over); None if there are none. Each id is drawn once; the text read is the smallest it has."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    usable = labelled.filter(F.col(text_col).rlike(r"\p{L}"))
    ids = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).dropna().groupBy("id").agg(F.min("lang").alias("lang"))
    languages = ids.select("lang").distinct().count()
    if not languages:
        return None
    drawn = ids.withColumn("r", F.row_number().over(order)).filter(
        F.col("r") <= min(ROWS_PER_LANGUAGE, max(1, MAX_ROWS // languages))).select("id", "lang")
    bodies = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            rows = [present(t).tobytes() for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "lang", "places"])

    found = bodies.join(F.broadcast(drawn), "id").select("id", "lang", "text").mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, lang string, places binary")
    rows = found.groupBy("id", "lang").agg(F.min("places").alias("places")).orderBy(F.xxhash64("id"), "id").collect()
    return fit([np.frombuffer(r.places, dtype=np.int32) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of the largest ridge output and a score of 0 to 1 (its softmax share).

    Defined cases: null text, or text without a letter, is ``und`` with score 0, and so is every text if ``model`` is None;
    ties go to the first language in alphabetical order; columns of ``docs`` named like ``out`` are replaced. Only the
    text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(part.schema.get_field_index(text_col))
                usable = [t is not None and model is not None and has_letter(t) for t in column.to_pylist()]
                names, scores = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                rows = np.flatnonzero(usable)
                if len(rows):
                    every = texts(column)
                    outputs = model.scores([present(every[i]) for i in rows])
                    best = outputs.argmax(axis=1)
                    shares = np.exp(4 * (outputs - outputs.max(axis=1, keepdims=True)))
                    scores[rows] = 1.0 / shares.sum(axis=1)
                    for i, b in zip(rows, best):
                        names[i] = model.languages[b]
                yield with_arrays(part, {out[0]: pa.array(names), out[1]: pa.array(scores)})

    return docs.mapInArrow(run, extended(docs, (out[0], "string"), (out[1], "double")))


def fold(id_col: Column, folds: int = 4) -> Column:
    """The fold of a row by the CRC-32 of its id as text."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)).cast("int")
