"""Secret scans: a random forest over candidate strings removes false positives.

Runs of key-like characters with a digit are candidates, however long, and so is whatever is assigned to a name that says credential. What a forest can tell them apart by is their length, their character classes and
the transitions between them, how well the letter triples of the corpus cover them, the path they stand in and the words
beside them. The forest is trained on labelled findings; where none are given, findings are labelled by two narrow rules,
and everything between the rules is left to the forest.
"""
from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A run: at least 16 key-like characters in a row with a digit among them. ``scan`` also takes the longer ones (``WHOLE_RUN``).
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-]*[0-9])[A-Za-z0-9+/_=\-]{16,512}(?![A-Za-z0-9+/_=\-])")
#: Words that name a credential, for the rules that label findings.
CREDENTIAL = re.compile(r"(?:^|[^a-z])(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth|bearer|credential)s?(?:[^a-z]|$)", re.I)
WHOLE_RUN = re.compile(CANDIDATE.pattern.replace("{16,512}", "{16,}"))
#: A value assigned to a name that says credential, whatever its length and characters: up to the closing quote, or to the next blank.
ASSIGNED = re.compile(
    r"""(?:(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth|bearer|credential)s?(?![A-Za-z])[\w.\-\]]{0,32}|authorization)["']?"""
    r"""[^\S\r\n]*(?::=|=>|={1,3}|:)[^\S\r\n]*(?:(?:bearer|basic|token)[^\S\r\n]+)?(?:"(?!\s*")([^"\r\n]+)"|'(?!\s*')([^'\r\n]+)'|["']?(?=([^\s"'])))""", re.I)
_BLANK = re.compile(r"\s|$")
_NAMES = ("token", "secret", "passw", "pwd", "apikey", "api_key", "accesskey", "access_key", "privatekey", "private_key", "auth", "bearer", "credential")
#: Bounds of the fit: labelled findings used, trees, their depth, and hashed places for path parts and neighbouring words.
MAX_LABELLED, TREES, DEPTH, PATH_PLACES, WORD_PLACES = 20_000, 40, 6, 8, 24
#: Characters of context kept on either side.
CONTEXT = 48
COMMON_SHARE = 2e-5

_CLASS = np.full(256, 4, dtype=np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2
_CLASS[[43, 47, 61, 45, 95]] = 3


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the whole runs and the assigned values of a text, each span once. Spans may overlap; of unquoted
    assignments within one another and with one end, only the outermost and the innermost count, so the spans of a text
    are a few times its length in all, and so is the time."""
    found, at, end, inner = {m.span() for m in WHOLE_RUN.finditer(text)}, 0, -1, None
    assigned, low = set(), text.lower()
    if not any(name in low for name in _NAMES):
        return sorted(found)
    while m := ASSIGNED.search(text, at):
        at = m.start(m.lastindex)  # a value may itself hold an assignment
        if m.lastindex < 3:
            assigned.add(m.span(m.lastindex))
            continue
        if at >= end:
            end, inner = _BLANK.search(text, at).start(), None
            stop = end
            while stop - 1 > at and text[stop - 1] in ",;\"'":
                stop -= 1
            assigned.add((at, stop))
        else:
            if inner is not None:
                assigned.discard(inner)
            inner = (at, max(stop, at + 1))
            assigned.add(inner)
    return sorted(found | assigned)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", whole: bool = False) -> DataFrame:
    """(id, path, start, value, before, after): every run of the whole text, or with ``whole`` all that ``spans`` finds; ``start`` in
    code points from 0."""
    places = spans if whole else lambda text: [m.span() for m in CANDIDATE.finditer(text)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, out = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    for start, end in places(text or ""):
                        rows.append(row)
                        out.append((start, text[start:end], text[max(0, start - CONTEXT): start], text[end: end + CONTEXT]))
                where = pa.array(rows, pa.int64())
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(where), part.column(2).take(where)] + [pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.string()] * 3)],
                    names=["id", "path", "start", "value", "before", "after"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, path string, start bigint, value string, before string, after string")


def letter_triples(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each of the 26^3 triples of ASCII letters (case folded) occurs in all texts; at most 17,576 counts travel
    from each task and are summed by Spark."""
    code = np.full(256, -1, dtype=np.int64)
    code[65:91] = code[97:123] = np.arange(26)

    def run(batches):
        total = np.zeros(26**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                c = code[np.frombuffer(text or b"", dtype=np.uint8)]
                if len(c) > 2:
                    whole = (c[:-2] >= 0) & (c[1:-1] >= 0) & (c[2:] >= 0)
                    total += np.bincount((c[:-2] * 676 + c[1:-1] * 26 + c[2:])[whole], minlength=26**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["triple", "n"])

    counts = np.zeros(26**3, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(run, "triple int, n bigint").groupBy("triple").agg(F.sum("n").alias("n")).collect():
        counts[r.triple] = r.n
    return counts


def features(value: str, path: str | None, before: str, after: str, common: np.ndarray) -> list[float]:
    """Numbers that describe one candidate; ``common`` marks the letter triples that the corpus uses."""
    raw = np.frombuffer(value.encode(), dtype=np.uint8)
    kind = _CLASS[raw]
    n = len(raw)
    shares = [float((kind == c).mean()) for c in range(4)]
    changes = kind[1:] != kind[:-1]
    pairs = kind[:-1] * 4 + kind[1:]
    moves = np.bincount(pairs, minlength=16)[:16] / max(1, n - 1)
    _, counts = np.unique(raw, return_counts=True)
    entropy = float(-(counts / n * np.log2(counts / n)).sum())
    letters = np.where((raw >= 97) & (raw <= 122), raw - 97, np.where((raw >= 65) & (raw <= 90), raw - 65, 255)).astype(np.int64)
    whole = (letters[:-2] < 26) & (letters[1:-1] < 26) & (letters[2:] < 26)
    triples = (letters[:-2] * 676 + letters[1:-1] * 26 + letters[2:])[whole]
    covered = float(common[triples].sum()) / n if len(triples) else 0.0
    hexadecimal = float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None)
    where = [0.0] * PATH_PLACES
    for part in re.findall(r"[A-Za-z]+|[0-9]+", path or "")[:16]:
        where[crc32(part.lower().encode()) % PATH_PLACES] = 1.0
    beside = [0.0] * (2 * WORD_PLACES)
    for side, words in ((0, re.findall(r"[A-Za-z_]+", before)[-3:]), (1, re.findall(r"[A-Za-z_]+", after)[:2])):
        for word in words:
            beside[side * WORD_PLACES + crc32(word.lower().encode()) % WORD_PLACES] = 1.0
    signs = [float(c in before[-4:]) for c in "\"'=:@/."] + [float(CREDENTIAL.search(before[-24:]) is not None)]
    return [math.log2(n), *shares, float(changes.mean()) if n > 1 else 0.0, entropy, covered, hexadecimal, *moves.tolist(), *where, *beside, *signs]


def weak_label(value: str, before: str) -> int | None:
    """1 for a varied value assigned to a name that says credential; 0 for plain numbers, dates, identifiers in dashes and
    words with a number; None for everything else, which no rule decides."""
    assigned = re.search(r"([A-Za-z_\-]+)[\"']?\s*[:=]\s*[\"']?$", before)
    if assigned and CREDENTIAL.search(assigned.group(1)) and len(set(value)) >= 8:
        return 1
    if assigned or CREDENTIAL.search(before):
        return None
    if re.fullmatch(r"[0-9+/_=\-]+", value) or re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", value, re.I) or re.fullmatch(r"[A-Za-z+/_=\-]+[0-9]{1,4}", value):
        return 0
    return None


def described(found: DataFrame, common: np.ndarray) -> DataFrame:
    """``found`` with ``features`` (array of double) and ``label`` (null where no rule decides)."""
    shared = found.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            paths, values, before, after = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "value", "before", "after"))
            rows = [features(v, p, b, a, shared.value) for v, p, b, a in zip(values, paths, before, after)]
            labels = [weak_label(v, b) for v, b in zip(values, before)]
            keep = [c for c in batch.schema.names if c not in ("features", "label")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=[*keep, "features", "label"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name not in ("features", "label"))
    return found.mapInArrow(run, f"{schema}, features array<double>, label int")


def train(labelled: DataFrame, seed: int = 5):
    """A random forest on at most ``MAX_LABELLED`` rows of each label in hash order; None if a label is missing."""
    order = F.xxhash64("value", "before", "id", "start")
    known = labelled.filter(F.col("label").isNotNull())
    parts = [known.filter(F.col("label") == c).orderBy(order).limit(MAX_LABELLED) for c in (0, 1)]
    sizes = [p.count() for p in parts]
    if not all(sizes):
        return None
    rows = stored(parts[0].union(parts[1]).coalesce(4), "findings").select(  # bounded, and read again for every level of the trees
        F.col("label").cast("double"), array_to_vector("features").alias("features"),
        F.when(F.col("label") == 1, F.lit(1.0 / sizes[1])).otherwise(F.lit(1.0 / sizes[0])).alias("weight"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="weight", featureSubsetStrategy="onethird", minInstancesPerNode=1, minWeightFractionPerNode=0.001).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start, n_chars, value_sha256, label, probability, is_secret): one row per candidate; the value itself is not shown.

    ``labelled`` has the columns of ``candidates`` and ``label`` (1 secret, 0 not). Defined cases: null, empty and candidate-free
    texts give no rows; rows that repeat a text repeat its candidates; null ids and paths pass; if a label is missing there
    is nothing to learn, so the rules' label alone decides and what they leave open is kept as a finding of probability 0.5.
    """
    common = letter_triples(docs, text_col)
    common = (common > COMMON_SHARE * max(1, common.sum())).astype(np.float64)
    found = stored(described(candidates(docs, id_col, text_col, path_col, whole=True), common), "candidates")
    known = found
    if labelled is not None:
        known = described(labelled.withColumnRenamed("label", "given"), common).withColumn("label", F.col("given").cast("int"))
    model = train(known)
    if model is None:
        scored = found.withColumn("p", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
    else:
        vectors = found.withColumn("features", array_to_vector("features"))
        scored = model.transform(vectors).withColumn("p", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id_col), "start", F.char_length("value").cast("bigint").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"),
        "label", F.round("p", 6).alias("probability"), (F.col("p") >= 0.5).alias("is_secret"))
