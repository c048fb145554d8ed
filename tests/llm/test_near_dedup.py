import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from twinraster.llm import near_dedup as N

VOCABULARY = [f"w{i}" for i in range(4000)]


def similarity(a, b):
    """Weighted Jaccard on five-word shingles, by definition."""
    def bag(text):
        words = (text or "").split()
        k = min(5, len(words))
        return Counter(tuple(words[i: i + k]) for i in range(len(words) - k + 1)) if words else Counter()
    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def brute(rows):
    parent = {i: i for i, _ in rows}
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if root(i) != root(j) and similarity(s, t) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    for group in range(25):
        base = rng.choices(VOCABULARY, k=rng.choice([3, 12, 60, 200, 900]))
        for copy in range(rng.choice([1, 2, 3, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            rows.append((n, " ".join(words)))
            n += 1
    chain = rng.choices(VOCABULARY, k=300)  # neighbours are similar, ends are not
    for step in range(12):
        rows.append((n + step, " ".join(chain[step * 8: step * 8 + 200])))
    n += 12
    shared = rng.choices(VOCABULARY, k=120)  # a shared passage, below the threshold
    rows += [(n + i, " ".join(shared + rng.choices(VOCABULARY, k=60))) for i in range(12)]
    rng.shuffle(rows)
    return rows


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((1, 1), (7, 5), (400, 300), (30_000, 20_000)):
        pool = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        a, b = pool[:n], pool[n - shared:]
        expected = shared / (2 * n - shared)
        rates = [np.mean(N.dart_signature(N.mix(a + np.uint64(s))) == N.dart_signature(N.mix(b + np.uint64(s)))) for s in range(20)]
        assert abs(np.mean(rates) - expected) < 0.06, (n, np.mean(rates), expected)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, id int").repartition(5)
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == brute(rows)


def test_large_groups_stay_linear(spark):
    rng = random.Random(9)
    base = rng.choices(VOCABULARY, k=150)
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 500):
        words = list(base)
        words[rng.randrange(150)] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 500 and {r.class_id for r in found} == {0}


def test_heavily_edited_copies(spark):
    rng = random.Random(4)
    base = rng.choices(VOCABULARY, k=150)
    rows = [(7, " ".join(base))]
    for i in range(100, 260):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(150)] = rng.choice(VOCABULARY)
        if i % 11 == 0:
            del words[rng.randrange(150)]
        rows.append((i, " ".join(words)))
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == brute(rows)


def test_odd_rows(spark):
    long_text = " ".join(VOCABULARY * 10)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, " a  b "), (6, "a c"), (7, long_text), (8, long_text + " end"), (9, None),
            (None, "a b"), (10, "a b"), (10, "a b"), (11, "p q r"), (11, "a c"), (12, "p q r")]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 1, 10: 4, 11: 6, 12: 6}
    assert len(found) == 12
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
