import re
from collections import Counter

import numpy as np
import pytest

from twinraster.llm import quality_rules as Q

GOOD = [" ".join(f"w{(i * 7 + j * j) % 997}x{j}" for j in range(60 + i)) + ".\nlast line" for i in range(60)]
BAD = [" ".join(f"W{(i * 5 + j) % 991}Y{j}###" for j in range(80)) for i in range(12)]


def plain(text):
    """The counts by their definition, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines, earlier, copies = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), copies, len(covered)


TEXTS = [None, "", " \t\n", "a", "a b", "a b a b a b", "é è|é è|é é è|é", "x\nx\n \nx \nx", "a\x0bb\x0cc\rd e a\x0bb\x0cc",
         "one two three\n" * 40, "ÄÖ Ü ß " * 30, GOOD[0], BAD[0], "word " * 30_000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_counts_follow_the_definition(text):
    assert Q.statistics(None if text is None else text.encode())[:5] == plain(text)


def labelled(spark):
    rows = [(i, t, None, 1.5) for i, t in enumerate(GOOD + BAD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words double")
    labels = spark.createDataFrame([(i, int(i < len(GOOD)), 0) for i in range(len(rows)) if i % 2], "doc_id long, quality int, toxic int")
    return docs, labels


def test_unlabelled_rows_are_told_apart(spark):
    found = {r.doc_id: r for r in Q.judge(*labelled(spark)).collect()}
    assert len(found) == len(GOOD) + len(BAD)
    for i, r in found.items():
        assert not r.base_failed and r.kept == (i < len(GOOD)), (i, r.anomaly)


def test_odd_rows_and_empty_tables(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, None, None, None), (5, None, "a", 0.0), (900, "", "a", 0.0), (901, GOOD[3], None, None)] * 2, docs.schema)
    found = [(r.doc_id, r.kept) for r in Q.judge(docs.union(odd), labels).collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted(found, key=str) == sorted([(None, False), (900, False), (901, True)] * 2, key=str)
    assert Q.judge(docs.limit(0), labels).collect() == []
    assert all(r.kept for r in Q.judge(docs, labels.limit(0)).collect())


def test_threshold_and_forest():
    assert Q.calibrated(np.array([.4, .5]), np.array([True, True])) == np.inf
    assert Q.calibrated(np.array([.4, .5, .9]), np.array([True, True, False])) == pytest.approx(.7)
    rows = np.random.default_rng(1).uniform(.1, .2, (500, 2))
    forest = Q.IsolationForest(rows)
    assert forest.score(np.array([[.9, .8]]))[0] > .6 > np.median(forest.score(rows))
