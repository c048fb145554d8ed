import random
import re
from collections import Counter

import numpy as np
import pytest

from twinraster.llm import substring_dedup as S


def brute(rows, n):
    """Removal by definition: every window counted in a dictionary."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i: i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j + d for j in range(len(w) - n + 1) if seen[tuple(w[j: j + n])] > 1 for d in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def corpus():
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(900)]
    fresh = lambda k: rng.choices(vocabulary, k=k)
    passages = [fresh(k) for k in (34, 35, 36, 50, 120)]
    texts = []
    for i in range(60):
        body = fresh(rng.choice([10, 34, 40, 150, 400]))
        for p in rng.sample(passages, rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(body))
            body = body[:at] + p + body[at:]
        texts.append(body)
    texts += [list(texts[0]), list(texts[3]), texts[5][:-1] + ["end"], ["start"] + texts[7]]
    texts += [["same"] * 90, ["a", "b"] * 60, fresh(40) * 3, passages[4][10:60] + fresh(5) + passages[4][30:90]]
    rows = [(i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, " \r\n"), (1003, "été \x85 naïve " + " ".join(passages[3]))]


@pytest.mark.parametrize("most", [512, 2])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MAX_PIECES", most)
    monkeypatch.setattr(S, "SHARD_WORDS", 300)
    rows = corpus() + [(None, "z" + " z" * 40), (0, corpus()[0][1]), (77, "q w"), (77, "q w e")]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, n_words string, id long").repartition(4)
    found = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in S.remove_repeated_windows(docs).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, 35), key=str)


def test_empty_table(spark):
    assert S.remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_hold_every_window_once():
    rng = np.random.default_rng(1)
    for size in (34, 35, 36, 400, 3000):
        words = S.mix(rng.integers(0, 50, size).astype(np.uint64))
        anchor, first, count, _ = S.pieces(words)
        assert count.sum() == max(0, size - 34) and (first == np.concatenate([[0], np.cumsum(count)])[:-1]).all()


def test_automaton_counts():
    rng = random.Random(2)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    weights = [rng.randrange(1, 4) for _ in sequences]
    automaton = S.SuffixAutomaton(sequences, weights)
    count = Counter()
    for s, w in zip(sequences, weights):
        for i in range(len(s) - 3):
            count[tuple(s[i: i + 4])] += w
    other = [rng.randrange(4) for _ in range(200)]
    for s in [*sequences, other]:
        assert list(automaton.occurrences(s, 4)) == [count[tuple(s[i: i + 4])] for i in range(len(s) - 3)]


def test_words_in_thue_morse_order_differ(spark):
    """Two words that a hash linear in the bytes can't tell apart: the windows around them are different."""
    order = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = "".join("ab"[b] for b in order), "".join("ba"[b] for b in order)
    rest = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest]))]
    found = S.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in found) == [(1, 35, 0, rows[0][1]), (2, 35, 0, rows[1][1])]


def test_a_very_long_text(spark):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    words = [f"u{rng.randrange(10**9)}" for _ in range(200_000)]
    words[150_000:150_000] = passage
    rows = [(1, " ".join(words)), (2, " ".join(["x", *passage, "y"])), (3, "z" * 300_000)]
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 200_060, 60), (2, 62, 60), (3, 1, 0)]
