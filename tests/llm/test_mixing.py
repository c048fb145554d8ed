import hashlib

import numpy as np
import pytest

from twinraster.llm import mixing as M

TARGETS = {"source": {"a": 0.5, "*": 0.5}, "lang": {"en": 0.3, "de": 0.7}, "topic": {"note": 0.4, "article": 0.6, "book": 0.1}}


def test_raked_margins_meet_the_targets():
    counts = np.random.default_rng(2).integers(1, 1000, (3, 4, 5)).astype(float)
    targets = [np.array([.2, .3, .5]), np.array([.1, .2, .3, .4]), np.full(5, .2)]
    weights = M.rake(counts, targets)
    for axis, target in enumerate(targets):
        assert np.allclose(weights.sum(axis=tuple(a for a in range(3) if a != axis)), target, atol=1e-9)


def test_values_without_tokens_give_their_share_away():
    weights = M.rake(np.array([[4.0, 0.0], [6.0, 0.0]]), [np.array([.5, .5]), np.array([.25, .75])])
    assert np.allclose(weights, [[.5, 0], [.5, 0]])
    assert not M.rake(np.zeros((2, 2)), [np.array([.5, .5])] * 2).any()


def plain(rows):
    """Cells, raking and draw with loops over dictionaries."""
    cells, of = {}, {}
    for i, (doc, text, source, lang) in enumerate(rows):
        n = len((text or "").split())
        form = "note" if n < 100 else "article" if n < 400 else "essay" if n < 2000 else "book"
        of[i] = (source if source == "a" else "*", lang if lang in ("en", "de") else "*", form if form in TARGETS["topic"] else "*")
        cells[of[i]] = cells.get(of[i], 0) + n
    weight = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(M.SWEEPS):
        for axis, target in enumerate(TARGETS.values()):
            now = {}
            for c, w in weight.items():
                now[c[axis]] = now.get(c[axis], 0) + w
            present = sum(target.get(v, 0) for v, w in now.items() if w > 0)
            weight = {c: w * target.get(c[axis], 0) / present / now[c[axis]] if now[c[axis]] > 0 else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / n for c, n in cells.items() if n}
    top = max(ratio.values())
    found = []
    for i, (doc, *_rest) in enumerate(rows):
        p = round(ratio[of[i]] / top, 9) if of[i] in ratio else 1.0
        u = int(hashlib.md5(f"11|{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52
        found.append((doc, len((rows[i][1] or "").split()), p, u < p))
    return found


def test_query_equals_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "x " * int(rng.choice([5, 120, 90, 300, 2500])), rng.choice(["a", "b", "c"]).item(), rng.choice(["en", "de", "fr"]).item()) for i in range(300)]
    rows += [(None, None, None, None), (7, "", "a", "en"), (7, "", "a", "en"), (901, "w\x0bw\r\n w", None, "de"), (902, "y " * 200_000, "a", "de")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, tokens string")
    got = M.mix_sources(docs, TARGETS).select("doc_id", "tokens", "keep_probability", "sampled").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = plain(rows)
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert g[:2] == e[:2] and g[2] == pytest.approx(e[2], abs=1e-8) and g[3] == e[3]
    assert any(e[3] for e in expected) and not all(e[3] for e in expected)


def test_empty_table_and_bound(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert M.mix_sources(empty, TARGETS).collect() == []
    with pytest.raises(ValueError):
        M.mix_sources(empty, {"source": {str(i): 1.0 for i in range(300)}, "lang": {str(i): 1.0 for i in range(300)}})


def plain_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_null_and_unnamed_languages_survive_the_default_mix(spark):
    """A third of the rows has a language that nothing names, or none."""
    rows = [(i, "w " * 150, "src1", ("en", "de", "fr", "es", None, "zz")[i % 6]) for i in range(600)]
    found = M.mix_sources(plain_docs(spark, rows)).collect()
    kept = [sum(r.sampled for r in found if r.lang == lang) for lang in ("en", "de", "fr", "es", None, "zz")]
    assert min(kept) == 100


@pytest.mark.parametrize("scarce", [1, 10])
def test_a_scarce_value_does_not_thin_the_corpus(spark, scarce):
    """One row or 1 in 100 of source src0, all books, among articles of the other sources."""
    rows = [(i, "w " * (2500 if i < scarce else 150), "src0" if i < scarce else "src1", "en") for i in range(1000)]
    rows.append((2000, "w " * 150, "src0", "en"))
    found = M.mix_sources(plain_docs(spark, rows)).collect()
    assert sum(r.sampled for r in found) > 0.7 * len(rows)
    assert all(r.keep_probability > 0.7 for r in found)


def test_values_that_go_together_take_no_cell_away(spark):
    """src0 holds books only, so raising src0 by more than books asks for books of src0 alone: other books stay all the same."""
    rows = [(i, "w " * 2500, "src0", "en") for i in range(40)]
    rows += [(100 + i, "w " * 2500, "src1", "en") for i in range(40)]
    rows += [(200 + i, "w " * 500, "src1", "en") for i in range(400)]
    found = M.mix_sources(plain_docs(spark, rows)).collect()
    assert min(r.keep_probability for r in found) > 0.7
    rare = [r for r in found if 100 <= r.doc_id < 200]
    assert sum(r.sampled for r in rare) > 0.5 * len(rare)


def test_raised_cells_repeat_and_the_mix_is_as_large_as_the_corpus(spark):
    rows = [(i, "w " * 150, "src0" if i % 20 == 0 else "src1", "en") for i in range(4000)]
    found = M.mix_sources(plain_docs(spark, rows)).collect()
    assert all(r.sampled == (r.copies > 0) for r in found)
    mixed, raised = sum(r.copies for r in found), sum(r.copies for r in found if r.source == "src0")
    assert mixed == pytest.approx(4000, rel=0.02) and sum(r.sampled for r in found) > 0.97 * len(rows)
    assert raised / mixed == pytest.approx(1.25 * 200 / (1.25 * 200 + 3800), rel=0.05)
    assert all(r.copies >= 1 for r in found if r.source == "src0")
