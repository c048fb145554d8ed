import numpy as np
import pytest

from twinraster.llm import whitening
from twinraster.llm.whitening_query import whitened


def _symmetric(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    [3.0], [2.0, 1.0], [1.0, 1.0, 1.0], [5, 4, 3, 2, 1, 0], [1e6, 1, 1e-3, 1e-6], [7.0] * 5 + [1.0] * 4, [0.0] * 6, [4, 4 - 1e-9, 1], list(range(64, 0, -1)), [100] + [1 + k * 1e-4 for k in range(30)],
    [1, 1, 1, 1e-14], [2, 2, 0, 0], list(np.geomspace(1, 1e-12, 40)), [5, -3, 2, -1],
])
def test_eigen_by_splitting_equals_a_dense_solver(values):
    values = np.array(sorted(values, reverse=True), dtype=float)
    a = _symmetric(values)
    found, vectors = whitening.eigen(a)
    scale = max(1e-300, np.abs(values).max())
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13 * len(values)
    assert np.abs(a @ vectors - vectors * found).max() <= 2e-13 * scale * len(values)


@pytest.mark.parametrize("seed", range(10))
def test_eigenvectors_of_random_covariances(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, rng.integers(2, 65)))
    a = np.cov(x.T, bias=True)
    found, vectors = whitening.eigen(a)
    values, dense = np.linalg.eigh(a)
    np.testing.assert_allclose(found, values[::-1], rtol=1e-12)
    assert np.abs(np.abs(np.einsum("ij,ij->j", vectors, dense[:, ::-1])) - 1).max() < 1e-10


@pytest.mark.parametrize("seed", range(5))
def test_polar_factor(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(12, 12)) @ np.diag(np.geomspace(1, 1e-10, 12))
    u = whitening.polar_factor(a)
    assert np.abs(u @ u.T - np.eye(12)).max() < 1e-13
    h = u.T @ a
    assert np.abs(h - h.T).max() < 1e-13 * np.linalg.norm(a) * 12 and np.linalg.eigvalsh((h + h.T) / 2).min() > -1e-13 * np.linalg.norm(a)


def brute_force(rows):
    """{(row number, component): (n, deviation, |whitened|, explained)} with a dense solver and whole numbers."""
    kept = [(k, v) for k, (_, v) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: tuple(int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v) for k, v in kept}
    points = sorted(set(x.values()))
    n, sums = len(points), [sum(p[d] for p in points) for d in range(len(points[0]))]
    centred = np.array([[(n * c - s) / n for c, s in zip(p, sums)] for p in points])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for k, p in x.items():
        for c in range(min(16, len(sums))):
            e, v = values[-1 - c], vectors[:, -1 - c]
            w = float(np.array([(n * a - s) / n for a, s in zip(p, sums)]) @ v / np.sqrt(e))
            out[k, c + 1] = n, sum((n * a - s) ** 2 for a, s in zip(p, sums)), w, e / np.trace(cov)
    return out


@pytest.mark.parametrize("size", [3, 24])
def test_query_equals_a_dense_solver(spark, size):
    rng = np.random.default_rng(size)
    base = (rng.normal(size=(200, size)) * np.linspace(1, 3, size)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(k, base[7]) for k in range(300, 360)]
    bad = [(900, None), (901, [None] * size), (902, [float("nan")] * size), (903, [float("inf")] + base[0][1:]), (904, [float("-inf")] + base[0][1:])]
    found = whitened(spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<float>, x string").repartition(7)).collect()
    want = brute_force(rows)
    ids = [r[0] for r in rows]
    assert len(found) == len(want)
    signs = {}
    for r in found:
        n, deviation, w, explained = want[ids.index(r.vec_id), r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9
        sign = signs.setdefault(r.component, 1 if r.whitened * w >= 0 or abs(w) < 1e-9 else -1) if abs(w) > 1e-6 else signs.get(r.component)
        assert sign is None or abs(sign * r.whitened - w) < 1e-8


def test_one_vector_empty_tables_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    found = whitened(spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found) == [
        (0, 1, 1, 0, None, None, None), (0, 2, 1, 0, None, None, None), (1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    assert whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_vectors_of_different_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="length"):
        whitened(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>"))


def test_fewer_directions_than_dimensions(spark):
    """Vectors on a line: one component has variance, the others no whitened value."""
    rows = [(k, [k / 4, k / 2, 0.0]) for k in range(20)]
    found = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 60
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert all(r.identity_error < 1e-12 for r in found)
    assert abs(sum(r.explained for r in found if r.vec_id == 0) - 1) < 1e-12
