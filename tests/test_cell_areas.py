import json
import random

import pyarrow as pa
import pytest

from twinraster.operators import polygons as G
from twinraster.operators import scoring as Q
from twinraster.sources.tables import ContractError

SCHEMA = "id long, new_building string, tree_removal string"


def star(rng, closed):
    """A ring without crossings, on the pixel grid, half-way or off it."""
    step = rng.choice([1, 0.5, 0.37])
    x, y, w, h = (rng.randrange(-6, 20) * step, rng.randrange(-6, 20) * step, rng.randrange(1, 12) * step, rng.randrange(1, 12) * step)
    ring = [[x, y], [x + w, y], [x + w, y + h], [x + w / 2, y + h * rng.choice([0.5, 1.5])], [x, y + h]]
    return ring + ring[:1] * closed


def tables(seed, n=60):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "[]", None, "nan", *[json.dumps([star(rng, rng.random() < 0.5) for _ in range(k)]) for k in (1, 2, 4)]])
    return [[(i, cell(), cell()) for i in range(n)] for _ in range(2)]


@pytest.mark.parametrize("crossings", [7, 1_000_000])
def test_areas_equal_those_of_runs(spark, monkeypatch, crossings):
    sides = [spark.createDataFrame(rows, SCHEMA) for rows in tables(3)]
    wanted = {(r.pair_id, r.class_name): r[2:] for r in Q.overlap_areas(*map(G.cell_runs, sides)).select("pair_id", "class_name", *Q.AREAS).collect()}
    rows = sorted((r.id, s, r.new_building, r.tree_removal) for s, side in enumerate(sides) for r in
                  side.selectExpr("id", *[f"coalesce({c}, '') AS {c}" for c in Q.CLASSES]).collect())
    table = {"_at": [1 + s for _, s, *_ in rows], "id": [r[0] for r in rows], "side": [r[1] for r in rows]}
    kind = pa.list_(pa.list_(pa.list_(pa.float64())))
    table = pa.table(table)
    for k in range(2):
        empty = [r[2 + k] in ("", "[]", "nan") for r in rows]
        table = table.append_column(f"_empty{k}", pa.array(empty)).append_column(f"_cell{k}", pa.array([None if e else json.loads(r[2 + k]) for r, e in zip(rows, empty)], kind))
    found = Q_rows(G._cell_areas(Q.CLASSES, crossings)(table))
    assert not any(bad for *_, bad in found.values())
    assert {k: v[:-1] for k, v in found.items() if any(v[:-1])} == {k: tuple(v) for k, v in wanted.items() if any(v)} and len(found) == 120


def Q_rows(table):
    return {(r["pair_id"], r["class_name"]): (*[r[c] for c in Q.AREAS], r["bad"]) for r in table.to_pylist()}


def test_scores_equal_those_of_runs(spark):
    pred, truth = (spark.createDataFrame(rows, SCHEMA) for rows in tables(5))
    population = truth.selectExpr("id AS pair_id", "explode(array('new_building', 'tree_removal')) AS class_name")
    wanted = Q.class_scores(Q.confusion(Q.tile_outcomes(G.cell_runs(pred), G.cell_runs(truth), population), ["class_name"]))
    key = lambda r: r["class_name"]
    for a, b in zip(sorted(G.score_cells(pred, truth).collect(), key=key), sorted(wanted.collect(), key=key), strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


SQUARE = "[[[0,0],[9,0],[9,9],[0,9]]]"


@pytest.mark.parametrize(("pred", "truth", "says"), [
    ([(1, SQUARE), (1, "")], [(1, SQUARE)], "prediction ids must be unique"),
    ([(1, SQUARE)], [(1, SQUARE), (1, SQUARE)], "ground truth ids must be unique"),
    ([(1, SQUARE)], [(1, SQUARE), (2, "")], "ids differ"),
    ([(None, "")], [(None, "")], "ids differ"),
    ([(1, "[[[0,0],[9,0")], [(1, "")], "invalid polygon JSON"),
    ([(1, "")], [(1, "[[[0,0],[9,9],[9,0],[0,9]]]")], "self-crossing"),
    ([(1, "[[[0,0],[9,9]]]")], [(1, "")], "fewer than three points"),
    ([(1, "[[[0,0],[9,null],[4,4]]]")], [(1, "")], "finite pairs"),
    ([(1, "[[[0,0],[9,0,1],[4,4]]]")], [(1, "")], "finite pairs"),
    ([(1, "[[[0,0],null,[4,4]]]")], [(1, "")], "finite pairs"),
    ([(1, "[[[0,0],[4,4],[8,8]]]")], [(1, "")], "no area"),
])
def test_a_broken_contract_is_an_error(spark, pred, truth, says):
    sides = [spark.createDataFrame([(i, c, "") for i, c in rows], SCHEMA) for rows in (pred, truth)]
    with pytest.raises(ContractError, match=says):
        G.score_cells(*sides)
