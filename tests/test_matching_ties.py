"""Drifts of matching candidates to the last bit: ties between them decide the greedy walk."""
import math
import random

from twinraster.operators import matching as K

KEYS = ["pair_id", "class_name"]


def test_drifts_are_those_of_means_of_cells(spark):
    draw = random.Random(5)
    rows = {"a": [], "b": []}
    for tile in range(60):
        for side in rows.values():
            for place in range(3):  # one blob of a few runs per corner
                top, left = 3 * (place // 2), 4 * (place % 2)
                side += [(tile, "new_building", top * 8 + left, top + dy, left, left + draw.randint(1, 3)) for dy in range(draw.randint(1, 3))]
    a, b = (spark.createDataFrame(r, "pair_id long, class_name string, component_id long, y int, x0 int, x1 int") for r in rows.values())

    def centre(side, tile, component):
        cells = [(y, x) for t, _, c, y, x0, x1 in rows[side] if (t, c) == (tile, component) for x in range(x0, x1)]
        return sum(x for _, x in cells) / len(cells), sum(y for y, _ in cells) / len(cells)

    edges = K.match_candidates(a, b, KEYS).collect()
    assert edges
    for e in edges:
        (xi, yi), (xj, yj) = centre("a", e.pair_id, e.i), centre("b", e.pair_id, e.j)
        dx, dy = xi - xj, yi - yj
        assert e.drift == math.sqrt(dx * dx + dy * dy)
