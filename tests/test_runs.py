"""Run algebra, components and polygons against brute force on small masks."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinraster.operators import evidence as E
from twinraster.operators import polygons as G
from twinraster.operators import rings
from twinraster.operators import runs as R
from twinraster.operators import scoring as S

H, W = 12, 14
rng = np.random.default_rng(5)
MASKS = {
    "empty": np.zeros((H, W), bool), "full": np.ones((H, W), bool),
    "diagonal": np.pad(np.eye(12, dtype=bool), ((0, 0), (0, 2))),
    "line": np.pad(np.ones((1, W), bool), ((3, 8), (0, 0))),
    **{f"random{i}": rng.random((H, W)) < share for i, share in enumerate((0.3, 0.5, 0.7))},
}
donut = np.zeros((H, W), bool)
donut[2:9, 2:9], donut[4:7, 4:7] = True, False
donut[5, 5] = True
MASKS["donut"] = donut
NAMES = list(MASKS)


def frame(spark, masks=MASKS):
    rows = [(i, "new_building", int(y), int(x)) for i, m in enumerate(masks.values()) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "pair_id long, class_name string, y int, x int")


def tiles(spark):
    return spark.createDataFrame([(i, "new_building") for i in range(len(MASKS))], "pair_id long, class_name string")


def back(runs):
    out = {n: np.zeros((H, W), bool) for n in NAMES}
    for r in R.to_pixels(runs).collect():
        out[NAMES[r.pair_id]][r.y, r.x] = True
    return out


def morph(m, r, grow):
    p = np.pad(m, r)
    views = [p[dy:dy + H, dx:dx + W] for dy in range(2 * r + 1) for dx in range(2 * r + 1)]
    return np.any(views, 0) if grow else np.all(views, 0)


def components(m, diagonal=False):
    left, out = set(zip(*(v.tolist() for v in np.nonzero(m)))), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (diagonal or not (dy and dx)) and (y + dy, x + dx) in left:
                        left.discard((y + dy, x + dx))
                        stack.append((y + dy, x + dx))
        out.append(part)
    return out


def filled(m):
    outside = [c for c in components(~m) if any(y in (0, H - 1) or x in (0, W - 1) for y, x in c)]
    open_ = np.zeros_like(m)
    for c in outside:
        for y, x in c:
            open_[y, x] = True
    return ~open_


def same(got, want):
    for n in NAMES:
        assert np.array_equal(got[n], want(MASKS[n])), n


def test_runs_round_trip(spark):
    same(back(R.to_runs(frame(spark))), lambda m: m)


@pytest.mark.parametrize("r", [1, 2])
def test_dilate_erode(spark, r):
    runs = R.to_runs(frame(spark))
    same(back(R.dilate(runs, r, H, W)), lambda m: morph(m, r, True))
    same(back(R.erode(runs, r)), lambda m: morph(m, r, False))


def test_boundary_and_fill(spark):
    runs = R.to_runs(frame(spark))
    same(back(R.boundary(runs)), lambda m: m & ~morph(m, 1, False))
    same(back(R.fill_holes(runs, tiles(spark), H, W)), filled)


def test_pipeline_order(spark):
    def want(m):
        m = morph(morph(m, 1, False), 1, True)
        m = filled(morph(morph(m, 1, True), 1, False))
        out = np.zeros_like(m)
        for c in components(m):
            if len(c) >= 5:
                for y, x in c:
                    out[y, x] = True
        return out
    same(back(R.clean_mask(R.to_runs(frame(spark)), tiles(spark), H, W, opening=1, closing=1, fill=True, min_area=5)), want)


@pytest.mark.parametrize("band", [256, 5, 1])
@pytest.mark.parametrize("steps", [[(False, 1), (True, 1)], [(True, 2), (False, 2)], [(False, 1), (True, 1), (True, 2), (False, 2), (True, 1)], [(True, 3)], []])
def test_fused_morphology_equals_step_by_step(spark, band, steps):
    """Bands of one row, some rows and the whole tile give what the steps give one after the other on the whole image."""
    def want(m):
        for grow, radius in steps:
            m = morph(m, radius, grow)
        return m
    same(back(R.morph(R.to_runs(frame(spark)), H, W, steps, band_rows=band)), want)


@pytest.mark.parametrize("way,height,band", [(4, H, 256), (8, H, 256), (4, None, 3), (8, None, 3)])
def test_components_with_and_without_bands(spark, way, height, band):
    lab = R.label_components(R.to_runs(frame(spark)), W, height, way, band_rows=band)
    got = {(r.pair_id, r.component_id, r.area) for r in R.component_areas(lab).collect()}
    want = {(i, min(y * W + x for y, x in c), len(c)) for i, m in enumerate(MASKS.values()) for c in components(m, way == 8)}
    assert got == want


def test_component_fill_ignores_diagonal_rings_of_other_components(spark):
    plus = np.zeros((H, W), bool)
    plus[1, 2] = plus[2, 1] = plus[2, 3] = plus[3, 2] = True
    runs = R.to_runs(frame(spark, {"plus": plus}))
    lab = R.label_components(runs, W, H)
    assert R.component_holes(lab, W, H).count() == 0
    one = tiles(spark).filter("pair_id = 0")
    assert R.area(R.fill_holes(runs, one, H, W)).first().area == 5


def test_polygons_cover_filled_components(spark):
    lab = R.label_components(R.to_runs(frame(spark)), W, H)
    cells = {r.pair_id: json.loads(r.cell) for r in G.polygon_cells(lab, W, H).collect()}
    for i, m in enumerate(MASKS.values()):
        want = 0
        for c in components(m):
            alone = np.zeros((H + 2, W + 2), bool)
            for y, x in c:
                alone[y + 1, x + 1] = True
            outer = next(p for p in components_any(~alone) if (0, 0) in p)
            want += alone.size - len(outer)
        area = sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2 for r in cells.get(i, []))
        assert area == want


def components_any(m):
    return components(m)


@pytest.mark.parametrize("dy,dx,want", [(0, 1, 1.0), (1, 1, 1.0), (0, 2, 0.9), (2, 2, 0.81), (0, 30, 0.0)])
def test_shape_score_of_shifted_squares(spark, dy, dx, want):
    square = lambda y, x: spark.createDataFrame([(1, "new_building", y + i, x, x + 10) for i in range(10)], "pair_id long, class_name string, y int, x0 int, x1 int")
    pop = spark.createDataFrame([(1, "new_building")], "pair_id long, class_name string")
    row = S.tile_outcomes(square(10 + dy, 10 + dx), square(10, 10), pop).first()
    assert row.shape == pytest.approx(want)


@pytest.mark.parametrize("cells,positive", [(19, False), (20, True)])
def test_prediction_area_cutoff(spark, cells, positive):
    pred = spark.createDataFrame([(1, "new_building", 0, 0, cells)], "pair_id long, class_name string, y int, x0 int, x1 int")
    pop = spark.createDataFrame([(1, "new_building")], "pair_id long, class_name string")
    assert S.tile_outcomes(pred, pred, pop).first().pred_positive is positive


def test_hull_and_rectangle(spark):
    rows = [(1, "new_building", 0, 0, y, 0, 6 - y) for y in range(6)]
    lab = spark.createDataFrame(rows, "pair_id long, class_name string, component_id long, k int, y int, x0 int, x1 int").drop("k")
    r = E.hull_geometry(lab).first()
    assert r.convex_hull_area == pytest.approx(23.5)
    box = spark.createDataFrame([(1, "new_building", 0, y, 2, 7) for y in range(3)], "pair_id long, class_name string, component_id long, y int, x0 int, x1 int")
    b = E.hull_geometry(box).first()
    assert (b.convex_hull_area, b.min_area_rect_width, b.min_area_rect_height, b.solidity, b.rectangularity) == pytest.approx((15, 3, 5, 1, 1))


def _flooded(cells, h, w):
    """Cells of a component and of all background that can't be reached from outside through edges."""
    alone = np.zeros((h + 2, w + 2), bool)
    for y, x in cells:
        alone[y + 1, x + 1] = True
    outer = next(p for p in components(~alone) if (0, 0) in p)
    return {(y - 1, x - 1) for y in range(h + 2) for x in range(w + 2) if (y, x) not in outer}


def _shapes(h, w):
    rng = np.random.default_rng(8)
    found = {k: rng.random((h, w)) < p for k, p in enumerate((0.35, 0.5, 0.62, 0.7, 0.85))}
    donut = np.zeros((h, w), bool)
    donut[1:9, 1:9] = True
    donut[3:7, 3:7] = False
    island = donut.copy()
    island[4:6, 4:6] = True
    pinched = np.zeros((h, w), bool)
    pinched[0:3, 0:3] = True
    pinched[1, 1] = pinched[2, 2] = False
    snake = np.zeros((h, w), bool)
    snake[::2, :] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    return list(found.values()) + [donut, island, pinched, snake, np.ones((h, w), bool), np.zeros((h, w), bool)]


@pytest.mark.parametrize("height,band", [(17, 256), (None, 4), (None, 1)])
def test_exteriors_cover_filled_components(spark, height, band):
    """Rings closed in one band, over many bands, and with a band per row equal a flood from outside."""
    h, w = 17, 12
    masks = _shapes(h, w)
    runs = R.to_runs(frame(spark, dict(enumerate(masks))))
    lab = R.label_components(runs, w, height, band_rows=band)
    edges = rings.exterior_edges(lab, w, height, band_rows=band)
    got = {}
    for r in R.to_pixels(rings.exterior_runs(edges)).collect():
        got.setdefault((r.pair_id, r.component_id), set()).add((r.y, r.x))
    want = {(k, min(y * w + x for y, x in c)): _flooded(c, h, w) for k, m in enumerate(masks) for c in components(m)}
    assert got == want


def test_exported_rings_are_the_boundaries(spark):
    h, w = 17, 12
    masks = _shapes(h, w)
    lab = R.label_components(R.to_runs(frame(spark, dict(enumerate(masks)))), w, h)
    cells = {r.pair_id: json.loads(r.cell) for r in G.polygon_cells(lab, w, h).collect()}
    for k, m in enumerate(masks):
        parts = sorted((_flooded(c, h, w) for c in components(m)), key=min)
        assert len(cells.get(k, [])) == len(parts)
        for part in parts:
            area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2 == len(part) and min((y, x) for x, y in r) == min(part) for r in cells[k])
            assert area >= 1
        for ring in cells[k] if k in cells else []:
            steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])]
            assert all((dx == 0) != (dy == 0) for dx, dy in steps)
            assert all((a[0] == 0) != (b[0] == 0) for a, b in zip(steps, steps[1:] + steps[:1]))
    donut = cells[5]
    assert donut == [[[1, 1], [9, 1], [9, 9], [1, 9]]]
