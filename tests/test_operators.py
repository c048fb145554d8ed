"""Graph, ordering, matching, models, sources and guards."""
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinraster.operators import evidence as E
from twinraster.operators import folds, graph, matching, models, ordering, splits
from twinraster.operators import maps as M
from twinraster.operators import sweep as W
from twinraster.sources import arrays, tables


def test_connected_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(chain + star + [(300, 300)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 60))
    assert 300 not in got


def test_boxes_touch_and_buffer(spark):
    rows = [("a", 500000.0, 0.0, 500010.0, 10.0), ("b", 500010.0, 0.0, 500020.0, 10.0), ("c", 500022.0, 0.0, 500032.0, 10.0), ("d", 500022.0, 0.0, 500032.0, 10.0)]
    boxes = spark.createDataFrame(rows, "id string, w double, s double, e double, n double")
    pairs = lambda b: {(r.src, r.dst) for r in graph.box_adjacency(boxes, b).collect()}
    assert pairs(0.0) == {("a", "b"), ("c", "d")}
    assert pairs(3.0) == {("a", "b"), ("b", "c"), ("c", "d")}


def test_global_index_previous_and_quantiles(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("hot"), F.md5(F.col("id").cast("string")).alias("k"))
    ranked = ordering.global_index(df.repartition(7), F.col("k")).orderBy("position").collect()
    assert [r.position for r in ranked] == list(range(1000)) and [r.k for r in ranked] == sorted(r.k for r in ranked)
    prev = {r.id: r.p for r in ordering.previous_in_group(df, ["hot"], F.col("id"), "id", "p").collect()}
    assert prev[3] == 0 and prev[4] == 2 and prev[0] is None and prev[1] is None
    total = {r.id: r.before for r in ordering.prefix_sum(df.withColumn("n", F.lit(2)), "n", F.col("id")).collect()}
    assert all(total[i] == 2 * i for i in range(1000))
    q = {r.share: r.quantile for r in ordering.exact_quantiles(df, "id", [0.1, 0.5, 0.99]).collect()}
    assert [q[s] for s in (0.1, 0.5, 0.99)] == pytest.approx(np.quantile(np.arange(1000), [0.1, 0.5, 0.99]))


@pytest.mark.parametrize("mode,delta", [("max", 0.0), ("max", 0.3), ("min", 0.3)])
def test_best_so_far(spark, mode, delta):
    rng = np.random.default_rng(1)
    logs = {r: rng.normal(size=n).round(3).tolist() for r, n in (("a", 1), ("b", 60), ("c", 200))}
    logs["d"] = [i * 0.1 for i in range(50)]
    df = spark.createDataFrame([(r, i, v) for r, vs in logs.items() for i, v in enumerate(vs)], "run string, step int, value double")
    got = {(r.run, r.step): (r.improved, round(r.best, 6), r.bad, r.stop) for r in folds.best_so_far(df, mode, delta, 4).collect()}
    for run, values in logs.items():
        best, bad = None, 0
        for i, v in enumerate(values):
            better = best is None or (v > best + delta if mode == "max" else v < best - delta)
            best, bad = (v, 0) if better else (best, bad + 1)
            assert got[run, i] == (better, round(best, 6), bad, bad >= 4), (run, i)


def test_greedy_matching_equals_walk(spark):
    rng = np.random.default_rng(3)
    edges = [(1, int(i), int(j), float(iou), float(d)) for i, j, iou, d in zip(rng.integers(0, 12, 80), rng.integers(0, 12, 80), rng.integers(0, 4, 80) / 4, rng.integers(0, 3, 80))]
    edges = list({(e[1], e[2]): e for e in edges}.values())
    want, ui, uj = set(), set(), set()
    for _, i, j, iou, d in sorted(edges, key=lambda e: (-e[3], e[4], e[1], e[2])):
        if i not in ui and j not in uj:
            want.add((i, j))
            ui.add(i)
            uj.add(j)
    df = spark.createDataFrame(edges, "pair_id long, i long, j long, iou double, drift double")
    assert {(r.i, r.j) for r in matching.greedy_match(df, ["pair_id"]).collect()} == want


def test_logistic_matches_dense_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.4).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    got = models.fit_logistic(models.design(df, ["a", "b", "c"], "y"), 3, l2=2.0)[0]
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(300)])
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + np.diag([2, 2, 2, 0]) @ beta
        hess = z.T @ ((w * p * (1 - p))[:, None] * z) + np.diag([2, 2, 2, 0])
        beta -= np.linalg.solve(hess, grad)
    assert [*got["weights"], got["bias"]] == pytest.approx(beta, abs=1e-4)


def test_folds_equal_array_split(spark):
    df = spark.createDataFrame([(f"g{i:02d}",) for i in range(13)], "g string")
    sizes = splits.grouped_folds(df, "g", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2]


def test_fraction_split_keeps_groups_whole(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 70, 0).otherwise(F.col("id")).alias("g"))
    s = splits.fraction_split(df, "g", 0.25, 3)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    assert s.count() == 200 and s.select("split").distinct().count() == 2


@pytest.mark.parametrize("dy,dx", [(0, 1), (1, 0), (-2, 1), (2, -2)])
def test_planted_shift_is_found(spark, dy, dx):
    rng = np.random.default_rng(7)
    n = 16
    pre = rng.normal(size=(n, n, 4))
    post = np.roll(pre, (dy, dx), axis=(0, 1))
    planes = spark.createDataFrame([(1, y, x, pre[y, x].tolist(), post[y, x].tolist()) for y in range(n) for x in range(n)], "pair_id long, y int, x int, v_pre array<double>, v_post array<double>")
    lab = spark.createDataFrame([(1, "new_building", 0, y, 6, 10) for y in range(6, 10)], "pair_id long, class_name string, component_id long, y int, x0 int, x1 int")
    shifts = E.shift_table(spark, 3, n, n, n)
    support, chosen = E.usable_support(E.alignment_region(lab, n, n, 2, 1), shifts, n)
    best = E.best_shift(E.shift_residuals(support, chosen, planes, shifts), 2).first()
    assert (best.best_dy, best.best_dx) == (dy, dx) and best.residual_after == pytest.approx(0)


def test_promotion_gate_lists_reasons(spark):
    cols = "trial int, population string, class_name string, num_samples long, no_change_count long, no_change_fp_any long, overall double, tp long, shape_score double, gt_positive_count long"
    row = lambda t, fp, score, tp, shape: [(t, "legacy", c, 10, 5, fp, score, tp, shape, 4) for c in ("new_building", "tree_removal")]
    base = spark.createDataFrame(row(0, 3, 0.5, 2, 0.8), cols)
    out = {r.trial: (r.passed, list(r.reasons)) for r in W.promotion_gate(spark.createDataFrame(row(1, 2, 0.5, 2, 0.8) + row(2, 3, 0.4, 1, 0.7), cols), base, ["trial"]).collect()}
    assert out[1] == (True, []) and not out[2][0] and len(out[2][1]) == 6


def _png(path, array):
    h, w = array.shape[:2]
    colour = 2 if array.ndim == 3 else 0
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + array[y].tobytes() for y in range(h))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_decode_and_mask_values(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    _png(tmp_path / "a.png", rgb)
    px = M.image_pixels(spark.read.format("image").load(str(tmp_path / "a.png")), [])
    assert all((r.r, r.g, r.b) == tuple(rgb[r.y, r.x]) for r in px.collect()) and px.count() == 20
    grey = np.array([[0, 255], [1, 7]], dtype=np.uint8)
    _png(tmp_path / "m.png", grey)
    mask = M.mask_pixels(M.image_pixels(spark.read.format("image").load(str(tmp_path / "m.png")), []), [])
    with pytest.raises(Exception, match="0/1/255"):
        mask.collect()


def test_map_files(spark, tmp_path):
    good = np.full((3, 2, 2), 0.25, np.float32)
    np.save(tmp_path / "t1.npy", good)
    np.savez(tmp_path / "t2.npz", probabilities=good)
    long = arrays.long_maps(arrays.read_map_files(spark, str(tmp_path)))
    assert {r.id for r in long.collect()} == {"t1", "t2"} and long.count() == 24
    np.save(tmp_path / "t3.npy", good * 9)
    with pytest.raises(Exception, match="finite and in"):
        arrays.read_map_files(spark, str(tmp_path)).collect()


def test_manifest_reader(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿id,pre,post,new_building,extra\n a ,p/a.png,/abs/b.png,absent,1\n".encode())
    r = tables.read_manifest(spark, str(path)).first()
    assert (r.id, r.pre, r.post, r.new_building) == ("a", f"{tmp_path}/p/a.png", "/abs/b.png", "absent")
    path.write_text("id,pre\na,b\n")
    with pytest.raises(tables.ContractError, match="missing"):
        tables.read_manifest(spark, str(path))
    path.write_text("id,pre,post\na,b,c\na,b,c\n")
    with pytest.raises(tables.ContractError, match="duplicate"):
        tables.read_manifest(spark, str(path))


def test_sinks_refuse_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "", ""), ("a", "", "")], "id string, new_building string, tree_removal string")
    with pytest.raises(tables.ContractError, match="duplicate"):
        tables.write_predictions(rows, str(tmp_path / "p"))
    with pytest.raises(tables.ContractError, match="unexpected"):
        tables.write_predictions(rows.withColumn("x", F.lit(1)), str(tmp_path / "p"))
    with pytest.raises(Exception, match="non-finite"):
        tables.write_report_json(spark.range(1).select(F.lit(float("nan")).alias("v")), str(tmp_path / "j"))


def test_torn_journal_is_rejected(spark, tmp_path):
    folder = tmp_path / "j"
    os.makedirs(folder)
    (folder / "a.json").write_text('{"key":"a","v":1}\n{"key":"b","v"')
    schema = spark.createDataFrame([], "key string, v int").schema
    with pytest.raises(Exception):
        tables.read_journal(spark, str(folder), schema).collect()


def test_matching_has_no_round_limit(spark):
    """Overlaps fall along the chain, so every round can take one edge only."""
    edges = [(0, k // 2, (k + 1) // 2, 0.95 - k / 1000, 0.0) for k in range(70)]
    df = spark.createDataFrame(edges, "pair_id long, i long, j long, iou double, drift double")
    used_i, used_j, want = set(), set(), set()
    for _, i, j, _, _ in edges:
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), want.add((i, j))
    assert {(r.i, r.j) for r in matching.greedy_match(df, ["pair_id"]).collect()} == want


def test_reference_size_image_decodes(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (256, 256, 3), dtype=np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 256, 256, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    images = spark.read.format("image").load(str(tmp_path)).withColumn("id", F.lit(1))
    found = M.image_pixels(images, ["id"]).orderBy("y", "x").select("r", "g", "b").toPandas().to_numpy()
    assert (found.reshape(256, 256, 3) == pixels).all()


def test_held_out_images_are_one_namespace(spark):
    schema = "id string, pre string, post string, source_id string"
    train = spark.createDataFrame([("a", "img/1", "img/2", ""), ("b", "img/8", "img/9", "h"), ("c", "img/6", "img/7", None)], schema)
    held = spark.createDataFrame([("h", "img/2", "img/3", None)], schema)
    found = splits.heldout_violations(train, held, {"image": ["pre", "post"], "source": [splits.own_source()]})
    assert {tuple(r) for r in found.collect()} == {("a", "shared image"), ("b", "shared source")}


def test_adjacency_of_one_giant_box(spark):
    """A box of 200 km takes a few cells, and meets the small boxes that it touches."""
    rng = np.random.default_rng(5)
    rows = [(0, 0.0, 0.0, 200_000.0, 200_000.0, "A")]
    for i in range(1, 120):
        w, s = rng.uniform(-30_000, 230_000, 2)
        side = float(rng.choice([10, 300, 9_000]))
        rows.append((i, float(w), float(s), float(w + side), float(s + side), "A" if i % 9 else "B"))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[5] == y[5]:
                dx, dy = max(0, y[1] - x[3], x[1] - y[3]), max(0, y[2] - x[4], x[2] - y[4])
                if dx * dx + dy * dy <= 25:
                    want.add((x[0], y[0]))
    df = spark.createDataFrame(rows, "id int, w double, s double, e double, n double, crs string")
    assert {tuple(r) for r in graph.box_adjacency(df, 5.0).collect()} == want and len(want) > 50
