import struct
import zlib

import numpy as np
import pytest

from twinraster.operators import runs as R
from twinraster.sources import masks as M


def write_png(path, pixels):
    """A PNG of an (h, w) or (h, w, 3) array of bytes."""
    grey = pixels.ndim == 2
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def truth(tmp_path_factory):
    """A manifest of ten pairs with 256x256 masks, some of them missing, broken, of another size or with other values."""
    root = tmp_path_factory.mktemp("truth")
    rng = np.random.default_rng(3)
    lines, masks = ["id,pre,post,new_building,tree_removal"], {}
    for k in range(10):
        cells = []
        for c in M.CLASSES:
            mask = rng.random((256, 256)) < rng.choice([0.02, 0.5])
            masks[f"p{k}", c] = mask
            path = root / f"p{k}_{c}.png"
            values = mask * (255 if k % 2 else 1)
            write_png(path, np.repeat(values[:, :, None], 3, 2) if k == 4 else values)
            cells.append(path.name)
        if k == 5:
            cells[0] = "absent"
            masks["p5", "new_building"] = np.zeros((256, 256), bool)
        if k == 6:
            cells[1] = "nowhere.png"
        if k == 7:
            (root / cells[0]).write_bytes(b"no image at all")
        if k == 8:
            write_png(root / cells[0], np.zeros((255, 256)))
        if k == 9:
            write_png(root / cells[1], np.full((256, 256), 7))
        lines.append(f"p{k},a.png,b.png,{cells[0]},{cells[1]}")
    (root / "manifest.csv").write_text("\n".join(lines) + "\n")
    return root, masks


def test_masks_become_runs_and_bad_files_rows(spark, truth):
    root, masks = truth
    runs, population, issues = M.read_truth_runs(spark, str(root / "manifest.csv"), str(root), height=256, width=256)
    assert population.count() == 20
    bad = {(r.pair_id, r.class_name): r.reason for r in issues.collect()}
    assert bad == {("p6", "tree_removal"): "missing file", ("p7", "new_building"): "unreadable image", ("p8", "new_building"): "expected 256x256", ("p9", "tree_removal"): M.ILLEGAL}
    rows = runs.toPandas()
    for key, mask in masks.items():
        found = np.zeros((256, 256), bool)
        mine = rows[(rows.pair_id == key[0]) & (rows.class_name == key[1])]
        for y, x0, x1 in zip(mine.y, mine.x0, mine.x1):
            assert not found[y, max(0, x0 - 1):x1 + 1].any()  # runs are maximal
            found[y, x0:x1] = True
        assert (found == (np.zeros_like(mask) if key in bad else mask)).all()


def test_polygon_tables_become_runs(spark, tmp_path):
    (tmp_path / "truth.csv").write_text('id,new_building,tree_removal\nq1,"[[[1,1],[9,1],[9,9],[1,9]]]",\nq2,,"[[[0,0],[3,0],[3,2],[0,2]]]"\n')
    runs, population, issues = M.read_truth_runs(spark, str(tmp_path / "truth.csv"))
    areas = {(r.pair_id, r.class_name): r.area for r in R.area(runs).collect()}
    assert areas == {("q1", "new_building"): 64, ("q2", "tree_removal"): 6}
    assert population.count() == 4 and issues.count() == 0


def test_a_manifest_needs_its_folder(spark, truth):
    with pytest.raises(Exception, match="folder"):
        M.read_truth_runs(spark, str(truth[0] / "manifest.csv"))
