"""Kernel queries over a whole table, against the kernels applied to one tile after another."""

import zlib

import numpy as np
import pytest

from quillspark.functions.scoring import glyph_passes
from quillspark.kernels import filters as fx
from quillspark.kernels import fusion
from quillspark.kernels import glyphs as gl
from quillspark.plans import kernels, registry
from quillspark.sources import images as im

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiles(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    return {str(r.vec_id): (str(r.label), kernels.tile(np.array(r.embedding))) for r in rows if len(r.embedding) == 64}


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def first(tiles):
    out = {}
    for k, (label, _) in tiles.items():
        out[label] = min(out.get(label, k), k, key=int)
    return out


def test_regions_and_measures(spark, tiles):
    got = {r.path: r for r in rows(spark, "glyph_regions")}
    assert got.keys() == tiles.keys()
    for k, (_, x) in tiles.items():
        alpha = gl.glyph_mask(x, gl.inset_box(*x.shape[1::-1]))
        assert (got[k].area, got[k].alpha_crc32) == (int((alpha > 8).sum()), zlib.crc32(alpha.tobytes()))
    for r in rows(spark, "image_measures"):
        want = gl.measures(tiles[r.path][1])
        assert r.readable and all(r[n] == pytest.approx(want[n], abs=1e-5) for n in kernels.MEASURES)
    for r in rows(spark, "usable_glyphs"):
        want = gl.mask_measures(tiles[r.path][1])
        assert all(r[n] == pytest.approx(want[n]) for n in ("alpha_ratio", "darkness_mean", "component_count"))


def test_comparison_scores_and_vectors(spark, tiles):
    head = first(tiles)
    got = {r.path: r for r in rows(spark, "image_comparison")}
    assert got.keys() == tiles.keys()
    for k, (label, x) in tiles.items():
        want = gl.comparison(x, tiles[head[label]][1])
        assert got[k].reference == head[label] and all((got[k][n] is None) == (v is None) and (v is None or got[k][n] == pytest.approx(v, abs=1e-5)) for n, v in want.items())
    scores = rows(spark, "image_scores")
    assert {r.path for r in scores} == tiles.keys() and all(0 <= r.quality_score <= 1 and r.quality_ok == (r.quality_score >= 0.36 and not r.reasons) for r in scores)
    for r in rows(spark, "image_vectors"):
        np.testing.assert_allclose(r.v, gl.feature_vector(tiles[r.path][1], 8), atol=1e-6)


def test_enhancement_and_backgrounds(spark, tiles):
    got = rows(spark, "enhanced_images")
    assert len(got) == len(tiles) * len(gl.MODES)
    assert all(r.mean_gray == pytest.approx(float(fx.gray(gl.enhanced(tiles[r.path][1], r.mode)).mean()), abs=1e-5) for r in got)
    made = rows(spark, "page_patches")
    assert 0 < len(made) <= 2 * len(tiles) and {r.patch_no for r in made} <= {0, 1}
    for r in made:
        x = tiles[r.path][1]
        x1, y1, x2, y2 = gl.white_crop(x, 0)
        mask = gl.box_mask(y2 - y1, x2 - x1, [(32 - x1, 32 - y1, min(40, x2) - x1, min(40, y2) - y1)], 4, 3)
        patches = gl.patches(gl.fx.filled(x[y1:y2, x1:x2], mask), 12, 2, im.seeded(42, r.path), mask)
        assert r.crop_box == f"{x1},{y1},{x2},{y2}" and r.crc32 == zlib.crc32(patches[r.patch_no].tobytes())
    for r in rows(spark, "glyph_backgrounds"):
        assert r.mask_ratio <= 0.65 and r.white_ratio <= 0.85 and r.gray_std >= 2


def test_samples(spark, tiles):
    head, got, recipe = first(tiles), {r.path: r for r in rows(spark, "generated_samples")}, fusion.Recipe()
    for k, (label, x) in tiles.items():
        rng, layers = im.seeded(42, k, head[label]), fusion.stack(x, x, recipe)
        for _ in range(20):
            moved = fusion.without_rims((pose := fusion.Pose.drawn(rng, recipe)).apply(layers), recipe)
            if fusion.usable(moved, glyph_passes):
                h, w = x.shape[:2]
                out = fusion.inked(fusion.grounded(gl.cover(tiles[head[label]][1], w, h), moved, recipe), moved, rng, recipe)
                assert got[k].data_crc32 == zlib.crc32(out.tobytes()) and got[k].angle == round(pose.angle, 6)
                break
        else:
            assert k not in got


def samples_by_hand(pages, seed=42):
    """path and crc32 of the sample of each page on itself, without any shortcut."""
    recipe = fusion.Recipe()
    for k, x in pages.items():
        rng, layers = im.seeded(seed, k), fusion.stack(x, x, recipe)
        for _ in range(20):
            moved = fusion.without_rims(fusion.Pose.drawn(rng, recipe).apply(layers), recipe)
            if fusion.usable(moved, glyph_passes):
                yield k, zlib.crc32(fusion.inked(fusion.grounded(gl.cover(x, *x.shape[1::-1]), moved, recipe), moved, rng, recipe).tobytes())
                break


def test_rows_without_hope_go_before_their_grounds_and_no_others(spark, tiles):
    pages, rng = {k: x for k, (_, x) in list(tiles.items())[:4]}, np.random.default_rng(1)
    for side in (10, 20, 28, 30, 31, 32, 33, 34, 36):  # ink from little to too much, around the limit
        x = np.full((48, 48, 3), 200, np.uint8) + rng.integers(0, 9, (48, 48, 1), np.uint8)
        x[5 : 5 + side, 6 : 6 + side] = 30
        x[5 : 5 + side : 7, 6 : 6 + side] = 200
        pages[f"square{side}"] = x
    pages["wide"] = np.full((40, 64, 3), 220, np.uint8)
    pages["wide"][10:30:3, 8:50] = 20
    rows = spark.createDataFrame([(k, *x.shape, bytearray(x.tobytes())) for k, x in pages.items()], "path string, height int, width int, channels int, data binary")
    left = {r.path for r in im.posable(rows, keep=["path"]).collect()}
    want = dict(samples_by_hand(pages))
    assert want and want.keys() <= left and not left & tiles.keys()
    both = rows.selectExpr("*", *(f"{c} as bg_{c}" for c in ("height", "width", "channels", "data")))
    assert {r.path: zlib.crc32(bytes(r.data)) for r in im.generated(both, keep=["path"]).collect()} == want


def test_sure_ink_is_ink(tiles):
    for _, x in list(tiles.values())[:40]:
        sure = fusion.sure_ink(fx.gray(x)[None])[0]
        assert sure.any() and (gl.glyph_mask(x, gl.inset_box(*x.shape[1::-1]))[sure] == 255).all()
