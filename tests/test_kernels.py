import dataclasses

import numpy as np
import pytest

from quillspark.kernels import filters as fx
from quillspark.functions.scoring import glyph_passes
from quillspark.kernels import fusion
from quillspark.kernels import glyphs as gl


def glyph_image(size=96, seed=0):
    rng = np.random.default_rng(seed)
    image = np.clip(190 + rng.normal(0, 6, (size, size, 3)), 0, 255)
    image[20:76, 44:53] = 40
    image[44:52, 22:74] = 45
    return image.astype(np.uint8)


def test_measures_of_known_images():
    flat = np.full((16, 16), 77, np.uint8)
    assert gl.entropy(flat) == 0 and gl.psnr(flat, flat) == 99 and gl.ssim(flat, flat) == pytest.approx(1) and fx.laplacian(flat).var() == 0
    assert gl.entropy(np.repeat(np.arange(4, dtype=np.uint8), 64).reshape(16, 16)) == pytest.approx(2)
    assert gl.psnr(flat, flat + 5) == pytest.approx(20 * np.log10(255 / 5))
    ramp = np.tile(np.arange(0, 160, 10, dtype=np.uint8), (16, 1))
    assert fx.laplacian(ramp)[:, 1:-1].max() == 0


def test_components_against_flood_fill():
    rng = np.random.default_rng(3)
    for density in (0.2, 0.5, 0.8):
        mask = rng.random((23, 31)) < density
        labels, count = fx.components(mask)
        seen = np.zeros(mask.shape, int)
        n = 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            seen[y, x] = n
            while todo:
                a, b = todo.pop()
                for c, d in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= c < 23 and 0 <= d < 31 and mask[c, d] and not seen[c, d]:
                        seen[c, d] = n
                        todo.append((c, d))
        assert count == n and (labels == seen).all()
        stats = fx.part_stats(labels, count)
        for k in range(count):
            ys, xs = np.nonzero(labels == k + 1)
            assert stats[k].tolist() == [xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs)]


def test_filters_keep_constants_and_sums():
    flat = np.full((9, 7, 3), 120, np.uint8)
    for out in (fx.blur(flat, 5), fx.blur(flat, sigma=2.0), fx.median3(flat), fx.smoothed(flat), fx.resize(flat, 20, 13, "cubic"), fx.resize(flat, 3, 4, "area"), fx.warp(flat, np.array([[1.0, 0, 2], [0, 1, 1]]), True)):
        assert (out == 120).all()
    x = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (fx.resize(x.astype(np.float64), 4, 4, "area") == x.reshape(4, 2, 4, 2).mean((1, 3))).all()
    assert (fx.resize(x, 8, 8, "cubic") == x).all() and (fx.resize(x, 16, 16, "nearest")[::2, ::2] == x).all()
    assert fx.canny(flat[..., 0], 50, 150).max() == 0
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 200
    edges = fx.canny(step, 50, 150)
    assert (edges[5:15].sum(1) == 255).all()
    assert fx.erode(fx.dilate(step, 3), 3).tolist() == step.tolist()
    assert fx.otsu(step) < 200


def test_colour_round_trip():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (12, 12, 3)).astype(np.uint8)
    assert np.abs(fx.from_hsv(fx.to_hsv(image)).astype(int) - image).max() <= 1


def test_fill_recovers_smooth_ground():
    ys, xs = np.mgrid[:40, :40]
    image = np.clip(100 + ys + 0.5 * xs, 0, 255).astype(np.uint8)
    mask = np.zeros((40, 40), np.uint8)
    mask[15:25, 12:28] = 255
    assert np.abs(fx.filled(image, mask).astype(int) - image).max() <= 4
    assert (fx.filled(np.full((9, 9), 7, np.uint8), np.eye(9) * 255) == 7).all()


def test_glyph_mask_finds_strokes_and_drops_cracks():
    image = glyph_image()
    alpha = gl.glyph_mask(image, gl.inset_box(96, 96))
    truth = np.zeros((96, 96), bool)
    truth[20:76, 44:53] = truth[44:52, 22:74] = True
    on = alpha > 8
    assert on[truth].mean() > 0.95 and on[~truth].mean() < 0.05 and on.sum() >= 100
    m = gl.measures(image)
    assert m["component_count"] >= 1 and 0.03 < m["alpha_ratio"] < 0.2 and m["darkness_mean"] > 0.5
    blank = gl.mask_measures(np.full((40, 40, 3), 200, np.uint8))
    assert blank["bbox_fill_ratio"] in (1.0,) and blank["alpha_ratio"] in (0.0, pytest.approx(blank["alpha_ratio"]))


def test_comparison_with_itself_and_with_another_size():
    image = glyph_image()
    same = gl.comparison(image, image)
    assert same["psnr"] == 99 and same["ssim"] == pytest.approx(1) and same["foreground_psnr"] == 99 and same["entropy_delta"] == 0
    other = gl.comparison(image, fx.resize(image, 192, 192, "cubic"))
    assert 20 < other["psnr"] < 99 and other["ssim"] > 0.6


def test_crops_and_masks():
    image = np.full((50, 60, 3), 255, np.uint8)
    image[10:30, 20:45] = 90
    assert gl.white_crop(image) == (20, 10, 45, 30) and gl.white_crop(image, 5) == (15, 5, 50, 35)
    assert gl.white_crop(np.full((5, 6), 255, np.uint8)) == (0, 0, 6, 5)
    x1, y1, x2, y2 = gl.edge_crop(image)
    assert abs(x1 - 20) <= 3 and abs(y1 - 10) <= 3 and abs(x2 - 45) <= 3 and abs(y2 - 30) <= 3
    assert gl.edge_crop(np.full((20, 20), 255, np.uint8)) == (0, 0, 20, 20)
    mask = gl.box_mask(20, 20, [(2, 3, 5, 6), (-9, -9, -2, -2)], 1, 1)
    assert (mask > 0).sum() == 7 * 7 and mask[1:8, 0:7].min() == 255


def test_patches_pass_their_own_gate_and_repeat():
    rng = np.random.default_rng(1)
    page = np.clip(rng.normal(150, 25, (120, 90, 3)), 0, 255).astype(np.uint8)
    mask = gl.box_mask(120, 90, [(0, 0, 40, 40)])
    got = gl.patches(page, 64, 3, np.random.default_rng(7), mask)
    again = gl.patches(page, 64, 3, np.random.default_rng(7), mask)
    assert 0 < len(got) <= 3 and all((a == b).all() for a, b in zip(got, again, strict=True)) and all(p.shape == (64, 64, 3) and gl.usable(p, None) for p in got)
    assert len(gl.patches(page, 128, 2, np.random.default_rng(7), vary=False)) == 2
    assert gl.patches(np.full((80, 80, 3), 255, np.uint8), 64, 2, np.random.default_rng(0)) == []


@pytest.mark.parametrize("mode", sorted(gl.MODES))
def test_enhancement_modes(mode):
    out = gl.enhanced(glyph_image(), mode)
    assert out.shape == (96, 96, 3) and out.dtype == np.uint8
    with pytest.raises(ValueError):
        gl.enhanced(glyph_image(), "none of these")


def test_samples_from_stacks():
    image, rng, recipe = glyph_image(), np.random.default_rng(2), fusion.Recipe(mix=0.5)
    layers = fusion.stack(image, image, recipe)
    assert layers.trust.max() == pytest.approx(1) and layers.around[46, 48].mean() > 150
    pose = fusion.Pose.drawn(rng, recipe)
    assert abs(pose.angle) <= 6 and 0.92 <= pose.scale <= 1.08
    moved = fusion.without_rims(pose.apply(layers), recipe)
    page = np.clip(rng.normal(180, 10, (96, 96, 3)), 0, 255).astype(np.uint8)
    ground = fusion.grounded(gl.cover(page, 96, 96), moved, recipe)
    out = fusion.inked(ground, moved, rng, recipe)
    on = moved.alpha > 200
    assert out.shape == page.shape and out[on].mean() < ground[on].mean() - 20 and np.abs(out[moved.alpha == 0].astype(int) - ground[moved.alpha == 0]).mean() < 3
    assert fusion.usable(moved, glyph_passes) and not fusion.usable(dataclasses.replace(moved, alpha=np.zeros_like(moved.alpha)), glyph_passes)
    assert gl.cover(page, 30, 60).shape == (60, 30, 3) and len(gl.feature_vector(image, 16)) == 256


def test_poses_keep_the_middle():
    for angle, scale, shift in ((0, 1, (0, 0)), (30, 0.5, (0, 0)), (-6, 1.08, (0.1, -0.2))):
        m = fusion.Pose(angle, scale, shift).matrix(40, 20)
        assert m @ [20, 10, 1] == pytest.approx([20 + 40 * shift[0], 10 + 20 * shift[1]])
        assert np.linalg.det(m[:, :2]) == pytest.approx(scale**2)
    still = fusion.Pose(0, 1, (0, 0)).apply(layers := fusion.stack(glyph_image(), glyph_image()))
    assert (still.alpha == layers.alpha).all() and np.allclose(still.darkness, layers.darkness)


def test_tones_and_blends():
    rng, recipe = np.random.default_rng(5), fusion.Recipe()
    a, b = (np.clip(rng.normal(m, s, (30, 30, 3)), 0, 255).astype(np.uint8) for m, s in ((90, 12), (170, 14)))
    where = np.ones((30, 30), bool)
    tone = fusion.Tone.between(a, b, where, recipe)
    # Three quarters of the way, less what the gain takes from the rest.
    assert tone.apply(a).mean() == pytest.approx(b.mean() - 0.25 * tone.gain * (b.mean() - a.mean()), abs=1) and 0.75 <= tone.gain <= 1.35
    assert fusion.Tone.between(b, np.full_like(b, 100), where, recipe).gain == 0.75
    assert (fusion.blend(a, b, np.zeros((30, 30))) == a).all() and (fusion.blend(a, b, np.ones((30, 30))) == b).all()
    blank = fusion.Stack(np.zeros((30, 30)), np.zeros((30, 30), np.uint8), a, np.zeros((30, 30), np.float32))
    assert fusion.grounded(b, blank, recipe) is b and (fusion.without_rims(blank, fusion.Recipe(rim=0)).alpha == 0).all()
    white = np.full((30, 30, 3), 255, np.uint8)
    assert fusion.stack(white, white).trust.max() == 0
