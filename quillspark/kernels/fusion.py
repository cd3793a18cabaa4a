"""Glyph samples as stacks of layers: what is ink, where it is, what surrounds it, and how far that is to be trusted.

A sample is made by three operations only.  ``Pose`` moves all layers of a stack at once; ``Tone`` is one gain and one offset for each channel, by which
a layer is brought near another one's light; ``blend`` lays one image over another by a weight.  Every draw comes from one generator, in one
place, so a sample repeats for its seed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from quillspark.kernels import filters as fx
from quillspark.kernels import glyphs as gl
from quillspark.kernels.glyphs import Image


@dataclass(frozen=True)
class Recipe:
    """Ranges of the pose and the ink, softness of the layers, and bounds of what may be mixed."""

    turn: float = 6.0
    scales: tuple[float, float] = (0.92, 1.08)
    shift: float = 0.04
    white: int = 245
    trust_blur: float = 7
    trusted: float = 0.08
    towards: float = 0.75
    gains: tuple[float, float] = (0.75, 1.35)
    mix: float = 0.35
    mix_blur: float = 5
    mix_most: float = 0.85
    rim: float = 0.5
    rim_blur: float = 9
    ink: tuple[float, float] = (95.0, 165.0)
    tints: tuple[tuple[float, float], ...] = ((-5, 8), (-4, 6), (-2, 5))
    light_blur: float = 9
    light: tuple[float, float] = (0.82, 1.18)
    alpha_power: float = 0.9
    gamma: float = 0.9
    least_pixels: int = 16


@dataclass(frozen=True)
class Stack:
    """Layers of one size: darkness (0 to 1), alpha (0 to 255), surroundings in colour, and their trust (0 to 1)."""

    darkness: Image
    alpha: Image
    around: Image
    trust: Image


@dataclass(frozen=True)
class Pose:
    """A turn in degrees and a scale around the middle, and a shift in shares of the sides."""

    angle: float
    scale: float
    shift: tuple[float, float]

    @classmethod
    def drawn(cls, rng: np.random.Generator, recipe: Recipe) -> Pose:
        return cls(float(rng.uniform(-recipe.turn, recipe.turn)), float(rng.uniform(*recipe.scales)), tuple(rng.uniform(-recipe.shift, recipe.shift, 2)))

    def matrix(self, width: int, height: int) -> np.ndarray:
        """The affine map: it keeps the middle in place but for the shift."""
        turn = self.scale * np.exp(-1j * np.radians(self.angle))
        linear = np.array([[turn.real, -turn.imag], [turn.imag, turn.real]])
        middle = np.array([width / 2, height / 2])
        return np.column_stack([linear, middle - linear @ middle + np.array(self.shift) * [width, height]])

    def apply(self, stack: Stack) -> Stack:
        """Outside of the images there is no ink and no trust; the surroundings are mirrored."""
        m = self.matrix(stack.alpha.shape[1], stack.alpha.shape[0])
        return Stack(fx.warp(stack.darkness, m, False), fx.warp(stack.alpha, m, False), fx.warp(stack.around, m, True), fx.warp(stack.trust, m, False))


@dataclass(frozen=True)
class Tone:
    gain: float
    offset: np.ndarray

    @classmethod
    def between(cls, image: Image, goal: Image, where: Image, recipe: Recipe) -> Tone:
        """What brings ``image`` near ``goal`` where a mask says so: most of the way in mean, in contrast within bounds."""
        deviation = lambda x: max(float(fx.gray(x)[where].std()), 1.0)
        gain = float(np.clip(deviation(goal) / deviation(image), *recipe.gains))
        mine, its = (x[where].mean(0, dtype=np.float64) for x in (image, goal))
        return cls(gain, its - gain * (recipe.towards * mine + (1 - recipe.towards) * its))

    def apply(self, image: Image) -> Image:
        return np.clip(image * self.gain + self.offset, 0, 255).astype(np.uint8)


def blend(below: Image, above: Image, weight: Image) -> Image:
    """``above`` over ``below`` by a weight from 0 to 1 for each pixel."""
    return np.clip(below + (above.astype(np.float64) - below) * weight[..., None], 0, 255).astype(np.uint8)


def _whole(x: Image) -> Image:
    """Scaled so that the greatest is one."""
    return np.clip(x / max(float(x.max()), 1e-6), 0, 1)


def stack(image: Image, source: Image, recipe: Recipe = Recipe()) -> Stack:
    """The layers of a glyph found in ``image`` (enhanced); its surroundings come from ``source``, without ink and white rims."""
    alpha = gl.glyph_mask(image, gl.inset_box(image.shape[1], image.shape[0]))
    hidden = (alpha > 8) | (gl.to_colour(source) >= recipe.white).all(2)
    free = int((~hidden).sum())
    if free < max(recipe.least_pixels, hidden.size // 200):
        around, trust = source.copy(), np.zeros(alpha.shape, np.float32)
    else:
        around = fx.filled(source, np.where(hidden, 255, 0))
        trust = _whole(fx.blur((~hidden).astype(np.float32), sigma=recipe.trust_blur))
    return Stack(gl.ink(image, alpha), alpha, around, trust)


def without_rims(layers: Stack, recipe: Recipe = Recipe()) -> Stack:
    """Alpha fades where there is nothing of the source's own to trust."""
    if recipe.rim <= 0:
        return layers
    support = _whole(fx.blur(layers.trust.astype(np.float32), sigma=recipe.rim_blur))
    keep = np.clip(1 - recipe.rim * (1 - support), 0, 1)
    return replace(layers, alpha=np.clip(layers.alpha * keep, 0, 255).astype(np.uint8))


def grounded(background: Image, layers: Stack, recipe: Recipe = Recipe()) -> Image:
    """The background with some of the glyph's own surroundings in it."""
    h, w = background.shape[:2]
    weight = np.clip(fx.blur(fx.resize(layers.trust, w, h, "area").astype(np.float32), sigma=recipe.mix_blur) * recipe.mix, 0, recipe.mix_most)
    if recipe.mix <= 0 or not weight.any():
        return background
    around, seen = fx.resize(layers.around, w, h, "cubic"), weight > recipe.trusted
    if int(seen.sum()) >= recipe.least_pixels:
        around = Tone.between(around, background, seen, recipe).apply(around)
    return blend(background, around, weight)


def inked(ground: Image, layers: Stack, rng: np.random.Generator, recipe: Recipe = Recipe()) -> Image:
    """Ink on a ground: as much darker as the glyph is dark, more in strong light, slightly tinted."""
    h, w = ground.shape[:2]
    tint = np.array([rng.uniform(*t) for t in recipe.tints])
    strength = rng.uniform(*recipe.ink)
    opacity = np.clip(fx.blur(fx.resize(layers.alpha, w, h, "area").astype(np.float32) / 255, 3), 0, 1) ** recipe.alpha_power
    dark = np.clip(fx.resize(layers.darkness, w, h, "area"), 0, 1) ** recipe.gamma
    light = fx.blur(fx.gray(ground).astype(np.float32), sigma=recipe.light_blur)
    light = np.clip(light / max(float(light.mean()), 1.0), *recipe.light)
    return blend(ground, np.clip(ground + tint - strength * (dark * light)[..., None], 0, 255), opacity)


def usable(layers: Stack, gate) -> bool:
    """Whether the layers still hold a glyph, by ``gate`` on the measures of their ink."""
    return gate(gl.ink_measures(layers.darkness, layers.alpha))


def sure_ink(g: Image, options: gl.MaskOptions = gl.MaskOptions()) -> Image:
    """Of gray images (n, h, w), pixels that are in the glyph's mask for certain: edges and smaller parts can only add to them.

    Each lies in a square of dark pixels, closed and opened as the mask is, that is large enough for its part to be kept whatever else it holds.
    """
    n, h, w = g.shape
    if options.feather > 1 or not options.morph % 2:
        return np.zeros(g.shape, bool)
    p = np.pad(g, ((0, 0), (1, 1), (1, 1)), "edge")
    rows = [np.sort(np.stack([p[:, i : i + h, j : j + w] for j in range(3)]), axis=0) for i in range(3)]
    low, high = (f.reduce([r[k] for r in rows]) for f, k in ((np.maximum, 0), (np.minimum, 2)))
    middle = lambda a, b, c: np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    x1, y1, x2, y2 = gl.inset_box(w, h)
    work = middle(low, middle(*(r[1] for r in rows)), high)[:, y1:y2, x1:x2]
    on = work <= np.array([fx.otsu(x) for x in work])[:, None, None]

    def slid(x: Image, size: int, best, rim: bool) -> Image:
        p = np.pad(x, ((0, 0), *[(size // 2, size // 2)] * 2), constant_values=rim)
        p = best.reduce([p[:, i : i + x.shape[1]] for i in range(size)])
        return best.reduce([p[:, :, i : i + x.shape[2]] for i in range(size)])

    for best, rim in ((np.logical_or, False), (np.logical_and, True), (np.logical_and, True), (np.logical_or, False)):
        on = slid(on, options.morph, best, rim)
    side = int(np.ceil(max(options.min_area**0.5, max(h, w) / options.max_aspect))) | 1
    out = np.zeros(g.shape, bool)
    out[:, y1:y2, x1:x2] = slid(slid(on, side, np.logical_and, False), side, np.logical_or, False)
    return out


def hopeless(images: Image, draws: np.ndarray, most: float, recipe: Recipe = Recipe()) -> np.ndarray:
    """Of images (n, h, w, 3), those whose ink covers more than ``most`` of the image for certain in each pose of the draws (n, tries, 4; from 0 to 1).

    A moved pixel whose nearest source pixel has full ink keeps a quarter of it, or more, and of that what the rims leave; where this is ink
    still, such pixels need only be counted.
    """
    n, h, w = images.shape[:3]
    if int(60 * (1 - recipe.rim)) <= 16:
        return np.zeros(n, bool)
    core = sure_ink(fx.gray(images))
    out = core.mean((1, 2)) > most * min(1, recipe.scales[0]) ** 2  # less ink than that is not worth the count
    between = lambda low, high, u: low + (high - low) * u
    turn = between(*recipe.scales, draws[..., 1]) * np.exp(-1j * np.radians(between(-recipe.turn, recipe.turn, draws[..., 0])))
    shift = between(-recipe.shift, recipe.shift, draws[..., 2]) * w + 1j * between(-recipe.shift, recipe.shift, draws[..., 3]) * h
    back, middle = 1 / turn, w / 2 + 1j * h / 2
    start = middle - back * (middle + shift)
    xs, ys = np.arange(w), np.arange(h)[:, None]
    for k in np.flatnonzero(out):
        a, b, c, d = (v.astype(np.float32)[:, None, None] for v in (back[k].real, back[k].imag, start[k].real + 0.5, start[k].imag + 0.5))
        x, y = (a * xs.astype(np.float32) + (c - b * ys)), (b * xs.astype(np.float32) + (d + a * ys))
        x, y = (np.floor(v, out=v).astype(np.int32) for v in (x, y))
        rim = max(0, -int(x.min()), -int(y.min()), int(x.max()) - w + 1, int(y.max()) - h + 1)
        around = np.pad(core[k], rim).ravel()
        y += rim
        y *= w + 2 * rim
        y += x
        y += rim
        out[k] = (np.count_nonzero(around[y], axis=(1, 2)) > most * h * w).all()
    return out
