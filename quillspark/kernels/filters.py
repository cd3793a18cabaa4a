"""Filters on gray (h, w) and colour (h, w, 3; blue, green, red) arrays.  Borders are mirrored without repeating the rim, as in public image libraries."""

from __future__ import annotations

import numpy as np

Image = np.ndarray


def gray(image: Image) -> Image:
    """Luma of a colour image, rounded; a gray one as it is."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def to_byte(x: Image) -> Image:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _mirror(n: int, r: int) -> np.ndarray:
    """Places of an axis with ``r`` more at either end, folded back without repeating the rim."""
    if n == 1:
        return np.zeros(1 + 2 * r, int)
    k = np.mod(np.arange(-r, n + r), 2 * (n - 1))
    return np.where(k < n, k, 2 * (n - 1) - k)


def _padded(x: Image, ry: int, rx: int) -> Image:
    return x[_mirror(x.shape[0], ry)][:, _mirror(x.shape[1], rx)]


def separable(x: Image, ky: np.ndarray, kx: np.ndarray) -> Image:
    """Correlation with a column and a row kernel, in doubles."""
    ry, rx = len(ky) // 2, len(kx) // 2
    p = _padded(x.astype(np.float64), ry, rx)
    rows = sum(k * p[i : i + x.shape[0]] for i, k in enumerate(ky))
    return sum(k * rows[:, i : i + x.shape[1]] for i, k in enumerate(kx))


def gauss_kernel(size: int, sigma: float) -> np.ndarray:
    # The binomial kernels that stand for sigma zero at small sizes.
    small = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625]}
    if sigma <= 0 and size in small:
        return np.array(small[size])
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    t = np.arange(size) - size // 2
    k = np.exp(-(t * t) / (2 * sigma * sigma))
    return k / k.sum()


def blur(x: Image, size: int = 0, sigma: float = 0.0) -> Image:
    """Gaussian blur; bytes stay bytes, floats floats.  Size zero follows from sigma."""
    byte = x.dtype == np.uint8
    size = size or int(round(sigma * (6 if byte else 8) + 1)) | 1
    k = gauss_kernel(size, sigma)
    out = separable(x, k, k)
    return to_byte(out) if byte else out.astype(x.dtype)


def median3(x: Image) -> Image:
    p = np.pad(x, [(1, 1), (1, 1)] + [(0, 0)] * (x.ndim - 2), "edge")
    h, w = x.shape[:2]
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(x.dtype)


def laplacian(g: Image) -> Image:
    p = _padded(g.astype(np.float64), 1, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def canny(g: Image, low: float, high: float) -> Image:
    """Edges (0 or 255): thin ridges of the gradient above ``high``, and those above ``low`` that touch one."""
    dx = separable(g, np.array([1.0, 2, 1]), np.array([-1.0, 0, 1]))
    dy = separable(g, np.array([-1.0, 0, 1]), np.array([1.0, 2, 1]))
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, 1)
    h, w = g.shape
    at = lambda oy, ox: p[1 + oy : 1 + oy + h, 1 + ox : 1 + ox + w]
    slope, flat, steep = np.abs(dy), np.abs(dx) * np.tan(np.pi / 8), np.abs(dx) * np.tan(3 * np.pi / 8)
    same = (dx >= 0) == (dy >= 0)
    across = [(slope < flat, (0, -1), (0, 1)), (slope > steep, (-1, 0), (1, 0)), ((slope >= flat) & (slope <= steep) & same, (-1, -1), (1, 1)), ((slope >= flat) & (slope <= steep) & ~same, (-1, 1), (1, -1))]
    ridge = np.zeros(g.shape, bool)
    for where, a, b in across:
        ridge |= where & (size > at(*a)) & (size >= at(*b))
    weak = ridge & (size > low)
    labels, count = components(weak)
    strong = np.zeros(count + 1, bool)
    strong[labels[weak & (size > high)]] = True
    strong[0] = False
    return np.where(strong[labels], 255, 0).astype(np.uint8)


def components(mask: Image) -> tuple[Image, int]:
    """Labels from 1 of the parts of a mask that touch in one of eight directions, and their number; numbered by first pixel."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, begin = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    of = list(range(len(y)))

    def root(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    rows = np.searchsorted(y, np.arange(h + 1))
    for r in range(1, h):
        a, b = rows[r - 1], rows[r]
        i, j = int(a), int(b)
        while i < rows[r] and j < rows[r + 1]:
            if begin[i] <= stop[j] and begin[j] <= stop[i]:  # runs of neighbouring rows that touch, corners included
                x, z = root(i), root(j)
                of[max(x, z)] = min(x, z)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(k) for k in range(len(y))], np.int64)
    order = {k: n + 1 for n, k in enumerate(dict.fromkeys(roots.tolist()))}
    out = np.zeros((h, w), np.int32)
    for k in range(len(y)):
        out[y[k], begin[k] : stop[k]] = order[int(roots[k])]
    return out, len(order)


def part_stats(labels: Image, count: int) -> np.ndarray:
    """x, y, width, height and area of each part (rows from 0 for label 1)."""
    out = np.zeros((count, 5), np.int64)
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs] - 1
    for column, v in ((0, xs), (1, ys)):
        low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, -1)
        np.minimum.at(low, own, v)
        np.maximum.at(high, own, v)
        out[:, column], out[:, column + 2] = low, high - low + 1
    out[:, 4] = np.bincount(own, minlength=count)
    return out


def _sliding(x: Image, size: int, best, rim: int) -> Image:
    """The extreme over a square of ``size``; the image goes on as ``rim`` outside."""
    if size <= 1:
        return x.copy()
    before, after = size // 2, size - 1 - size // 2
    p = np.pad(x, ((before, after), (before, after)), constant_values=rim)
    rows = best.reduce([p[i : i + x.shape[0]] for i in range(size)])
    return best.reduce([rows[:, i : i + x.shape[1]] for i in range(size)])


def dilate(x: Image, size: int) -> Image:
    return _sliding(x, size, np.maximum, 0)


def erode(x: Image, size: int) -> Image:
    return _sliding(x, size, np.minimum, 255)


def closed(x: Image, size: int) -> Image:
    return erode(dilate(x, size), size)


def opened(x: Image, size: int) -> Image:
    return dilate(erode(x, size), size)


def otsu(g: Image) -> int:
    """The level that parts the histogram into two classes with the largest variance between them."""
    p = np.bincount(g.ravel(), minlength=256) / max(g.size, 1)
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    both = weight * (1 - weight)
    between = np.where(both > 1e-12, (mean[-1] * weight - mean) ** 2 / np.maximum(both, 1e-12), 0)
    return int(np.argmax(between))


def _weights(n: int, m: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of m target places: source places and weights along one axis of n."""
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    if kind == "nearest":
        return np.minimum(np.floor(np.arange(m) * n / m).astype(int), n - 1)[:, None], np.ones((m, 1))
    if kind == "area" and m < n:
        edges = np.arange(m + 1) * n / m
        span = int(np.ceil(n / m)) + 1
        at = np.floor(edges[:-1]).astype(int)[:, None] + np.arange(span)
        part = np.clip(np.minimum(at + 1, edges[1:, None]) - np.maximum(at, edges[:-1, None]), 0, None)
        return np.clip(at, 0, n - 1), part / part.sum(1, keepdims=True)
    base = np.floor(centre).astype(int)
    f = (centre - base)[:, None]
    if kind == "cubic":
        a, t = -0.75, np.concatenate([f + 1, f, 1 - f, 2 - f], 1)
        near = ((a + 2) * t - (a + 3)) * t * t + 1
        far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
        return np.clip(base[:, None] + np.arange(-1, 3), 0, n - 1), np.where(t <= 1, near, far)
    return np.clip(base[:, None] + np.arange(2), 0, n - 1), np.concatenate([1 - f, f], 1)


def resize(x: Image, width: int, height: int, kind: str = "linear") -> Image:
    """nearest, linear, cubic or area (the mean of what a target pixel covers; linear when enlarging)."""
    out = x.astype(np.float64)
    for axis, m in ((0, height), (1, width)):
        at, w = _weights(x.shape[axis], m, kind)
        moved = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.einsum("mk,mk...->m...", w, moved[at]), 0, axis)
    return to_byte(out) if x.dtype == np.uint8 else out.astype(x.dtype)


def warp(x: Image, matrix: np.ndarray, mirrored: bool = False) -> Image:
    """An affine map (2 by 3, source to target), linear; zeros outside, or the mirrored image."""
    h, w = x.shape[:2]
    back = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    ys, xs = np.mgrid[:h, :w]
    sx, sy = (back[k, 0] * xs + back[k, 1] * ys + back[k, 2] for k in range(2))
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        if mirrored:
            fold = lambda v, n: np.zeros_like(v) if n == 1 else (n - 1) - np.abs((n - 1) - np.mod(v, 2 * (n - 1)))
            return x[fold(yy, h), fold(xx, w)].astype(np.float64)
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        got = x[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.float64)
        return got * (inside if x.ndim == 2 else inside[..., None])

    if x.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return to_byte(out) if x.dtype == np.uint8 else out.astype(x.dtype)


def to_hsv(image: Image) -> np.ndarray:
    """Hue from 0 to 180, saturation and value from 0 to 255, in doubles."""
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    safe = np.maximum(span, 1e-12)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.stack([np.where(span > 0, hue % 180, 0), np.where(v > 0, 255 * span / np.maximum(v, 1e-12), 0), v], -1)


def from_hsv(hsv: np.ndarray) -> Image:
    h, s, v = hsv[..., 0] / 30, hsv[..., 1] / 255, hsv[..., 2]
    wave = lambda n: v - v * s * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1)
    return to_byte(np.stack([wave(1), wave(3), wave(5)], -1))


def equalised(g: Image, clip: float, tiles: int) -> Image:
    """Histogram equalisation by tiles with clipped histograms, blended linearly between tiles."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), "reflect" if h > th and w > tw else "edge")
    limit = max(1, int(clip * th * tw / 256))
    tables = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            hist[np.linspace(0, 255, over % 256, dtype=int)] += 1
            tables[i, j] = np.clip(np.rint(np.cumsum(hist) * 255 / (th * tw)), 0, 255)
    ys, xs = (np.arange(n) / t - 0.5 for n, t in ((h, th), (w, tw)))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    cut = lambda k: np.clip(k, 0, tiles - 1)
    of = lambda a, b: tables[cut(a)[:, None], cut(b)[None, :], g]
    return to_byte((of(y0, x0) * (1 - fx) + of(y0, x0 + 1) * fx) * (1 - fy) + (of(y0 + 1, x0) * (1 - fx) + of(y0 + 1, x0 + 1) * fx) * fy)


def smoothed(image: Image, radius: int = 2, colour: float = 22.0, space: float = 22.0) -> Image:
    """Bilateral filter: near pixels of near colour count most."""
    p = _padded(image.astype(np.float64), radius, radius)
    h, w = image.shape[:2]
    total, weight = np.zeros(image.shape), np.zeros((h, w))
    for oy in range(-radius, radius + 1):
        for ox in range(-radius, radius + 1):
            if oy * oy + ox * ox > radius * radius:
                continue
            near = p[radius + oy : radius + oy + h, radius + ox : radius + ox + w]
            differ = np.abs(near - image).reshape(h, w, -1).sum(-1)
            k = np.exp(-(differ**2) / (2 * colour**2) - (oy * oy + ox * ox) / (2 * space**2))
            total += near * (k[..., None] if image.ndim == 3 else k)
            weight += k
    return to_byte(total / (weight[..., None] if image.ndim == 3 else weight))


def filled(image: Image, mask: Image, rounds: int = 400) -> Image:
    """The pixels of ``mask`` filled from around: rings of means from the rim inwards, then smoothed until they settle.

    This stands for fast-marching inpainting; it agrees with it on constant surroundings and is within a few levels on smooth ones.
    """
    hole = mask > 0
    if not hole.any() or hole.all():
        return image.copy()
    out = image.astype(np.float64).reshape(*image.shape[:2], -1).copy()
    known = ~hole

    def around(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((1, 1), (1, 1), (0, 0)))
        h, w = x.shape[:2]
        return sum(p[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)

    while not known.all():
        count = around(known[..., None].astype(np.float64))[..., 0]
        ring = ~known & (count > 0)
        out[ring] = (around(out * known[..., None]) / np.maximum(count, 1)[..., None])[ring]
        known |= ring
    size = around(np.ones((*hole.shape, 1)))
    for _ in range(rounds):
        new = (around(out) / size)[hole]
        moved = np.abs(new - out[hole]).max()
        out[hole] = new
        if moved < 0.05:
            break
    return to_byte(out).reshape(image.shape)
