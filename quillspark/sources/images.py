"""Images as rows: decoding by Spark's image source, NumPy kernels in Arrow batches."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions.scoring import Limits, glyph_passes
from quillspark.kernels import fusion
from quillspark.kernels import glyphs as gl
from quillspark.scratch import scratch

#: Bytes that opening a small file is taken to cost where a folder of them is dealt to tasks.
OPEN_BYTES, _OPEN_COST = 1 << 16, "spark.sql.files.openCostInBytes"
_DIGESTS = "path string, height int, width int, channels int, digest string"
#: Images of an Arrow batch that are Python objects at a time.
BATCH = 64


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, height, width, channels and data (blue, green, red) of every file; one that is no image has height -1."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def decoded(data: bytes) -> tuple[int, int, int, bytes]:
    """height, width, channels and pixels (blue, green, red, alpha) of a PNG file of 8 bits, gray, colour or colour and alpha, row by row."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a PNG chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in (0, 2, 6) or interlaced:
        raise ValueError(f"a PNG file of a kind that is not read: depth {depth}, colour {colour}, interlaced {interlaced}")
    n = {0: 1, 2: 3, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * n)
    x = rows[:, 1:].reshape(height, width, n)
    if rows[:, 0].any():
        x = _unfiltered(rows[:, 0], x)
    return height, width, n, (x if n == 1 else x[..., [2, 1, 0, *([3] if n == 4 else [])]]).tobytes()


def _unfiltered(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pixels from those that are told by their neighbours."""
    out = np.zeros((x.shape[0] + 1, x.shape[1] + 1, x.shape[2]), np.int32)  # a row above and a column to the left
    for i, kind in enumerate(kinds.tolist(), 1):
        row, above = x[i - 1], out[i - 1]
        if kind in (0, 2):
            out[i, 1:] = (row + (above[1:] if kind else 0)) & 255
        elif kind == 1:
            out[i, 1:] = np.cumsum(row, 0, dtype=np.int64) & 255
        elif kind in (3, 4):
            for j in range(1, x.shape[1] + 1):
                a, b, c = out[i, j - 1], above[j], above[j - 1]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[i, j] = (row[j - 1] + guess) & 255
        else:
            raise ValueError(f"a PNG row's filter {kind}")
    return out[1:, 1:].astype(np.uint8)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            height, width, channels, data = zip(*(decoded(x.as_py()) for x in part.column("content")), strict=True)
            sizes = (pa.array(x, pa.int32()) for x in (height, width, channels))
            digest = pa.array([hashlib.sha256(x).hexdigest() for x in data])
            yield pa.record_batch([part.column("path"), *sizes, digest], names=["path", "height", "width", "channels", "digest"])


def digests_of_folders(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """path, height, width, channels and digest (SHA-256 of the pixels) of the PNG files of each folder, as a table: one folder after another, so that
    the driver never holds the listing of more than one.

    Spark's image source compiles code for every file, some 10 ms each, so these are read as they are and decoded in Arrow batches; and small
    files are dealt by the thousand to a task, not as if each were of 4 MB.  A file that is no PNG of ``decoded`` is an error.
    """
    path, cost = scratch(spark, name), spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, str(OPEN_BYTES))
    try:
        for folder in folders:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
            made = found.mapInArrow(_decoded, _DIGESTS)
            made.write.mode("append").parquet(path)
    finally:
        spark.conf.set(_OPEN_COST, cost)
    return spark.read.schema(_DIGESTS).parquet(path)


def readable(images: DataFrame) -> DataFrame:
    return images.where("height > 0")


def pixels(data: bytes, height: int, width: int, channels: int, colour: bool = True) -> np.ndarray:
    """An array of an image row: colour (alpha dropped, gray repeated) or gray."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    x = np.repeat(x, 3, 2) if channels == 1 else x[..., :3]
    return x if colour else gl.fx.gray(x)


def seeded(seed: int, *keys: object) -> np.random.Generator:
    """A generator that depends on nothing but the seed and the keys, so a task run again draws the same."""
    digest = hashlib.md5("|".join(map(str, (seed, *keys))).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little"))


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<float>": pa.list_(pa.float32())}


def _mapped(images: DataFrame, keep: list[str], schema: str, f: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows that ``f`` makes of each row, after its columns ``keep``; images are not passed on.  Few images are Python objects at a time."""
    kinds = dict(images.dtypes)
    full = ", ".join([*(f"{c} {kinds[c]}" for c in keep), schema])
    names = [x.rsplit(" ", 1)[0].split()[0] for x in full.split(", ")]
    arrow = pa.schema([(n, _ARROW[x.rsplit(" ", 1)[1]]) for n, x in zip(names, full.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = [(*(r[c] for c in keep), *out) for r in batch.slice(at, BATCH).to_pylist() for out in f(r)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    return images.mapInArrow(run, full)


def _image(r: dict, prefix: str = "") -> np.ndarray:
    return pixels(r[f"{prefix}data"], r[f"{prefix}height"], r[f"{prefix}width"], r[f"{prefix}channels"])


def measured(images: DataFrame, keep: list[str] = ("path",), options: gl.MaskOptions = gl.MaskOptions()) -> DataFrame:
    """The measures of every image, rounded; an unreadable one has none."""
    names = schemas.names(schemas.MEASURES)

    def f(r: dict) -> Iterator[tuple]:
        m = gl.measures(_image(r), options) if r["height"] > 0 else {}
        yield (bool(m), *(round(m[n], 6) if n in m else None for n in names))

    return _mapped(images, list(keep), f"readable boolean, {schemas.MEASURES.lower()}", f)


def compared(images: DataFrame, references: DataFrame, reference: str, keep: list[str], options: gl.MaskOptions = gl.MaskOptions()) -> DataFrame:
    """Every image with its likeness to the one at its reference path; null where that is absent or unreadable."""
    other = readable(references).select(F.col("path").alias("_ref"), *(F.col(c).alias(f"ref_{c}") for c in ("height", "width", "channels", "data")))
    both = images.join(other, images[reference] == other["_ref"], "left").drop("_ref")
    names = schemas.names(schemas.COMPARISON)

    def f(r: dict) -> Iterator[tuple]:
        m = gl.comparison(_image(r), _image(r, "ref_"), options) if r["height"] > 0 and r["ref_data"] is not None else {}
        yield tuple(round(m[n], 6) if m.get(n) is not None else None for n in names)

    return _mapped(both, keep, schemas.COMPARISON.lower(), f)


def vectors(images: DataFrame, side: int, keep: list[str]) -> DataFrame:
    """Gray pixels at ``side`` by ``side`` as floats from 0 to 1; unreadable images go."""
    return _mapped(readable(images), keep, "v array<float>", lambda r: iter([(gl.feature_vector(_image(r), side),)]))


def extracted(images: DataFrame, options: gl.MaskOptions = gl.MaskOptions(), box: gl.Box | None = None) -> DataFrame:
    """path, alpha (bytes by row), area and ratio of the glyph of every readable image; without a box, inside of the inset."""

    def f(r: dict) -> Iterator[tuple]:
        alpha = gl.glyph_mask(_image(r), box or gl.inset_box(r["width"], r["height"]), options)
        area = int((alpha > 8).sum())
        yield alpha.tobytes(), area, area / alpha.size

    return _mapped(readable(images), ["path", "height", "width"], "alpha binary, area int, ratio double", f)


def page_backgrounds(pages: DataFrame, count: int = 4, size: int = 128, seed: int = 42, pad: int = 4, grow: int = 3, crop: str = "white", margin: int = 0) -> DataFrame:
    """From pages with boxes: a row for each patch, with the page's mask ratio and crop.  Pages whose crop has no box left are passed."""
    crops = {"none": lambda x: (0, 0, x.shape[1], x.shape[0]), "white": lambda x: gl.white_crop(x, margin), "edge": lambda x: gl.edge_crop(x, margin)}
    if crop not in crops:
        raise ValueError(f"crop {crop!r}: one of {sorted(crops)}")

    def f(r: dict) -> Iterator[tuple]:
        image = _image(r)
        x1, y1, x2, y2 = crops[crop](image)
        moved = [(max(b["xmin"] - x1, 0), max(b["ymin"] - y1, 0), min(b["xmax"], x2) - x1, min(b["ymax"], y2) - y1) for b in r["boxes"]]
        moved = [b for b in moved if b[2] > b[0] and b[3] > b[1]]
        if not moved:
            return
        image = image[y1:y2, x1:x2]
        mask = gl.box_mask(*image.shape[:2], moved, pad, grow)
        ground = gl.fx.filled(image, mask)
        for k, patch in enumerate(gl.patches(ground, size, count, seeded(seed, r["path"]), mask)):
            yield k, patch.shape[0], patch.shape[1], patch.tobytes(), len(moved), float((mask > 0).mean()), f"{x1},{y1},{x2},{y2}"

    return _mapped(readable(pages), ["path"], "patch_no int, height int, width int, data binary, box_count int, mask_ratio double, crop_box string", f)


def char_backgrounds(images: DataFrame, size: int = 128, grow: int = 3, max_mask: float = 0.65, max_white: float = 0.85, min_std: float = 2.0, keep: list[str] = ("path",)) -> DataFrame:
    """A background patch of every single glyph's image: the glyph filled, cut to size, and kept if it can be used."""

    def f(r: dict) -> Iterator[tuple]:
        image = _image(r)
        on = gl.fx.dilate(np.where(gl.glyph_mask(image, gl.inset_box(r["width"], r["height"])) > 8, 255, 0).astype(np.uint8), 2 * grow + 1)
        patch = gl.cover(gl.fx.filled(image, on), size, size)
        m = gl.patch_measures(patch) | {"mask_ratio": float((on > 0).mean())}
        if m["mask_ratio"] <= max_mask and m["white_ratio"] <= max_white and m["gray_std"] >= min_std:
            yield size, size, patch.tobytes(), round(m["mask_ratio"], 6), round(m["white_ratio"], 6), round(m["gray_std"], 6)

    return _mapped(readable(images), list(keep), "height int, width int, data binary, mask_ratio double, white_ratio double, gray_std double", f)


def glyph_usable(images: DataFrame, mode: str = "none", keep: list[str] = ("path",)) -> DataFrame:
    """Whether each image's glyph can be used for generation, after enhancement: the cheap part, once per image and mode."""
    fields = ("alpha_ratio", "darkness_mean", "bbox_fill_ratio", "bbox_area_ratio", "component_count")
    return _mapped(readable(images), list(keep), "alpha_ratio double, darkness_mean double, bbox_fill_ratio double, bbox_area_ratio double, component_count int", lambda r: iter([tuple(gl.mask_measures(gl.enhanced(_image(r), mode))[n] for n in fields)]))


def posable(slots: DataFrame, mode: str = "none", seed: int = 42, recipe: fusion.Recipe = fusion.Recipe(), keep: list[str] = ("char", "slot"), tries: int = 20, limits: Limits = Limits()) -> DataFrame:
    """The rows, with all columns, but for those of which ``generated`` with the same arguments would make nothing for certain: too much ink in every
    pose.  Backgrounds are not asked for, so they need only be joined to what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows, stay, sizes = part.select(list(dict.fromkeys([*keep, "height", "width", "channels", "data"]))).to_pylist(), np.ones(part.num_rows, bool), {}
                for k, r in enumerate(rows):
                    sizes.setdefault((r["height"], r["width"]), []).append(k)
                for some in sizes.values():
                    draws = np.stack([seeded(seed, *(rows[k][c] for c in keep)).random((tries, 4)) for k in some])
                    stay[some] = ~fusion.hopeless(np.stack([gl.enhanced(_image(rows[k]), mode) for k in some]), draws, limits.max_alpha, recipe)
                if stay.any():
                    yield part.filter(pa.array(stay))

    return slots.mapInArrow(run, slots.schema)


def generated(slots: DataFrame, mode: str = "none", seed: int = 42, recipe: fusion.Recipe = fusion.Recipe(), keep: list[str] = ("char", "slot"), size: int | None = None, tries: int = 20, limits: Limits = Limits()) -> DataFrame:
    """A sample for each row with a glyph image and a background image (bg_ columns), as large as the glyph's or ``size`` squared.

    Poses are drawn until the moved glyph passes the gate once more, ``tries`` at most; a row whose poses all fail gives none.
    """

    def f(r: dict) -> Iterator[tuple]:
        source, rng = _image(r), seeded(seed, *(r[k] for k in keep))
        image = gl.enhanced(source, mode)
        if fusion.hopeless(image[None], seeded(seed, *(r[k] for k in keep)).random((1, tries, 4)), limits.max_alpha, recipe)[0]:
            return
        layers = fusion.stack(image, source, recipe)
        for _ in range(tries):
            pose = fusion.Pose.drawn(rng, recipe)
            moved = fusion.without_rims(pose.apply(layers), recipe)
            if fusion.usable(moved, lambda m: glyph_passes(m, limits)):
                break
        else:
            return
        h, w = (size, size) if size else source.shape[:2]
        out = fusion.inked(fusion.grounded(gl.cover(_image(r, "bg_"), w, h), moved, recipe), moved, rng, recipe)
        look = lambda x: x.astype(np.uint8).tobytes()
        yield h, w, out.tobytes(), round(pose.angle, 6), round(pose.scale, 6), *source.shape[:2], look(moved.alpha), look(np.clip(moved.darkness, 0, 1) * 255)

    return _mapped(slots, list(keep), "height int, width int, data binary, angle double, scale double, source_height int, source_width int, alpha binary, darkness binary", f)
