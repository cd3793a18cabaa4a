"""Boxes and points as structs and column functions: parsing, clamping, shifting, covering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<xmin:int,ymin:int,xmax:int,ymax:int>"


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.lit(v).cast("int").alias(n) if not isinstance(v, Column) else v.cast("int").alias(n) for v, n in ((x1, "xmin"), (y1, "ymin"), (x2, "xmax"), (y2, "ymax"))))


def numbers(c: Column, n: int) -> Column:
    """Exactly ``n`` whole numbers, separated by commas; null for anything else."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when((F.size(parts) == n) & ~F.exists(parts, lambda x: x.isNull()), parts)


def parse_box(c: Column) -> Column:
    """x1,y1,x2,y2 with room inside; else null."""
    p = numbers(c, 4)
    return F.when((p[2] > p[0]) & (p[3] > p[1]), box(p[0], p[1], p[2], p[3]))


def parse_point(c: Column) -> Column:
    p = numbers(c, 2)
    return F.when(p.isNotNull(), F.struct(p[0].alias("x"), p[1].alias("y")))


def _within(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), high)


def padded(b: Column, pad: int, width: Column, height: Column) -> Column:
    """A box grown on all sides and cut to the image; it may be empty if it lies outside."""
    return box(_within(b["xmin"] - pad, 0, width), _within(b["ymin"] - pad, 0, height), _within(b["xmax"] + pad, 0, width), _within(b["ymax"] + pad, 0, height))


def prompt(b: Column, width: Column, height: Column) -> Column:
    """A box cut to the image so that a pixel at least is left."""
    x1, y1 = _within(b["xmin"], 0, width - 1), _within(b["ymin"], 0, height - 1)
    return box(x1, y1, _within(b["xmax"], x1 + 1, width), _within(b["ymax"], y1 + 1, height))


def around(p: Column, width: Column, height: Column, share: float = 0.7) -> Column:
    """A square around a point, ``share`` of the shorter side and 16 at least, cut to the image."""
    side = F.greatest(F.lit(16), F.floor(F.least(width, height) * share).cast("int"))
    half = F.floor(side / 2).cast("int")
    return prompt(box(p["x"] - half, p["y"] - half, p["x"] - half + side, p["y"] - half + side), width, height)


def inset(width: Column, height: Column, share: float = 0.04) -> Column:
    """The image without a rim of ``share`` of each side, a pixel at least."""
    x, y = (F.greatest(F.lit(1), F.floor(v * share).cast("int")) for v in (width, height))
    return box(x, y, width - x, height - y)


def shifted(boxes: Column, crop: Column) -> Column:
    """Boxes in the coordinates of a crop, cut to it; those with nothing left go."""
    w, h = crop["xmax"] - crop["xmin"], crop["ymax"] - crop["ymin"]
    moved = F.transform(boxes, lambda b: box(_within(b["xmin"] - crop["xmin"], 0, w), _within(b["ymin"] - crop["ymin"], 0, h), _within(b["xmax"] - crop["xmin"], 0, w), _within(b["ymax"] - crop["ymin"], 0, h)))
    return F.filter(moved, lambda b: (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"]))


def area(b: Column) -> Column:
    return F.greatest(b["xmax"] - b["xmin"], F.lit(0)).cast("long") * F.greatest(b["ymax"] - b["ymin"], F.lit(0))


def covered_area(boxes: Column) -> Column:
    """Area of the union of boxes: for each strip between neighbouring x edges, the length of the union of the boxes across it."""
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(b["xmin"], b["xmax"])))))
    strips = F.zip_with(xs, F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    strips = F.filter(strips, lambda s: s["b"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(2**31)).cast("int").alias("end"))

    def length(a: Column, b: Column) -> Column:
        across = F.array_sort(F.transform(F.filter(boxes, lambda x: (x["xmin"] <= a) & (x["xmax"] >= b)), lambda x: F.struct(x["ymin"].alias("lo"), x["ymax"].alias("hi"))))
        step = lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(s["end"], x["hi"]).alias("end"))
        return F.aggregate(across, start, step, lambda s: s["n"])

    return F.aggregate(strips, F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]) * length(x["a"], x["b"]))
