"""Quality scores as column expressions: clipped ramps, weighted sums, ordered reasons for failure, gates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """What an image has to reach; fixed values are the defaults."""

    min_source_score: float = 0.38
    min_generated_score: float = 0.36
    min_alpha: float = 0.003
    max_alpha: float = 0.45
    min_darkness: float = 0.015
    max_fill: float = 0.72
    max_dark: float = 0.78
    max_white: float = 0.92
    min_contrast: float = 7.0
    min_laplacian: float = 3.0
    #: A box of at least this share of the image counts as a filled rectangle.
    box_share: float = 0.08
    max_entropy_shift: float = 1.8


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def ramp(x: Column, low: float, high: float) -> Column:
    """From 0 at ``low`` to 1 at ``high``; 0 if there is no room between them."""
    return _clip((x - low) / (high - low)) if high > low else F.lit(0.0)


def nearness(x: Column, target: float, width: float) -> Column:
    return _clip(1 - F.abs(x - target) / max(width, 1e-6))


def flags(limits: Limits = Limits()) -> dict[str, Column]:
    """The checks, over columns alpha_ratio, bbox_fill_ratio, bbox_area_ratio, contrast_std, laplacian_var, darkness_mean, dark_ratio, white_ratio."""
    c = F.col
    return {
        "alpha_ok": c("alpha_ratio").between(limits.min_alpha, limits.max_alpha),
        "rectangle_ok": ~((c("bbox_fill_ratio") > limits.max_fill) & (c("bbox_area_ratio") > limits.box_share)),
        "contrast_ok": c("contrast_std") >= limits.min_contrast,
        "sharpness_ok": c("laplacian_var") >= limits.min_laplacian,
        "darkness_ok": c("darkness_mean") >= limits.min_darkness,
        "dark_ratio_ok": c("dark_ratio") <= limits.max_dark,
        "white_ratio_ok": c("white_ratio") <= limits.max_white,
    }


def no_reference_score(limits: Limits = Limits()) -> Column:
    c, ok = F.col, flags(limits)
    over = lambda x, at: 1 - ramp(x, at, min(1.0, at + 0.35))
    # The weight of each part.
    parts = [
        (0.16, ramp(c("entropy"), 3.0, 8.0)),
        (0.16, ramp(c("contrast_std"), limits.min_contrast, 64.0)),
        (0.16, ramp(F.log1p("laplacian_var"), math.log1p(limits.min_laplacian), math.log1p(1200.0))),
        (0.12, F.when(c("edge_density").between(0.003, 0.35), F.lit(1.0)).otherwise(nearness(c("edge_density"), 0.08, 0.08))),
        (0.18, ok["alpha_ok"].cast("double")),
        (0.12, ramp(c("darkness_mean"), limits.min_darkness, 8 * limits.min_darkness)),
        (0.07, ok["rectangle_ok"].cast("double")),
        (0.03, F.least(over(c("dark_ratio"), limits.max_dark), over(c("white_ratio"), limits.max_white))),
    ]
    return reduce(lambda x, y: x + y, [w * p for w, p in parts])


def final_score(kind: Column) -> Column:
    """The score without reference, or mixed with the comparison to one; a foreground value of exactly zero gives way to the whole image's."""
    c = F.col
    psnr = F.coalesce(F.nullif("foreground_psnr", F.lit(0.0)), c("psnr"))
    ssim = F.coalesce(F.nullif("foreground_ssim", F.lit(0.0)), c("ssim"))
    mixed = 0.55 * c("no_ref_score") + 0.15 * ramp(psnr, 12.0, 32.0) + 0.20 * ramp(ssim, 0.45, 0.98) + 0.10 * nearness(c("entropy_delta"), 0.15, 1.2)
    return F.when((kind == "source") | c("psnr").isNull(), c("no_ref_score")).otherwise(mixed)


def reasons(kind: Column, limits: Limits = Limits()) -> Column:
    """Names of the checks that failed, in fixed order."""
    names = ("bad_alpha_area", "filled_rectangle_mask", "low_contrast", "blurred", "weak_ink", "too_dark", "too_white")
    failed = [F.when(~ok, F.lit(n)) for n, ok in zip(names, flags(limits).values(), strict=True)]
    shifted = (kind == "generated") & F.col("entropy_delta").isNotNull() & (F.abs("entropy_delta") > limits.max_entropy_shift)
    return F.array_compact(F.array(*failed, F.when(shifted, F.lit("entropy_shift_too_large"))))


def passes(kind: Column, score: Column, found: Column, limits: Limits = Limits()) -> Column:
    """The score is reached and no check failed."""
    least = F.when(kind == "source", F.lit(limits.min_source_score)).otherwise(F.lit(limits.min_generated_score))
    return (score >= least) & (F.size(found) == 0)


def reason_text(found: Column, source_ok: Column | None = None) -> Column:
    """Reasons joined by ``+``; a bad source image is named last."""
    if source_ok is not None:
        found = F.when(source_ok, found).otherwise(F.array_append(found, F.lit("bad_source_image")))
    return F.array_join(found, "+")


def glyph_gate(limits: Limits = Limits()) -> Column:
    """Whether a glyph's mask can be used at all: its area, its parts, its box and its ink."""
    ok = flags(limits)
    return ok["alpha_ok"] & (F.col("component_count") >= 1) & ok["rectangle_ok"] & ok["darkness_ok"]


def glyph_passes(m: dict[str, float], limits: Limits = Limits()) -> bool:
    """The same gate on the measures of one glyph."""
    filled = m["bbox_fill_ratio"] > limits.max_fill and m["bbox_area_ratio"] > limits.box_share
    return limits.min_alpha <= m["alpha_ratio"] <= limits.max_alpha and m["component_count"] >= 1 and not filled and m["darkness_mean"] >= limits.min_darkness


def size_match(width: Column, height: Column, other_width: Column, other_height: Column) -> Column:
    """Whether two sizes are known and the same."""
    return F.coalesce((width == other_width) & (height == other_height), F.lit(False))


def patch_gate(max_mask: float = 0.02, max_white: float = 0.35, min_std: float = 4.0) -> Column:
    """Whether a background patch can be used, over mask_ratio, white_ratio and gray_std (defaults: pages)."""
    return (F.col("mask_ratio") <= max_mask) & (F.col("white_ratio") <= max_white) & (F.col("gray_std") >= min_std)


def difficulty_flags(baseline: Column, simple: Column, threshold: float, min_gain: float) -> dict[str, Column]:
    """Why a class is hard: it got worse, it is still low, or it gained nothing to speak of."""
    gain = simple - baseline
    return {"worse_after_simple_fusion": gain < 0, "low_simple_fusion_accuracy": simple <= threshold, "no_clear_simple_fusion_gain": gain <= min_gain}
