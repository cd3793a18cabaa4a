"""Columns of the tables that pipelines exchange.  Cells are text at the source; these are the typed tables."""

from __future__ import annotations

LABELS = "path STRING, char STRING, book STRING, page STRING, index STRING"
CLEAN_SAMPLES = "source_label STRING, image_path STRING, char STRING, book STRING, page STRING, index STRING"
CLASS_COUNTS = "char STRING, count INT"
RARE_CHARS = "char STRING, count INT, need_to_min_count INT"
BACKGROUNDS = "source STRING, image STRING, xml STRING, background STRING, patches INT, boxes INT, mask_ratio DOUBLE, crop_box STRING"
CHAR_BACKGROUNDS = "source STRING, char STRING, char_code STRING, image STRING, background STRING, patch STRING, mask_ratio DOUBLE, white_ratio DOUBLE, gray_std DOUBLE"
GENERATED = (
    "path STRING, char STRING, char_code STRING, source_label STRING, source_image STRING, source_width INT, source_height INT, output_width INT, output_height INT, "
    "background_source STRING, background STRING, method STRING, pre_extract_enhance STRING, angle DOUBLE, scale DOUBLE"
)
MEASURES = (
    "entropy DOUBLE, contrast_std DOUBLE, laplacian_var DOUBLE, edge_density DOUBLE, dark_ratio DOUBLE, white_ratio DOUBLE, alpha_ratio DOUBLE, darkness_mean DOUBLE, "
    "bbox_fill_ratio DOUBLE, bbox_area_ratio DOUBLE, component_count INT"
)
COMPARISON = "psnr DOUBLE, ssim DOUBLE, foreground_psnr DOUBLE, foreground_ssim DOUBLE, entropy_delta DOUBLE"
PER_CLASS = "char STRING, support INT, correct INT, accuracy DOUBLE, train_count INT"
IMAGES = "path STRING, height INT, width INT, channels INT, data BINARY"


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]
