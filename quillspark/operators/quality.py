"""Joins of scored rows with their sources' verdicts, summaries, kept rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import or_unknown


def source_verdict(rows: DataFrame, verdicts: DataFrame, key: str, ok: str, out: str = "source_quality_ok") -> DataFrame:
    """All rows, with their source's verdict; a source that was not scored is good."""
    last = verdicts.groupBy(F.col(key).alias("_k")).agg(F.bool_and(ok).alias("_ok"))
    return rows.join(last, rows[key] == last["_k"], "left").withColumn(out, F.coalesce("_ok", F.lit(True))).drop("_k", "_ok")


def only_good(rows: DataFrame, verdicts: DataFrame, key: str, ok: str) -> DataFrame:
    """Rows whose source was scored and is good."""
    return rows.join(verdicts.where(ok).select(key).distinct(), key, "left_semi")


def kept(quality_ok: Column, source_ok: Column, require_source: bool) -> Column:
    return quality_ok & source_ok if require_source else quality_ok


def summary(rows: DataFrame, group: str) -> DataFrame:
    """For each group: rows, good rows and their share, averages of score and entropy over all rows (missing as zero), and of comparisons over the rows that have them."""
    present = ("ssim", "psnr", "foreground_ssim", "foreground_psnr")
    return rows.groupBy(or_unknown(F.col(group)).alias(group)).agg(
        F.count("*").alias("total"), F.count_if("quality_ok").alias("quality_ok"), F.round(F.count_if("quality_ok") / F.count("*"), 6).alias("quality_ok_rate"),
        F.round(F.avg(F.coalesce("quality_score", F.lit(0.0))), 6).alias("avg_quality_score"), F.round(F.avg(F.coalesce("entropy", F.lit(0.0))), 6).alias("avg_entropy"),
        *(F.round(F.avg(c), 6).alias(f"avg_{c}") for c in present),
    )
