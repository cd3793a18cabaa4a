"""Label index: rows excluded, missing or kept; counts and rare classes; conjunctive filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the label that stands for an unknown class.
UNKNOWN_LABEL = "□"


def routed(rows: DataFrame, label: str, known: DataFrame, key: str, exclude: Sequence[str] = ()) -> DataFrame:
    """``rows`` with route: excluded by label, else missing if ``known`` lacks the key, else kept."""
    marks = known.select(F.col(key).alias("_known")).distinct().withColumn("_there", F.lit(True))
    out = rows.join(marks, rows[key] == marks["_known"], "left")
    banned = F.coalesce(F.col(label).isin(UNKNOWN_LABEL, *exclude), F.lit(False))
    route = F.when(banned, "excluded").when(F.col("_there").isNull(), "missing").otherwise("kept")
    return out.withColumn("route", route).drop("_known", "_there")


def index_summary(rows: DataFrame, label: str, min_count: int) -> DataFrame:
    """One row: rows of each route, distinct kept classes, and classes under ``min_count``."""
    by = rows.groupBy(label).agg(*(F.count_if(F.col("route") == r).alias(r) for r in ("kept", "excluded", "missing")))
    return by.agg(
        *(F.coalesce(F.sum(r), F.lit(0)).cast("long").alias(r) for r in ("kept", "excluded", "missing")),
        F.count_if(F.col("kept") > 0).alias("classes"), F.count_if((F.col("kept") > 0) & (F.col("kept") < min_count)).alias("rare_classes"),
    )


def class_counts(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("count"))


def rare_classes(counts: DataFrame, min_count: int) -> DataFrame:
    """Classes under ``min_count`` and what they need to reach it."""
    return counts.where(F.col("count") < min_count).withColumn("need_to_min_count", F.lit(min_count) - F.col("count"))


def load_rare(rare: DataFrame, max_count: int | None) -> DataFrame:
    return rare if max_count is None else rare.where(F.col("count") < max_count)


def filled(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    for c in columns:
        rows = rows.where(F.coalesce(F.col(c), F.lit("")) != "")
    return rows


def chosen(rows: DataFrame, label: str, labels: Sequence[str] | None = None, ok: Column | None = None, want_ok: bool = False, want_failed: bool = False, reference: str | None = None) -> DataFrame:
    """Optional predicates, all of which hold; asking for both good and failed rows is an error."""
    if want_ok and want_failed:
        raise ValueError("either good rows or failed ones")
    if labels:
        rows = rows.where(F.col(label).isin(*labels))
    if want_ok or want_failed:
        rows = rows.where(ok if want_ok else ~ok)
    return filled(rows, reference) if reference else rows


def flagged(rows: DataFrame, listing: DataFrame, key: str, out: str = "copied") -> DataFrame:
    """All rows, with whether their file is listed."""
    there = listing.select(F.col(key).alias("_k")).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, rows[key] == there["_k"], "left").withColumn(out, F.col("_there").isNotNull()).drop("_k", "_there")


def first_candidate(wanted: DataFrame, listing: DataFrame, group: str, candidate: str, priority: str, key: str) -> DataFrame:
    """Of each group's candidates that are listed, the one of the highest priority (smallest number)."""
    found = wanted.join(listing.select(F.col(key).alias("_k")).distinct(), F.col(candidate) == F.col("_k"), "inner")
    return found.groupBy(group).agg(F.min_by(candidate, priority).alias("found"))
