"""All queries of the engine outside the corpus subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import files, images, kernels, labels, models, selection, streams, texts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for module in (labels, texts, models, images, selection, streams, files, kernels):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
