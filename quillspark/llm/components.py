"""Connected components of a table of links, by alternating star contractions over written tables.

Each round points every node's larger neighbours at its smallest one, then its smaller ones; a component of any shape becomes a star
after a number of rounds that grows with the logarithm of its size.  Only minima are gathered at a node, by partial aggregates, and
joins back to the links have an exchange on either side, so that a node with very many links is split.  As soon as FEW links are left, at the start
or after a round, the driver ends it in memory: a table of bounded size takes no more rounds.

Cases: a link with a null end and one of a node with itself are no links; repeated and reversed links count once; an empty table
gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mark, settled, written

MAX_ROUNDS = 100
#: Links that the driver takes at most, 16 bytes each.
FEW = 1 << 19


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (u, v), and the smallest node of its component."""
    nodes, of = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = of[: len(u)], of[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node points at one other, which points nowhere."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id and label (the component's smallest id) of every node that has a link; nodes are longs.  ``links`` is read several times."""
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v")
    begin = mark()
    for _ in range(MAX_ROUNDS):
        few = now.distinct().limit(FEW + 1).toArrow()
        if len(few) <= FEW:
            ids, labels = labels_of(*(few.column(c).to_numpy() for c in ("u", "v")))
            return links.sparkSession.createDataFrame(pa.table({"id": ids, "label": labels}), "id long, label long")
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = settled(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct(), "links", begin)
        if _is_forest_of_stars(now):
            break
    else:
        raise RuntimeError("components: no end after as many rounds as are allowed")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
