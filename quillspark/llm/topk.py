"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size, queries into blocks; both are packed into one row each.  Every
query first meets the longest vectors, which gives it a threshold: its k-th score so far.  Of all other cells (block, bucket) those
stay whose largest possible score reaches a threshold of the block.  In a cell, each query has a local cosine threshold, its threshold
over the product of lengths: above one the bucket is passed, high ones prune by the coordinates in which the query is large,
low ones by the vectors' lengths alone.  What is left is verified by exact products, which are integers.

Nothing grows with the data in one task or on the driver but the number of buckets' cells; the queries are a stated set in blocks.

Cases: null vectors, and those with a null or non-finite component, take no part; vectors meet those of their own dimension;
a query's own row is no candidate, another row with its id is; ties go to the smaller vec_id, null last; equal rows of a common
vector are dealt by hash, so a bucket never grows; fewer than k candidates are all returned; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

SCALE, EVERY, K = 64, 20, 20
BUCKET, BLOCK = 2048, 1024
#: Buckets of the longest vectors that every query meets first.
SEEDS = 2
#: Local cosine thresholds from which coordinates are used, and how many.
COORDINATE_FROM, FOCUS = 0.5, 4
NO_ID = np.iinfo(np.int64).max

PACKED = "dim int, part long, size int, longest double, uids binary, ids binary, lengths binary, values binary"
FOUND = "block long, place int, uid long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, v (integers as doubles), dim and length of every whole, finite vector."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).withColumn("dim", F.size("v"))
    return written(rows, "vectors").withColumn("uid", F.monotonically_increasing_id())


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each (dim, part): its vectors by decreasing length."""

    def make(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        uids, dim = table.column("uid").to_numpy(), table.column("dim")[0].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), dim)
        order = np.lexsort((uids, -lengths))
        row = (dim, table.column("part")[0].as_py(), len(table), float(lengths.max()), uids[order].tobytes(), ids[order].tobytes(), lengths[order].tobytes(), _stored(values[order]))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
        return pa.table({f.split()[0]: pa.array([v], k) for f, v, k in zip(PACKED.split(", "), row, kinds, strict=True)})

    return rows.select("uid", "vec_id", "v", "length", "dim", "part").groupBy("dim", "part").applyInArrow(make, PACKED)


def _stored(values: np.ndarray) -> bytes:
    """Integers in four bytes where they fit, else in eight."""
    small = values.astype(np.float32)
    return b"4" + small.tobytes() if np.array_equal(small, values) else b"8" + values.tobytes()


def _loaded(data: bytes, size: int) -> np.ndarray:
    kind = np.float32 if data[:1] == b"4" else np.float64
    return np.frombuffer(data, kind, offset=1).reshape(size, -1).astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of ``a`` with rows of ``b``."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return exact.astype(np.int64)  # raises if a score is no long


def candidates(q: np.ndarray, q_length: float, threshold: float, v: np.ndarray, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places in a bucket (by decreasing length) whose product with ``q`` may reach ``threshold``: a superset."""
    if threshold == -np.inf or q_length == 0:
        return np.arange(len(v)) if threshold <= 0 else np.empty(0, np.int64)
    slack = 1e-9 * (1 + abs(threshold))
    if threshold <= 0:  # short vectors may reach it as well
        return np.arange(len(v))
    upto = int(np.searchsorted(-lengths, -(threshold - slack) / q_length, "right"))
    if not upto:
        return np.empty(0, np.int64)
    local = (threshold - slack) / (q_length * lengths[0])
    if local < COORDINATE_FROM:
        return np.arange(upto)
    # A unit vector at a cosine of ``local`` or more lies, in each coordinate, in a known range around the query's.
    local = min(local, 1.0)
    own = q / q_length
    focus = np.argsort(-np.abs(own))[:FOCUS]
    spread = np.sqrt((1 - local**2) * (1 - own[focus] ** 2)) + 1e-9
    low, high = own[focus] * local - spread, own[focus] * local + spread
    low = np.where(own[focus] < -local, -1.0, low)  # beyond the threshold's cap the range reaches the pole
    high = np.where(own[focus] > local, 1.0 + 1e-9, high)
    part = unit[:upto, focus]
    return np.flatnonzero(((part >= low) & (part <= high)).all(1))


def _search(k: int):
    """From cells (a block's and a bucket's columns, thresholds or null) to the best candidates of each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                q, v = _loaded(cell["q_values"], cell["q_size"]), _loaded(cell["values"], cell["size"])
                q_uids, uids, ids = (np.frombuffer(cell[n], np.int64) for n in ("q_uids", "uids", "ids"))
                q_lengths, lengths = np.frombuffer(cell["q_lengths"], np.float64), np.frombuffer(cell["lengths"], np.float64)
                thresholds = np.full(len(q), -np.inf)
                for t in cell["thresholds"] or []:
                    thresholds[t["place"]] = t["score"]
                unit = v / np.maximum(lengths, 1e-300)[:, None]
                out = []
                for at in range(0, len(q), 64):  # a bounded block of products
                    maybe = [candidates(q[i], q_lengths[i], thresholds[i], v, unit, lengths) for i in range(at, min(at + 64, len(q)))]
                    every = np.unique(np.concatenate(maybe))
                    if not len(every):
                        continue
                    scores = _products(q[at : at + 64], v[every])
                    for i, some in enumerate(maybe):
                        here = np.searchsorted(every, some)
                        good = (scores[i, here] >= thresholds[at + i]) & (uids[some] != q_uids[at + i])
                        some, score = some[good], scores[i, here[good]]
                        best = np.lexsort((uids[some], ids[some], -score))[:k]
                        out += [(cell["block"], at + i, int(uids[some[b]]), None if ids[some[b]] == NO_ID else int(ids[some[b]]), int(score[b])) for b in best]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def top_k(embeddings: DataFrame, is_query, k: int = K, scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query row."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, scale)
    # Bands of length, a quarter of an octave each: their counts are a few hundred numbers a dimension.
    banded = vectors.withColumn("band", F.floor(4 * F.log2(F.greatest("length", F.lit(0.5)))).cast("int"))
    counts = banded.groupBy("dim", "band").agg(F.count("*").alias("n")).select("dim", "band", F.ceil(F.col("n") / bucket).alias("chunks"))
    chunked = banded.join(F.broadcast(counts), ["dim", "band"])
    parted = chunked.withColumn("part", (F.col("band").cast("long") + 10_000) * (1 << 40) + F.pmod(F.xxhash64("uid"), F.col("chunks")))
    buckets = written(_packed(parted), "buckets")
    asked = vectors.where(is_query)
    blocks = max(1, math.ceil(asked.count() / block))
    asked = written(_packed(asked.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("long"))), "queries")
    asked = asked.select("dim", F.col("part").alias("block"), F.col("size").alias("q_size"), F.col("longest").alias("q_longest"), F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("lengths").alias("q_lengths"), F.col("values").alias("q_values"))

    facts = buckets.select("dim", "part", "longest").withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "part")))
    facts = written(facts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), "cells")

    def cells(of: DataFrame, limits: DataFrame | None) -> DataFrame:
        full = of.join(buckets.drop("longest"), ["dim", "part"]).join(asked, ["dim", "block"])
        kind = "array<struct<place:int,score:long>>"
        full = full.join(limits, ["dim", "block"], "left") if limits is not None else full.withColumn("thresholds", F.lit(None).cast(kind))
        return full.select("block", "q_size", "q_uids", "q_lengths", "q_values", "size", "uids", "ids", "lengths", "values", "thresholds").mapInArrow(_search(k), FOUND)

    own = Window.partitionBy("block", "place", "dim").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    dims = [r[0] for r in asked.select("dim").distinct().collect()]
    parts = []
    for d in dims:  # one, unless vectors of several dimensions share a table
        first = written(cells(facts.where((F.col("dim") == d) & (F.col("place") <= SEEDS)).drop("place"), None).withColumn("dim", F.lit(d)), "first")
        kth = first.withColumn("r", F.row_number().over(own)).where(F.col("r") == k).groupBy("dim", "block").agg(F.collect_list(F.struct("place", "score")).alias("thresholds"), F.min("score").alias("least"), F.count("*").alias("known"))
        limits = written(kth, "limits")
        rest = facts.where((F.col("dim") == d) & (F.col("place") > SEEDS)).drop("place").join(limits.drop("thresholds"), ["dim", "block"], "left")
        rest = rest.join(asked.select("dim", "block", "q_longest", "q_size"), ["dim", "block"])
        # Passed as a whole: cells whose longest query and longest vector stay under every threshold of the block.
        reach = (F.col("known") < F.col("q_size")) | F.col("known").isNull() | (F.col("least") <= 0) | (F.col("q_longest") * F.col("longest") * (1 + 1e-9) >= F.col("least"))
        more = cells(rest.where(reach).select("dim", "part", "block", "longest"), limits.select("dim", "block", "thresholds")).withColumn("dim", F.lit(d))
        parts.append(first.unionByName(more))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                yield pa.record_batch([pa.array([r["dim"]] * len(ids), pa.int32()), pa.array([r["block"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64())], names=["dim", "block", "place", "query_id"])

    named = asked.select("dim", "block", "q_ids").mapInArrow(names, "dim int, block long, place int, query_id long")
    return best.join(named, ["dim", "block", "place"]).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings.select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


# The same in SQL, over a table embeddings whose ids are distinct.
ORACLE = f"""
with sound as (
  select vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), scored as (
  select q.vec_id as query_id, p.vec_id, list_inner_product(q.v, p.v)::bigint as score
  from sound q join sound p on q.vec_id <> p.vec_id and len(q.v) = len(p.v) where q.vec_id % {EVERY} = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored
qualify row_number() over (partition by query_id order by score desc, vec_id) <= {K}
"""
