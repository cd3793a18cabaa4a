import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import queries, topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType()), T.StructField("length", T.StringType())])


def brute(rows, every=20, k=20):
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            best = sorted(((-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(whole) if a != b and len(v) == len(q)))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "v", "l") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **kw).collect()), key=str)


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_exact_top_k(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(rows)


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_many_buckets_and_ties(spark, spread):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6))
    base[100:180] = base[100]  # a common vector
    base[200:230] = np.round(base[200:230])
    base *= np.exp(spread * rng.normal(size=(400, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    assert run(spark, rows, bucket=32, block=7) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [3.0, -1.0]), (2, [-3.0, -1.0]), (None, [2.0, 2.0]), (100, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (0, [1.0, 2.0]), (120, []), (140, [1e7, 1e7])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_pruning_keeps_every_candidate():
    rng = np.random.default_rng(1)
    v = np.floor(64 * rng.normal(size=(500, 8)))
    lengths = np.linalg.norm(v, axis=1)
    order = np.argsort(-lengths)
    v, lengths = v[order], lengths[order]
    fewer = 0
    for q in np.floor(64 * rng.normal(size=(100, 8))):
        scores = v @ q
        for t in (-5.0, 0.0, *np.quantile(scores, [0.5, 0.95, 0.99, 1.0])):
            some = topk.candidates(q, np.linalg.norm(q), t, v, v / lengths[:, None], lengths)
            assert set(np.flatnonzero(scores >= t)) <= set(some)
            fewer += len(some) < 500
    assert fewer > 100
