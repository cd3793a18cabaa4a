import zlib

import numpy as np
from pyspark.sql import types as T

from quillspark.llm import queries, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("unit", T.StringType()), ("size", T.LongType()))])


def best_capacity(sizes, shards):
    """Minimax by dynamic programming."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    best = upto.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[i], upto[j] - upto[i]) for i in range(j + 1)) for j in range(len(upto))])
    return best[-1]


def test_capacity_against_dynamic_programming():
    rng = np.random.default_rng(0)
    for n, shards in ((1, 3), (5, 3), (12, 4), (40, 7), (30, 1)):
        for _ in range(10):
            sizes = rng.integers(1, 50, n).tolist()
            assert sharding.smallest_capacity(sizes, shards) == best_capacity(sizes, shards)
    assert sharding.smallest_capacity([], 3) == 0


def hidden(groups, digits):
    """Cells of so many digits over groups (digest, size), and what refines them."""

    def cells(some, digits):
        of = {}
        for d, w in some:
            of.setdefault(d[:digits], []).append(w)
        return [sharding.Cell(p, sum(w), len(w), len(w) == 1) for p, w in sorted(of.items())]

    return cells(groups, digits), lambda prefixes, digits: cells([g for g in groups if g[0].startswith(tuple(prefixes))], digits)


def test_cells_give_the_cuts_of_the_groups():
    rng = np.random.default_rng(1)
    for n, shards, hot in ((3, 5, 0), (60, 4, 0), (400, 6, 0), (400, 9, 1), (400, 9, 3), (2000, 24, 2), (500, 1, 1)):
        for _ in range(6):
            digests = sorted({"".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(n)})
            sizes = rng.integers(1, 60, len(digests))
            sizes[rng.choice(len(sizes), hot, replace=False)] = sizes.sum() // 3
            groups = list(zip(digests, sizes.tolist(), strict=True))
            got, ends = sharding.refined(*(lambda c, f: (c, shards, f))(*hidden(groups, 1)))
            whole = sharding.plan([sharding.Cell(d, w, 1, True) for d, w in groups], shards)
            bounds = [got[e].prefix if e < len(got) else "g" for e in ends]
            place = lambda d, b: sum(d >= x for x in b)
            exact = [digests[e] if e < len(digests) else "g" for e in whole.ends]
            assert [place(d, bounds) for d in digests] == [place(d, exact) for d in digests]
            loads = np.bincount([place(d, bounds) for d in digests], weights=sizes, minlength=shards)
            assert len(loads) == shards and loads.max() == best_capacity(sizes.tolist(), shards)
            if hot and shards > hot + 1:
                assert len(ends) >= shards - hot - 1  # a hot group does not leave the others' shards empty


def check(got, rows, shards=24):
    assert sorted(got["doc_id"].fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in rows)
    of = {}
    for r in got.itertuples():
        text = {x[1] or "" for x in rows if x[0] == r.doc_id or (x[0] is None and r.doc_id != r.doc_id)}
        assert any(r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) for t in text)
        of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got["shard"].between(0, shards - 1).all() and got["grown_shard"].isna().all()


def test_shards_of_documents(spark):
    got = queries.op6_sharding(spark, "/root/testdata/sf0.01").toPandas()
    check(got, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() <= 1.5 * sizes.mean()


def test_shards_of_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "same", "a", 1), (4, "same", "a", 1), (4, "same", "a", 1), (None, "é", None, None), (5, "long " * 50000, "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for law in ("bytes", "rows"):
        check(sharding.shard(docs, 3, law).toPandas(), rows, 3)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
