import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from quillspark.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("n_words", T.StringType()), ("_copies", T.LongType()))])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def grids(c):
    cut = lambda x: min(max(math.floor(x + 0.5), 0), quality.GRID)
    n, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
    return [cut(512 * math.log(chars / n)), cut(quality.GRID * math.sqrt(c["n_symbols"] / (chars + c["n_symbols"]))), cut(quality.GRID * c["n_dup_lines"] / lines), cut(quality.GRID * c["n_repeat_words"] / n)]


def spread(n):
    """What is added to the variances: the smallest spread, and the prior's documents."""
    floor, prior = (np.array(list(v.values())) ** 2 for v in (quality.FEATURES, quality.PRIOR_SPREAD))
    return floor + prior * quality.PRIOR / (n + quality.PRIOR)


def factor(x):
    n = len(x)
    centre = x.mean(0)
    cov = quality.CONSISTENCY * ((x.T @ x) / n - np.outer(centre, centre)) * n / (n + quality.PRIOR)
    np.fill_diagonal(cov, np.maximum(np.diag(cov), 0) + spread(n))
    return centre, np.linalg.cholesky(cov)


def distances(x, centre, low):
    z = np.linalg.solve(low, (x - centre).T)
    return (z * z).sum(0)


def brute_distances(x):
    x = x.astype(float)
    centre = np.median(x, 0)
    mad = np.median(np.floor(np.abs(x - centre) + 0.5), 0)
    starts = [(centre, np.diag(np.sqrt((1.4826 * mad) ** 2 + spread(len(x))))), factor(x)]
    best = []
    for centre, low in starts:
        for _ in range(quality.STEPS):
            rings = np.floor(quality.RINGS * np.log(distances(x, centre, low) + 1e-6))
            cum = 0
            inside = np.zeros(len(x), bool)
            for r in np.unique(rings):
                if cum < quality.SUPPORT * len(x):
                    inside |= rings == r
                    cum += (rings == r).sum()
            centre, low = factor(x[inside])
        best.append((round(np.log(np.diag(low)).sum(), 9), centre, low))
    _, centre, low = min(best, key=lambda b: b[0])
    return distances(x, centre, low)


def brute(rows):
    out, groups = {}, {}
    for k, (text, lang, source) in rows.items():
        c = counts(text)
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        out[k] = c | {"base_failed": failed, "kept": False}
        if not failed:
            groups.setdefault((lang, source), []).append(k)
    for members in groups.values():
        d = brute_distances(np.array([grids(out[k]) for k in members]))
        for k, x in zip(members, d, strict=True):
            out[k] |= {"kept": bool(x <= quality.LIMIT), "distance": x}
    return out


def compare(got, want):
    for r in got.itertuples():
        w = want[r.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [w[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r.doc_id
        assert r.base_failed == w["base_failed"]
        if not r.base_failed:
            assert r.distance == pytest.approx(w["distance"], rel=1e-3, abs=2e-3)
        assert r.kept == w["kept"]


def test_quality_against_brute_force(spark):
    got = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    want = brute({r.doc_id: (r.text, r.lang, r.source) for r in docs.itertuples()})
    assert len(got) == len(docs)
    compare(got, want)


def test_the_estimate_decides(spark):
    """One document, of longer words, among documents that vary little goes, and stays among documents that vary much."""
    rng, rows = np.random.default_rng(8), []
    for lang, narrow in (("narrow", 0.02), ("wide", 0.9)):
        for i in range(120):
            lengths = np.clip(np.round(rng.normal(5 * math.exp(rng.normal(0, narrow / 3)), 0.3, 400)), 1, 30).astype(int)
            rows.append((len(rows), " ".join(f"{k:x}".zfill(n) for k, n in enumerate(lengths)), lang, "s", 1, "q", 0))
        rows.append((len(rows), " ".join(f"{k:x}".zfill(6) for k in range(400)), lang, "s", 1, "q", 0))
    got = quality.report(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id")
    odd = [120, 241]
    assert got.loc[odd, "kept"].tolist() == [False, True] and got["kept"].drop(odd).mean() > 0.98
    # By the smallest and the prior's spread alone it would stay.
    assert (512 * math.log(6 / 5)) ** 2 / quality.PRIOR_SPREAD["word_length"] ** 2 < quality.LIMIT
    want = brute({r[0]: r[1:4] for r in rows})
    assert all(got.loc[k, "kept"] == w["kept"] for k, w in want.items())


def test_limit_is_a_quantile():
    assert math.exp(-quality.LIMIT / 2) * (1 + quality.LIMIT / 2) == pytest.approx(quality.TAIL, rel=1e-4) and quality.chi_squared_limit(0.05) == pytest.approx(9.4877, abs=1e-3)


def odd_rows():
    clean = " ".join(f"word{i % 97}x{i}" for i in range(120))
    rows = [(i, f"{clean} number {i} and some more words that differ {i * 7}", "en", "s", 1, "q", 0) for i in range(30)]
    return rows + [
        (100, None, "en", "s", 1, "q", 0), (101, "", None, None, 1, "q", 0), (102, " \t\n\x0b\x0c\r ", "en", "s", 1, "q", 0), (103, "a b c d e f g h " * 40, "en", "s", 1, "q", 0),
        (104, "a " * 9, "en", "s", 1, "q", 0), (105, " ".join(f"w{i}###" for i in range(60)), "en", "s", 1, "q", 0), (106, clean, None, "s", 1, "q", 0), (107, clean + "\n" + clean[:200] + " x", None, None, 1, "q", 0),
        (108, " ".join(f"long{i}" for i in range(60000)), "en", "s", 1, "q", 0), (109, "x\ny\nx\n \n \nz " * 3, "en", "s", 1, "q", 0), (105, " ".join(f"w{i}###" for i in range(60)), "en", "s", 1, "q", 0),
    ]


def test_quality_of_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.report(docs).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        c = counts(text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r.doc_id
    kept = set(got[got["kept"]]["doc_id"])
    assert set(range(30)) <= kept and 105 not in kept and not {100, 101, 102, 103, 104} & kept
    stage = quality.keep_good(docs)
    assert stage.columns == docs.columns and stage.count() == int(got["kept"].sum())
    assert quality.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_against_sql(spark):
    got = queries.op9_source_mix(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()  # noqa: F841
    want = duckdb.sql(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert got[["doc_id", "size", "source_size", "taken"]].equals(want[["doc_id", "size", "source_size", "taken"]])
    np.testing.assert_allclose(got["target"], want["target"], rtol=1e-12)


def water(sizes, weights, most=3):
    """Targets by resharing again and again."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > most * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                out[i] = share * weights[i]
            return out
        for i in over:
            out[i] = most * sizes[i]
        open_ -= over
    return out


def test_mix_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", s, 1, "q", 0) for i, s in enumerate(["b"] * 5 + ["a"] * 400 + [None] * 30 + ["c"] * 2 + ["é"] * 3)]
    rows += [(7, "same text here", "en", "a", 1, "q", 0)] * 5 + [(8, None, None, "d", 1, "q", 0), (None, "x y z", None, "a", 1, "q", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.report(docs).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    names = sorted((s for s in by if s is not None)) + [None]
    want = water([by[s] for s in names], [k % 3 + 1 for k in range(len(names))])
    of = {s: w for s, w in zip(names, want, strict=True)}
    assert sorted({round(t, 6) for t in got["target"]}) == sorted({round(t, 6) for t in of.values()})
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    for s in ("a", None, "b"):
        mine = got[[source.get(d, "a") == s if d == d else s == "a" for d in got["doc_id"]]]
        assert abs(mine["taken"].sum() - of[s]) <= 2 * 60
    again = mixing.report(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert abs(words - got["taken"].sum()) <= 3 * 5 * 3
    assert mixing.report(spark.createDataFrame([], SCHEMA)).count() == 0
