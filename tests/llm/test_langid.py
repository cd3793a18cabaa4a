import itertools
import warnings
import zlib

import numpy as np
from pyspark.sql import types as T

from quillspark.llm import langid, queries

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.StringType()))])


def test_held_out_accuracy(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (both["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in both["doc_id"]]).all()
    mine = both[both["held_out"]]
    assert (mine["lang_pred"] == mine["lang"]).mean() >= 0.98


def test_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, logs = langid.fit(docs)
    of = {n: " ".join(r.text for r in docs.where(f"lang = '{n}' and n_chars between 1500 and 4000").orderBy("doc_id").limit(2).collect()) for n in names}
    a, b = of[names[0]].split()[:300], of[names[1]].split()[:100]
    text = " ".join(a + b).encode()
    share = langid.mixtures(*langid.word_likelihoods([text, " ".join(a).encode()], logs))
    assert set(np.flatnonzero(share[0])) == {0, 1} and abs(share[0][0] - 0.75) < 0.15
    assert set(np.flatnonzero(share[1])) == {0} and share[1][0] == 1


def test_steps_do_not_change_the_answer(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, logs = langid.fit(docs)
    texts = [r.text.encode() for r in docs.limit(30).collect()]
    whole = langid.mixtures(*langid.word_likelihoods(texts, logs))
    for t, want in zip(texts, whole, strict=True):
        np.testing.assert_allclose(langid.mixtures(*langid.word_likelihoods([t], logs))[0], want, atol=1e-4)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "s")] * 3 + [(k, "le chat et le chien", "fr", "s") for k in range(2, 12)] + [(20, None, "en", "s"), (21, "", "fr", None), (22, "12 34 !!", "en", "s"), (23, "…—", "en", "s"), (24, "ÉTÉ 中文", None, "s"), (None, "le chien", None, "s"), (25, "chat " * 50000, None, "s")]
    got = langid.report(spark.createDataFrame(rows, SCHEMA)).collect()
    of = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and all(of[k] == ("und", 0.0) for k in (20, 21, 22, 23))
    assert of[25][0] == "fr" and of[None][0] == "fr" and of[24][0] in ("en", "fr") and of[1][0] == "en"
    unlabelled = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.report(unlabelled).collect()] == [("und", 0.0)]
    assert langid.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_many_languages():
    words = np.full((700, 8), -20, np.float32)
    words[np.arange(700), np.repeat(np.arange(7), 100)] = 0
    share = langid.mixtures(words, np.array([600, 100]))
    assert set(np.flatnonzero(share[0])) == set(range(6)) and np.allclose(share[0][:6], 1 / 6, atol=0.01)
    assert set(np.flatnonzero(share[1])) == {6}


def brute(words):
    """Of one text, the proportions of the best set of languages by penalised likelihood: every set is tried, by plain EM in logarithms."""
    n, k = words.shape
    best = (-np.inf, None)
    for size in range(1, k + 1):
        for some in itertools.combinations(range(k), size):
            own, share = words[:, some], np.full(size, 1 / size)
            for _ in range(3000):
                joint = own + np.log(np.maximum(share, 1e-300))
                joint -= np.logaddexp.reduce(joint, axis=1)[:, None]
                share = np.exp(joint).mean(0)
            value = np.logaddexp.reduce(own + np.log(np.maximum(share, 1e-300)), axis=1).sum() - langid.PENALTY * np.log(n + 1) * (size - 1)
            if value > best[0] + 1e-9:
                best = (value, {i: p for i, p in zip(some, share, strict=True)})
    return np.array([best[1].get(i, 0.0) for i in range(k)])


def test_mixtures_against_brute_force():
    rng = np.random.default_rng(3)
    texts = []
    for gap in (2.0, 6.0, 20.0, 200.0, 650.0, 5000.0):
        for parts in ((30, 30, 30), (90, 0, 0), (50, 40, 0), (0, 1, 20), (60, 20, 10), (1, 0, 0)):
            of = np.repeat(np.arange(3), parts)
            words = -gap + rng.normal(0, gap / 20, (len(of), 3)) - 30
            words[np.arange(len(of)), of] += gap
            texts.append(words)
    texts += [np.zeros((12, 3)), np.full((5, 3), -1e4)]  # ties go to the first language
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = langid.mixtures(np.concatenate(texts).astype(np.float32), np.array([len(t) for t in texts]))
    for words, have in zip(texts, got, strict=True):
        np.testing.assert_allclose(have, brute(words.astype(np.float32).astype(np.float64)), atol=0.02)
    assert langid.mixtures(np.empty((0, 3), np.float32), np.zeros(2, np.int64)).tolist() == [[0.0] * 3] * 2
