import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import components, linking, queries, setjoin, shingles

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("id", T.StringType()), ("th", T.LongType()))])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """component of each row index."""
    sets = [word_set(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    held = {}
    for i, s in enumerate(sets):
        for w in s:
            held.setdefault(w, []).append(i)
    pairs = {(a, b) for v in held.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
            of[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), (least.get(find(i)) if sets[i] else d) if d is not None or sets[i] else None) for i, (d, _) in enumerate(rows))


def compare(spark, rows):
    got = setjoin.report(spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, ((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(key, brute(rows)))


def test_words_and_shingles_are_those_of_the_pattern():
    texts = ["", " a  b\tc\nd\x0be\x0cf\rg ", "É é Ab aB", "x" * 5000 + " y", "a b c d e f a b c d e f", None, "\x1c\x85 \xa0"]
    for t, tokens in zip(texts, shingles.token_sets([t and t.encode() for t in texts]), strict=True):
        assert len(tokens) == len(word_set(t))
        data = np.frombuffer((t or "").encode(), np.uint8)
        start, end, _ = shingles.word_hashes(data, True)
        assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == WORD.findall(t or "")
    a, b = list(shingles.token_sets([b"Q r S t u V", b"z q R s T U v"]))
    assert len(np.intersect1d(a, b)) == 2


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in docs])
    got = queries.op10_ngram_jaccard_join(spark, "/root/testdata/sf0.01").collect()
    assert sorted(tuple(r) for r in got) == want


def test_against_brute_force_on_planted_groups(spark):
    rnd = random.Random(1)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for n in (8, 20, 60, 200):
        base = [word() for _ in range(n)]
        for k in range(40):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3]) * n // 40 + rnd.randrange(2)):
                t[rnd.randrange(n)] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + k, " ".join(passage + [word() for _ in range(rnd.choice([3, 8, 14, 30, 100]))])) for k in range(60)]
    rows += [(2000 + k, "Same text HERE of nine words to be copied") for k in range(30)] + [(2100, "same text here of nine words to be COPIED")]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "One  two"), (3005, "two one"), (None, "one two"), (None, None), (3003, "one two"), (3006, "long " + " ".join(f"l{i}" for i in range(40000)))]
    compare(spark, rows)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x", 1), (3, "a b c d e f g", "y", 2), (3, "a b c d e f g", "y", 2), (9, "other words in this one here", "z", 3), (7, None, "n", 4), (8, "", "n", 4), (None, "A b c d e f g", "k", 5), (None, "quite another text without an id here", "k", 6), (None, "and one more that is not like it", "k", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = setjoin.keep_one(docs)
    assert got.columns == docs.columns
    left = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(left) == 6 and sum(r[0] is None for r in left) == 2 and {r[0] for r in left} >= {7, 8, 9}
    assert setjoin.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0 and setjoin.report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(100, 101), (101, -7)]])
def test_components(spark, links):
    of = {x: x for p in links for x in p}
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    got = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(of.items())


def test_links_without_ends_or_rows(spark):
    links = [(1, 2), (None, 3), (4, None), (5, 5), (2, 1), (1, 2)]
    assert sorted(map(tuple, components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())) == [(1, 1), (2, 1)]
    none = spark.createDataFrame([], "key long, gid long, n long, pos long, far long")
    sets = lambda ids: ids.select("id").withColumn("tokens", F.lit(b"")).where("false")
    assert linking.link(none, None, sets).count() == linking.link(none, spark.createDataFrame([], "gid long, id long"), sets).count() == 0


def test_packed_tokens_come_back():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (3, 70_000, 1)]
    sets.append(sets[1][:500])
    columns = linking.packed(np.array([7, -8, 9, 10]), np.array([len(s) for s in sets]), np.concatenate(sets), 5)
    table, found = pa.table(columns), {}
    for b in range(5):
        own, keys, counts, again = linking.shared(table.filter(pc.equal(table.column("bucket"), b)))
        assert (counts == 2).all() and not len(again)
        for i, k in zip(own.tolist(), keys.tolist(), strict=True):
            found.setdefault(k, set()).add(i)
    assert len(found) == 500 and all(v == {-8, 10} for v in found.values())
    assert not len(linking.packed(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), 5)["ids"])


def test_components_in_memory_and_by_rounds_agree(spark, monkeypatch):
    rnd = random.Random(3)
    links = [(rnd.randrange(400) - 200, rnd.randrange(400) - 200) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 5), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    memory = sorted(map(tuple, components.components(df, "a", "b").collect()))
    monkeypatch.setattr(components, "FEW", 3)
    assert memory == sorted(map(tuple, components.components(df, "a", "b").collect())) and len(memory) > 100


def test_rarest_tokens_are_ranked_without_a_row_for_each_token(spark):
    rnd = random.Random(21)
    common = [rnd.getrandbits(64) for _ in range(30)]
    sets = {(-1) ** k * (k + 5): sorted({*rnd.sample(common, rnd.randrange(1, 30)), *(rnd.getrandbits(64) for _ in range(rnd.randrange(9)))}) for k in range(120)}
    df = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in sets.items()], "id long, tokens binary")
    got = linking.by_rarest(df, 80)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan.replace("FlatMapCoGroups", "")
    held = {}
    for s in sets.values():
        for t in s:
            held[t] = held.get(t, 0) + 1
    lists, rows = {}, got.collect()
    for r in rows:
        lists.setdefault(r.key, set()).add(r.gid)
    for i, s in sets.items():
        pos = sorted(r.pos for r in rows if r.gid == i)
        alone, prefix = sum(held[t] == 1 for t in s), len(s) - -(-80 * len(s) // 100) + 1
        assert pos == list(range(alone, max(alone, min(prefix, len(s)))))
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len({*sets[a]} & {*sets[b]})
            if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                assert any({a, b} <= x for x in lists.values())
    assert linking.by_rarest(df.limit(0), 80).count() == 0


def test_filters_before_joins_pass_few_others(spark):
    """With 200,000 keys, the filter of 2**18 slots passed half of the others."""
    from quillspark.llm import common

    ids = spark.range(200_000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("d"))
    rows = ids.union(spark.range(1_000_000, 1_100_000).select("id", F.lit(None).cast("long")))
    assert 200_000 <= common.likely_in(rows, ["k", "d"], ids).count() < 205_000
    told = common.told_apart(rows, ["k", "d"], ids)
    assert told.count() == 300_000 and told.where("_in and k < 1000000").count() == 200_000


@pytest.mark.parametrize("grouped", [False, True])
def test_long_lists_take_one_more_step_of_stars(spark, monkeypatch, grouped):
    """Each further star was a step of its own, with all rows of the lists joined by key again."""
    rnd = random.Random(5)
    texts = {k: range(k, k + 40) for k in range(150)} | {k: range(1000 * k, 1000 * k + 40) for k in range(200, 230)}
    lists = {k: {k, k + 1} for k in range(10)} | {key: {200, *range(11), *(k for k in texts if rnd.random() < 0.6)} for key in range(300, 310)}
    sets = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in texts.items()], "id long, tokens binary")
    postings = spark.createDataFrame([(key, i, 40, None, -i) for key, held in lists.items() for i in held], "key long, gid long, n long, pos long, far long")
    of = {k: k for k in texts}
    for a, b in sorted((a, b) for a in texts for b in texts if a < b <= a + 4 and any({a, b} <= x for x in lists.values())):
        least, most = sorted((of[a], of[b]))
        of = {k: least if v == most else v for k, v in of.items()}
    steps, rows = [], []
    real, written = linking.verified, linking.written

    def kept(df, what):
        out = written(df, what)
        if what == "outside":
            rows.append(out.count())
            assert out.where("comp = major").isEmpty()
        return out

    monkeypatch.setattr(linking, "verified", lambda *x: steps.append(1) or real(*x))
    monkeypatch.setattr(linking, "written", kept)
    members = postings.select("gid", F.col("gid").alias("id")).distinct() if grouped else None
    got = linking.link(postings, members, lambda ids: sets.join(ids, "id"), 80).collect()
    assert sorted(map(tuple, got)) == [(k, v) for k, v in sorted(of.items()) if k < 200 and list(of.values()).count(v) > 1]
    assert len(steps) == 3 and len(rows) == 2 and sum(rows) < 2 * postings.count()


def test_prefixes_by_hash_share_what_similar_sets_have_to():
    """Every pair of similar sets, of any sizes, shares at least as much of the prefixes as a class has to, to be kept."""
    rnd = random.Random(8)
    for percent in (80, 50, 95):
        for _ in range(3000):
            n = rnd.choice([1, 2, 3, 5, 9, 20, 21, 60, 301])
            both = rnd.randrange(1, n + 1)
            m = rnd.randrange(both, max(both, 100 * both // percent) + 1)
            tokens = rnd.sample(range(10**6), n + m - both)
            x, y = sorted(tokens[:n]), sorted([*tokens[:both], *tokens[n:]])
            if 100 * both < percent * len({*x, *y}):
                continue
            sizes = np.array([len(x), len(y)])
            p, q = setjoin.prefix(sizes, percent).tolist()
            assert p <= len(x) and q <= len(y) and len({*x[:p]} & {*y[:q]}) >= setjoin.least(sizes, percent).max()


def test_only_sets_that_may_be_similar_are_shuffled_whole(spark, monkeypatch):
    """All shingles of all sets were shuffled at once; now a quarter is, and a passage that is a tenth of its texts makes them meet no further."""
    rnd = random.Random(13)
    word = lambda: f"w{rnd.getrandbits(40)}"
    passage, base = [word() for _ in range(40)], [word() for _ in range(400)]
    rows = [(k, " ".join([*passage, *(word() for _ in range(360))])) for k in range(60)]
    rows += [(100, " ".join(base)), (101, " ".join([*base[:390], *(word() for _ in range(10))])), (102, " ".join(base))]
    sizes = np.array([len(word_set(t)) for _, t in rows])
    assert setjoin.prefix(sizes, 80).sum() < 0.27 * sizes.sum()
    kept, written = [], setjoin.written

    def seen(df, what):
        out = written(df, what)
        if what == "alike":
            kept.extend(out.collect())
        return out

    monkeypatch.setattr(setjoin, "written", seen)
    compare(spark, rows)
    assert len(kept) == 2 and all(r.n == 396 for r in kept)
