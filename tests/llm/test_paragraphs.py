import hashlib
import random
import re

from pyspark.sql import types as T

from quillspark.llm import paragraphs, queries

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_chars", T.LongType()), ("gone", T.StringType()), ("th", T.StringType()))])
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK, REACH = paragraphs.BLOCK, paragraphs.REACH


def units(text):
    """(first word, number of words) of each paragraph, those that are no blocks, and the words."""
    data = (text or "").encode()
    words = [m.group().translate(LOWER) for m in WORD.finditer(data)]
    out, at = set(), 0
    for line in data.split(b"\n"):
        n = len(WORD.findall(line))
        if n >= BLOCK:
            out.add((at, n))
        at += n
    if 0 < len(words) < BLOCK:
        out.add((0, len(words)))
    banded = set(out)
    digest = [(hashlib.md5(w).digest()[:4], i) for i, w in enumerate(words)]
    places = len(words) - BLOCK + 1
    for i in range(places - REACH + 1 if places > REACH else min(1, max(0, places))):
        out.add((min(digest[i : min(i + REACH, places)])[1], BLOCK))
    return sorted(out), banded, words


def brute(rows):
    """doc_id to its stretches (first word, behind the last, document where they stay); documents with different ids."""
    where, sets, texts, near = [], [], {}, set()
    for d, t in rows:
        found, banded, texts[d] = units(t)
        for p, n in found:
            where.append((d, p, n))
            near |= {len(sets)} if (p, n) in banded else set()
            sets.append(frozenset(tuple(texts[d][i : i + min(n, 5)]) for i in range(p, p + max(1, n - 4))))
    of = list(range(len(sets)))

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    held, equal = {}, {}
    for i, s in enumerate(sets):
        of[find(i)] = find(equal.setdefault(s, i))
    for i in {find(i) for i in near}:
        for w in sets[i]:
            held.setdefault(w, []).append(i)
    for v in held.values():
        for k, a in enumerate(v):
            for b in v[k + 1 :]:
                if 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) and find(a) != find(b):
                    same = len(sets[a] & sets[b])
                    if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                        of[find(a)] = find(b)
    clusters, out = {}, {}
    for i, w in enumerate(where):
        clusters.setdefault(find(i), []).append(w)
    for c in clusters.values():
        kd, kp, kn = min(c)
        for d, p, n in c:
            if d == kd and p < kp + kn:
                continue
            a, x = p, kp
            while p - a < REACH - 1 and a > 0 and x > 0 and (d != kd or a > kp + kn) and texts[d][a - 1] == texts[kd][x - 1]:
                a, x = a - 1, x - 1
            b, x = p + n, kp + kn
            while b - p - n < REACH - 1 and b < len(texts[d]) and x < len(texts[kd]) and texts[d][b] == texts[kd][x]:
                b, x = b + 1, x + 1
            out.setdefault(d, []).append((a, b, kd))
    return {d: merge(sorted(x)) for d, x in out.items()}


def merge(stretches):
    out = []
    for a, b, kd in stretches:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kd))
    return out


def compare(got, rows, tolerance=0.0):
    texts, want, have = {d: (t or "").encode() for d, t in rows}, brute(rows), {}
    for r in got:
        data = texts[r.doc_id]
        a = len(WORD.findall(data[: r.begin_byte]))
        assert WORD.match(data, r.begin_byte).start() == r.begin_byte and len(WORD.findall(data[r.begin_byte : r.end_byte])) == r.n_words
        have.setdefault(r.doc_id, []).append((a, a + r.n_words, r.kept_doc_id))
    spans = lambda of: {(d, a, b) for d, x in of.items() for a, b, _ in x}
    assert len(spans(have) ^ spans(want)) <= tolerance * len(spans(want))
    return have


def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    compare(queries.op1_substring_dedup(spark, "/root/testdata/sf0.01").collect(), rows, 0.003)


def runs(text, n=50):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_no_run_of_50_words_stays_in_two_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shared = lambda texts: [r for r, c in count(texts).items() if c > 1]

    def count(texts):
        out = {}
        for t in texts:
            for r in runs(t):
                out[r] = out.get(r, 0) + 1
        return out

    before, after = shared(r.text for r in docs.collect()), shared(r.text for r in paragraphs.strip(docs).collect())
    assert len(before) > 10_000 and not after


def line(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def planted():
    """Passages of over 50 words: lines of their own, inside of longer lines, across line ends, and with a word changed."""
    rnd = random.Random(4)
    shared = [line(rnd, rnd.randrange(51, 90)) for _ in range(6)]
    rows = []
    for d in range(120):
        lines = [line(rnd, rnd.randrange(5, 80)) for _ in range(5)]
        for p in rnd.sample(shared, rnd.randrange(3)):
            words = p.split()
            kind = rnd.randrange(4)
            if kind == 0:
                words[rnd.randrange(len(words))] = "changed"
            k = rnd.randrange(len(lines))
            if kind == 1:
                lines[k] = f"{lines[k]} {p.upper()} {line(rnd, rnd.randrange(1, 40))}"
            elif kind == 2:
                lines[k : k + 1] = [f"{lines[k]} {' '.join(words[:7])}", *(" ".join(words[i : i + 12]) for i in range(7, len(words), 12))]
            else:
                lines.insert(k, " ".join(words))
        rows.append((d, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, shared[0]), (504, "short line"), (505, "short line"), (506, line(rnd, 30000) + "\n" + shared[1] + "\n" + shared[1]), (507, "again " * 400), (508, "a b c d e f g " * 60)]
    return rows, shared


def test_planted_passages(spark):
    rows, shared = planted()
    docs = spark.createDataFrame([(d, t, 1, "g", "t") for d, t in rows], SCHEMA)
    got = compare(paragraphs.report(docs).collect(), rows)
    left = paragraphs.strip(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    passages = set().union(*map(runs, shared))
    holders = [d for d, t in rows if d in texts and runs(texts[d]) & passages]
    assert len(holders) <= len(shared) and all(runs(t) & passages for d, t in rows if d in holders)
    for d, t in rows:
        words = [w for k, w in enumerate(WORD.findall((t or "").encode())) if not any(a <= k < b for a, b, _ in got.get(d, ()))]
        if d not in got:
            assert texts[d] == t
        else:
            assert (d in texts) == bool(words) and WORD.findall((texts.get(d) or "").encode()) == words
    assert all(r.n_chars == len(r.text) for r in left.where("doc_id = 506").collect()) and 503 not in texts and texts[502] == "\n\n"


def test_what_is_left_of_lines():
    cut = lambda text, a, b: paragraphs.without(text, [{"a": a, "b": b, "kd": 1}])
    assert cut("a b c\nd e\nf g", 3, 5) == "a b c\nf g" and cut("a b c\nd e\nf g", 4, 6) == "a b c\nd g"
    assert cut("a b c", 0, 3) == "" and cut("a b\n c d ", 2, 4) == "a b" and cut("a b  c", 1, 2) == "a c"
    assert paragraphs.without("a b\nc d\ne é", [{"a": 0, "b": 1, "kd": 1}, {"a": 2, "b": 4, "kd": 1}]) == "b\ne é"


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, text, 1, "g", "t")] * 3 + [(None, text, 1, "g", "t"), (2, text.upper(), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = paragraphs.report(docs).collect()
    assert len(got) == 4 and {r.kept_doc_id for r in got} == {None} and {r.n_words for r in got} == {40}
    assert paragraphs.strip(docs).count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert paragraphs.report(empty).count() == 0 and paragraphs.strip(empty).count() == 0


def test_bands_reach_the_recall():
    assert (1 - 0.8**paragraphs.ROWS) ** paragraphs.bands() <= paragraphs.MISS
    assert paragraphs.bands(50, 1, 0.25) == 2


def test_long_lists_are_dealt_anew(spark, monkeypatch):
    """Many lines with a passage in common, which no pair of them makes alike, and some near copies among them."""
    from quillspark.llm import linking

    asked, real = [], linking.by_rarest
    monkeypatch.setattr(linking, "by_rarest", lambda *a: asked.append(1) or real(*a))
    rnd = random.Random(9)
    common, rows = line(rnd, 40), []
    for d in range(300):
        rows.append((d, f"{line(rnd, 9)} {common} {line(rnd, 9)}"))
    for d in range(0, 60, 3):
        words = rows[d][1].split()
        words[rnd.choice([0, 57])] = "changed"
        rows.append((1000 + d, " ".join(words)))
    compare(paragraphs.report(spark.createDataFrame([(d, t, 1, "g", "t") for d, t in rows], SCHEMA)).collect(), rows)
    assert asked


def test_long_copies_and_repeated_lines_are_few_rows(spark):
    """Blocks of a long copy meet as one run, repeated lines as one row; what goes is what goes block by block."""
    rnd = random.Random(11)
    text, cry = line(rnd, 900), line(rnd, 25)
    rows = [(1, text), (2, f"{line(rnd, 40)} {text}"), (3, "\n".join([cry] * 80)), (4, f"{line(rnd, 31)}\n" + "\n".join([cry] * 50)), (None, text.upper())]
    docs = spark.createDataFrame([(d, t, 1, "g", "t") for d, t in rows], SCHEMA)
    left = paragraphs.leaving(docs)
    blocks = left.where("doc_id = 2 and words = 20")
    assert paragraphs.runs(blocks).count() == 1 and blocks.count() > 20
    compare(paragraphs.report(docs.where("doc_id is not null")).collect(), rows[:-1])
    assert {r.doc_id for r in paragraphs.report(docs).collect()} == {1, 2, 3, 4}


def test_blocks_with_very_many_copies_in_a_step(spark):
    """Such blocks are dealt by their texts; the first one of all is found all the same."""
    rnd = random.Random(12)
    words = line(rnd, 70)
    rows = [(d, " ".join([line(rnd, 12), *[words, line(rnd, 7)] * 4])) for d in range(12)]
    docs = spark.createDataFrame([(d, t, 1, "g", "t") for d, t in rows], SCHEMA).coalesce(1)
    compare(paragraphs.report(docs).collect(), rows)
    scanned = paragraphs._scan(docs, paragraphs.PERCENT)
    assert scanned.where(f"kind = {paragraphs.PLACE} and seq <> 0").count() > 0


def test_digests_are_those_of_the_words(monkeypatch):
    """Kept from step to step, for a bounded number of words."""
    assert isinstance(paragraphs._digested, list)
    monkeypatch.setattr(paragraphs, "DIGESTED", 40)
    monkeypatch.setattr(paragraphs, "_digested", [x[:1] for x in paragraphs._digested])
    rnd = random.Random(3)
    for _ in range(6):
        texts = [f"{line(rnd, 12)} Again É aGAIN".encode(), None, b"again x"]
        words = [w.translate(LOWER) for t in texts for w in WORD.findall(t or b"")]
        assert paragraphs.Words(texts).digests().tolist() == [int.from_bytes(hashlib.md5(w).digest()[:4], "big") for w in words]
    assert len(paragraphs._digested[0]) <= 40 + 16
