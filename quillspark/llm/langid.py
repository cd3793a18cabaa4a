"""Language identification by mixture inference.

Model: the frequencies of hashed byte trigrams of each language, learned from a bounded sample of labelled documents.  A document is
a mixture: each word comes from one language, and expectation-maximisation estimates the languages' proportions from the
words' likelihoods, until they settle.  The set of languages is chosen by penalised likelihood: the strongest language alone, then with the
second, and so on, for as long as the gain in log-likelihood is more than PENALTY for each word's logarithm.

Whole texts are read, in steps of bounded size; the driver gets the sample's counts, 2**BITS numbers a language: the model grows with
the number of languages only.

Cases: a null text and one without a letter are ``und`` with score 0; null labels teach nothing; without any labelled row all is
``und``; ties go to the first language by name; repeated rows get the same answer; a null document id is the empty text
for the draw of held-out rows; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shingles import word_hashes

#: Labelled documents of each language that the model learns from, as expected.
SAMPLE = 1500
BITS = 15
SMOOTH = 0.5
#: Rounds of expectation-maximisation at most, and the change of a proportion under which a text has settled.
ROUNDS, SETTLED = 200, 1e-3
PENALTY = 3.0
#: Of a word, languages that are farther than so many nats from the best count as being so far.
FARTHEST = 600.0
STEP_BYTES = 4 << 20
HOLD_OUT = 5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(0x21), 0x7F]] = 0x20
_FOLD[0x21:0x7F] = ord(".")
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[ord("A") : ord("Z") + 1] = _FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte, and whether the byte belongs to a letter."""
    c = _FOLD[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    c[upper] += 0x20
    wide = np.empty(len(c) + 2, np.uint32)
    wide[0] = wide[-1] = 0x20
    wide[1:-1] = c
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), _LETTER[c]


def _steps(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int]]:
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > begin and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the logarithm of each trigram bucket's probability in them (languages by buckets)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    # A row a language, so that no text is shuffled by its language.
    share = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1.0, sample / r.n)) for r in counts], "lang string, share double"))
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < F.ceil(F.col("share") * (1 << 30))
    drawn = labelled.join(share, "lang").where(draw).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                code, letter = trigrams(np.frombuffer(text, np.uint8))
                total[lang] = total.get(lang, 0) + np.bincount(code[letter], minlength=1 << BITS)
        for lang, c in total.items():
            some = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["lang", "bucket", "n"])

    found = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    table = np.full((len(names), 1 << BITS), SMOOTH)
    for k, lang in enumerate(names):
        mine = found[found["lang"] == lang]
        table[k, mine["bucket"]] += mine["n"]
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def word_likelihoods(texts: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (words by languages) of the words with letters, and the number of these words of each text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end, _ = word_hashes(data, False)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(start):
        return np.empty((0, len(logs)), np.float32), np.zeros(len(texts), np.int64)
    code, letter = trigrams(data)
    each = logs.T[code]
    each[~letter] = 0
    # Bytes between words carry nothing, so a word's stretch may reach to the next word.
    words = np.add.reduceat(each, start, axis=0)
    some = np.add.reduceat(letter, start, dtype=np.int64) > 0
    return words[some], np.diff(np.searchsorted(start[some], at))


def _settled(like: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from the proportions ``share`` (texts by languages) until none moves by more than SETTLED: proportions and
    log-likelihoods.  Texts that have settled take no part in further rounds."""
    share, going = share.copy(), np.arange(len(sizes))
    begin, own = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sizes)), sizes)
    every, every_begin, every_own = like, begin, own
    for _ in range(ROUNDS):
        part = like * share[going][own]
        part /= part.sum(1, keepdims=True)
        now = np.add.reduceat(part, begin, axis=0) / sizes[going][:, None]
        moved = np.abs(now - share[going]).max(1) > SETTLED
        share[going] = now
        if not moved.any():
            break
        if 2 * moved.sum() < len(going):  # what still moves is gathered anew
            like, going = like[moved[own]], going[moved]
            begin, own = np.r_[0, np.cumsum(sizes[going])[:-1]], np.repeat(np.arange(len(going)), sizes[going])
    return share, np.add.reduceat(np.log((every * share[every_own]).sum(1)), every_begin)


def mixtures(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions (texts by languages) of each text's chosen set of languages; zeros for texts without words.

    Languages are ranked by their proportions in the mixture of all; a set of the first ones grows by the next for as long as the
    log-likelihood gains more than the penalty.
    """
    n, k = len(sizes), words.shape[1]
    out = np.zeros((n, k))
    full = np.flatnonzero(sizes)
    if not len(full) or not k:
        return out
    sizes = sizes[full]
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    words = words.astype(np.float64)
    # Of each word, likelihoods relative to its best language's; none is zero, so neither is any sum over a set.
    like = np.exp(np.maximum(words - words.max(1, keepdims=True), -FARTHEST))
    own = np.repeat(np.arange(len(full)), sizes)
    share, _ = _settled(like, sizes, np.full((len(full), k), 1 / k))
    ranked = np.argsort(-share, axis=1, kind="stable")
    chosen = np.zeros_like(share)
    chosen[np.arange(len(full)), ranked[:, 0]] = 1
    best = np.add.reduceat(np.log(like[np.arange(len(own)), ranked[own, 0]]), begin)
    going = np.arange(len(full))
    for size in range(2, k + 1):
        # Only texts whose last set was taken, and for whose next language there is as much as one word, try a larger one.
        going = going[share[going, ranked[going, size - 1]] * sizes[going] >= 1 - SETTLED]
        if not len(going):
            break
        its = sizes[going]
        rows = np.repeat(begin[going] - np.r_[0, np.cumsum(its)[:-1]], its) + np.arange(its.sum())
        first = np.zeros((len(going), k))
        np.put_along_axis(first, ranked[going, :size], 1 / size, 1)
        mix, log = _settled(like[rows], its, first)
        better = log - best[going] > PENALTY * np.log(its + 1)
        going = going[better]
        chosen[going], best[going] = mix[better], log[better]
    out[full] = chosen
    return out


def predict(docs: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the chosen languages with their proportions, of every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((names, logs))  # 2**BITS numbers a language

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        size = max(1 << 16, STEP_BYTES // max(1, len(names)))
        for batch in batches:
            texts, lettered = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lettered").to_pylist()
            rows = []
            for a, b in _steps(texts, size):
                words, sizes = word_likelihoods([t or b"" for t in texts[a:b]], logs)
                for share, ok in zip(mixtures(words, sizes), lettered[a:b], strict=True):
                    some = [k for k in np.argsort(-share, kind="stable") if share[k] > 0] if ok else []
                    rows.append((names[some[0]], min(1.0, float(share[some[0]])), [names[k] for k in some], [float(share[k]) for k in some]) if some else ("und", 0.0, [], []))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    asked = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return asked.mapInArrow(make, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, *fit(docs))
