"""Token counts and token ids by a map-side two-tier lookup of pre-tokens.

Tier one is a compact hash table of frequent pre-tokens and their lengths in tokens (for ids: the ids), made once and broadcast; tier two
is each Python worker's own cache of the other pre-tokens it met, encoded by the tokenizer's library.  No pre-token is
ever shuffled.  Byte-level BPE never merges across pre-tokens, so a text's ids are the concatenation of its pre-tokens' ids.

Texts of all scripts go through both tiers.  Those of common characters are split by a pattern of the standard library; where two Unicode
tables could disagree on a character's kind, the tokenizer library's own splitter says where pre-tokens begin and end.

Cases: a null or empty text has no tokens; special strings inside a text are the library's default (one id), and what stands between them is
split apart; a tokenizer of another kind (no byte-level BPE, or one that changes texts first) gets whole texts.  A pre-token of any length is
encoded whole; long ones are not kept.  Repeated rows are counted each.  Extra columns stay; an empty table gives no row.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that texts are split here for, and the byte-level BPE contractions.  A text with any other is split by
# the library: 0x00-0x1B, 0x20-0x84, 0x86-0x24F, 0x2010-0x2027, 0x20AC, 0x2122.
_SPLIT_HERE = [*range(0x1C), *range(0x20, 0x85), *range(0x86, 0x250), *range(0x2010, 0x2028), 0x20AC, 0x2122]
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(points: list[int]) -> str:
    return "".join(f"\\u{c:04x}" for c in points)


def _splitter() -> re.Pattern:
    """The byte-level BPE pre-token pattern, its classes of letters and numbers written out for the standard library."""
    kinds: dict[str, list[int]] = {}
    for c in _SPLIT_HERE:
        kinds.setdefault(unicodedata.category(chr(c))[0], []).append(c)
    letter, number = _class(kinds["L"]), _class(kinds["N"])
    return re.compile(rf"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+")


_RARE = re.compile(f"[^{_class(_SPLIT_HERE)}]")

#: Files, and documents of them, that the frequent pre-tokens are chosen from, as expected.  Only speed depends on it.
SAMPLE_FILES, SAMPLE_DOCS = 4, 2048
#: Entries of the broadcast table, and the code points of a key at most: about 4 MB.
FREQUENT, KEY_CHARS = 1 << 15, 32
#: Entries of a worker's cache at most (it then starts again from the frequent ones), and the code points of a key that is kept.
CACHE, CACHE_CHARS = 150_000, 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Cache(dict):
    """Pre-token to value; a missing one is encoded and kept while there is room, unless it is long."""

    def __init__(self, encode, start: dict) -> None:
        super().__init__(start)
        self.encode = encode

    def __missing__(self, word: str):
        value = self.encode(word)
        if len(word) <= CACHE_CHARS and len(self) < CACHE + CACHE // 4:
            self[word] = value
        return value


class Encoder:
    """Maps a text to its number of ids, or to its ids as little-endian 32-bit integers."""

    def __init__(self, path: str, ids: bool, table: dict | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ids, self.two_tier, self.table = ids, False, table or {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: model.encode(text)
            return
        import tokenizers

        library = tokenizers.Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda text: library.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        plain = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added)
        if plain and made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.two_tier, self.common, self.library_split = True, _splitter().findall, library.pre_tokenizer.pre_tokenize_str
            self.special = {x["content"]: self._value([x["id"]]) for x in added}
            names = sorted(self.special, key=len, reverse=True)
            self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
            self.model, self.letters = library.model, _byte_letters()
            self.cache = _Cache(self.one, self.table)

    def _value(self, ids: list[int]) -> int | bytes:
        return struct.pack(f"<{len(ids)}I", *ids) if self.ids else len(ids)

    def one(self, word: str) -> int | bytes:
        """One pre-token by the library's model: its bytes' letters, merged."""
        return self._value([x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def rest(self) -> None:
        """Lets go of what the task's texts have left in the cache."""
        if self.two_tier:
            self.cache = _Cache(self.one, self.table)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        return [text[a:b] for _, (a, b) in self.library_split(text)] if _RARE.search(text) else self.common(text)

    def _looked_up(self, text: str) -> int | bytes:
        found = map(self.cache.__getitem__, self.split(text))
        return b"".join(found) if self.ids else sum(found)

    def __call__(self, text: str | None) -> int | bytes:
        if not text:
            return b"" if self.ids else 0
        if not self.two_tier:
            return self._value(self.whole(text))
        if len(self.cache) > CACHE:
            self.cache = _Cache(self.one, self.table)
        parts = self.cut(text) if self.cut else [text]
        if len(parts) == 1:
            return self._looked_up(text)
        values = [self.special[p] if k % 2 else self._looked_up(p) for k, p in enumerate(parts)]
        return b"".join(values) if self.ids else sum(values)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ids: bool, table: dict | None = None) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if (path, ids) not in _encoders:
        _encoders[path, ids] = Encoder(path, ids, table)
    return _encoders[path, ids]


def _sample(docs: DataFrame, text: str) -> list[str | None]:
    """The texts of about SAMPLE_DOCS documents; of a table of files, only a few files are read."""
    files, spark = sorted(docs.inputFiles()), docs.sparkSession
    if len(files) > SAMPLE_FILES:
        with suppress(AnalysisException):  # the files hold another kind of table
            docs = spark.read.parquet(*files[:: -(-len(files) // SAMPLE_FILES)]).select(text)
    draw = F.pmod(F.xxhash64(text), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, docs.count())))
    return [t for (t,) in docs.select(text).where(draw).limit(2 * SAMPLE_DOCS).collect()]


def frequent_table(docs: DataFrame, path: str, ids: bool, text: str = "text") -> dict[str, int | bytes]:
    """The most frequent pre-tokens of a bounded sample of the documents, with their lengths in tokens or their ids; none for other kinds of tokenizers."""
    made = Encoder(path, ids)
    if not made.two_tier:
        return {}
    counts: Counter[str] = Counter()
    for t in _sample(docs, text):
        for part in (made.cut(t or "")[::2] if made.cut else [t or ""]):
            counts.update(made.split(part))
    return {w: made.one(w) for w, _ in counts.most_common(FREQUENT) if len(w) <= KEY_CHARS}


def with_token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text, without special tokens, truncation or padding."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, False, text))  # FREQUENT entries at most

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path, False, shared.value)
        for batch in batches:
            yield pd.Series([encode(t) for t in batch], dtype="int64")
        encode.rest()

    return docs.withColumn(out, count(F.col(text)))


def token_report(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = with_token_counts(sized, path)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
