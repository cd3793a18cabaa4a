"""Substring dedup: paragraphs found again, nearly or exactly, in other documents or in their own, wherever lines begin and end.

Texts are sequences of lower-cased words; line breaks are spaces.  Paragraphs are, of each text,

* its lines of BLOCK words or more,
* content-defined blocks of BLOCK words: a block begins at each anchor, the word with the least digest (the first of them) in some run of
  REACH words that a block may begin with; equal runs have equal anchors, so a passage of BLOCK + REACH - 1 words that stands in two texts
  has a whole block in common, whatever stands around it,
* the whole text, if it has fewer than BLOCK words.

A paragraph's set is its distinct 5-word shingles.  Paragraphs with equal sets are one class.  Classes of lines and short texts meet by
MinHash banding: ROWS minima make a band, and as many bands are used as bring the chance to miss a pair at the threshold under MISS.  Classes
that collide are joined, their exact Jaccard similarity is verified on whole sets (after a bitmap bound that no such pair fails), and the
components of the verified links are the clusters.  Blocks are exact: as a block's first word is its anchor, blocks that are alike but not equal
differ in their last words, which is settled by words and not by sets.  Of each cluster the first paragraph (by document id, then
text hash, then place) stays and the others go, with the words on both sides that are the same as beside the one that stays.
Paragraphs that overlap the one that stays are part of it.

Only integers are shuffled: bands are packed by batch, paragraphs' places travel with them, and what comes back are the keys that two
classes share.  Words beside a paragraph travel as hashes, REACH - 1 at most a side.

Cases: null and wordless texts have no paragraphs; fewer than five words are one token; rows alike in id and text count as one document; a null
document id sorts first; a document that loses every word goes, one that had none stays; an empty table gives no row; a very long text is
read whole, in a step of its own.  What is left on both sides of a stretch meets in one line; a line that loses every word goes with its end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import BLANKS, likely_in, mark, settled, told_apart, written
from quillspark.llm.linking import PACKED, PERCENT, buckets, link, packed, shared
from quillspark.llm.setjoin import WIDTH, class_numbers
from quillspark.llm.shingles import mix, released, slices, steps, windows, word_hashes

BLOCK, REACH = 20, 30
ROWS = 2
#: Chance to miss a pair at the threshold.
MISS = 0.0005
#: Tokens from which a set has the larger bitmap too.
LARGE = 40
BITS = ["b0", "c0", "c1", "c2"]


def bands(percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Words:
    """The words of a step's texts, one after another: bytes, hashes, and where each text's begin (``cut``)."""

    def __init__(self, texts: list[bytes | None]) -> None:
        part = [t or b"" for t in texts]
        self.data = np.frombuffer(b"\n".join(part), np.uint8)
        self.at = np.cumsum([0, *(len(t) + 1 for t in part)])
        self.start, self.stop, self.hashes = word_hashes(self.data, True)
        self.cut = np.searchsorted(self.start, self.at)

    def digests(self) -> np.ndarray:
        """32 bits of a digest of each word, made once for each different one."""
        words, first, of = np.unique(self.hashes, return_index=True, return_inverse=True)
        known, held = _digested
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        out, new = held[at], known[at] != words
        raw = self.data.tobytes().translate(_LOWER)
        each = [hashlib.md5(raw[a:b], usedforsecurity=False).digest()[:4] for a, b in zip(self.start[first[new]].tolist(), self.stop[first[new]].tolist(), strict=True)]
        out[new] = np.frombuffer(b"".join(each), ">u4")
        if len(known) < DIGESTED and new.any():
            known, at = np.unique(np.concatenate([known, words[new]]), return_index=True)
            _digested[:] = known, np.concatenate([held, out[new]])[at]
        return out.astype(np.uint64)[of]

    def anchors(self) -> np.ndarray:
        """The words that blocks begin with."""
        begins = np.diff(self.cut) - BLOCK + 1  # places that a block may begin at, of each text
        if not (begins > 0).any():
            return np.empty(0, np.int64)
        order = (self.digests() << np.uint64(32)) | np.arange(len(self.hashes), dtype=np.uint64)
        of = np.repeat(np.arange(len(begins)), np.diff(self.cut))
        found = [np.empty(0, np.uint64)]
        if len(order) >= REACH:
            least = _sliding_least(order, REACH)
            whole = np.arange(len(least)) + REACH <= self.cut[of[: len(least)]] + begins[of[: len(least)]]
            found.append(least[whole])
        for t in np.flatnonzero((begins > 0) & (begins < REACH)).tolist():  # one run of all places
            found.append(order[self.cut[t] : self.cut[t] + begins[t]].min(keepdims=True))
        return np.unique(np.concatenate(found) & np.uint64(0xFFFFFFFF)).astype(np.int64)


#: Words from which on a worker keeps no more digests: with those of one more step, some 2 MB.  The first entry stands for the empty word.
DIGESTED = 1 << 17
_digested = [np.zeros(1, np.uint64), np.frombuffer(hashlib.md5(usedforsecurity=False).digest()[:4], ">u4").astype(np.uint32)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Paragraphs:
    """The paragraphs of a step's texts, in arrays: texts' numbers, first words, numbers of words, classes, and sets one after another."""

    def __init__(self, texts: list[bytes | None], width: int = WIDTH) -> None:
        w = self.of = Words(texts)
        blocks = w.anchors()
        ends = np.r_[np.flatnonzero(w.data == 10), len(w.data)]
        first, last = np.searchsorted(w.start, np.r_[0, ends[:-1] + 1]), np.searchsorted(w.start, ends)
        lines = np.flatnonzero(last - first >= BLOCK)
        short = np.flatnonzero((np.diff(w.cut) > 0) & (np.diff(w.cut) < BLOCK))
        begin = np.concatenate([blocks, first[lines], w.cut[:-1][short]]).astype(np.int64)
        stop = np.concatenate([blocks + BLOCK, last[lines], w.cut[1:][short]]).astype(np.int64)
        shingles = windows(w.hashes, width)
        grid = shingles[blocks[:, None] + np.arange(BLOCK - width + 1)] if len(blocks) else np.empty((0, BLOCK - width + 1), np.uint64)
        grid.sort(axis=1)
        new = np.ones(grid.shape, bool)
        new[:, 1:] = grid[:, 1:] != grid[:, :-1]
        others = [np.unique(shingles[a : b - width + 1]) if b - a >= width else windows(w.hashes[a:b], b - a) for a, b in zip(begin[len(blocks) :].tolist(), stop[len(blocks) :].tolist(), strict=True)]
        self.banded = np.arange(len(begin)) >= len(blocks)
        self.tokens = np.concatenate([grid[new], *others])
        self.sizes = np.concatenate([new.sum(1), np.array([len(s) for s in others], np.int64)]).astype(np.int64)
        self.starts = np.cumsum(np.r_[0, self.sizes])[:-1]
        self.ids = class_numbers(self.tokens, self.starts, self.sizes)
        self.begin, self.stop = begin, stop
        self.text = np.searchsorted(w.cut[1:], begin, "right")
        self.pos, self.words = begin - w.cut[self.text], stop - begin
        self.seq, self.next = np.zeros(len(begin), np.uint32), np.zeros(len(begin), np.uint32)
        self.seq[: len(blocks)], self.next[: len(blocks)] = self._following(blocks)

    def _following(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each block, a hash of its words in order; and how far on the next block of its text begins (in 5 bits, 0: there is none) with
        a hash of the words between the two."""
        if not len(blocks):
            return (np.empty(0, np.uint32),) * 2
        hashes, text = self.of.hashes, self.text[: len(blocks)]
        power = np.multiply.accumulate(np.full(BLOCK, _SEQUENCE))
        seq = mix((hashes[blocks[:, None] + np.arange(BLOCK)] * power).sum(1)) >> np.uint64(32)
        far = np.r_[np.where(text[1:] == text[:-1], np.diff(blocks), 0), 0]
        behind = np.minimum(blocks[:, None] + np.arange(BLOCK, REACH), len(hashes) - 1)
        between = np.where(np.arange(BLOCK, REACH) < far[:, None], hashes[behind] * power[: REACH - BLOCK], np.uint64(0)).sum(1)
        following = np.where(far > 0, mix(between + np.uint64(1)) >> np.uint64(37) << np.uint64(5) | far.astype(np.uint64), np.uint64(0))
        return seq.astype(np.uint32), following.astype(np.uint32)

    def banded_only(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and bitmaps of the lines and short texts."""
        p = object.__new__(Paragraphs)
        p.sizes = self.sizes[self.banded]
        p.tokens = self.tokens[self.starts[self.banded][0] :] if len(p.sizes) else np.empty(0, np.uint64)  # they come behind the blocks
        p.starts = np.cumsum(np.r_[0, p.sizes])[:-1]
        return p.band_keys(count), p.bitmaps()

    def bitmaps(self) -> np.ndarray:
        """For each set, words of 64 bits: the parity of the tokens that fall on each bit, of 64 bits and of 192 others."""
        n, own = len(self.sizes), np.repeat(np.arange(len(self.sizes)), self.sizes)
        out = []
        for bits, shift in ((64, 0), (192, 8)):
            bit = ((self.tokens >> np.uint64(shift)) % np.uint64(bits)).astype(np.int64) + own * bits
            odd = (np.bincount(bit, minlength=n * bits) & 1).astype(np.uint8)
            out.append(np.packbits(odd.reshape(n, -1), axis=1).view(np.int64))
        return np.concatenate(out, axis=1)

    def band_keys(self, count: int, rows: int = ROWS) -> np.ndarray:
        """For each set (rows), the key of each band: its number and the least of ``rows`` orders of its tokens."""
        out = np.repeat(np.arange(1, count + 1, dtype=np.uint64)[None, :], len(self.sizes), 0)
        seeds = mix(np.arange(1, 2 * count * rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in range(count * rows if len(self.sizes) else 0):
            least = np.minimum.reduceat((self.tokens ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), self.starts)
            band = k // rows
            out[:, band] = mix(out[:, band] * np.uint64(0x100000001B3) + least)
        return out


_SEQUENCE = np.uint64(0x9E3779B97F4A7C15)
#: Copies of a block in a step from which they are dealt by their texts, not by their class.
MANY = 8
_PLACE = [("known", "u1"), ("doc_id", "i8"), ("th", "i8"), ("pos", "i4")]
_BLOCK = np.dtype([*_PLACE, ("id", "i8"), ("seq", "u4"), ("next", "u4")])
_LINE = np.dtype([*_PLACE, ("id", "i8"), ("words", "i4"), ("n", "i4"), *((b, "i8") for b in BITS)])
_HOT = np.dtype([("id", "i8"), ("c", "i8")])
_DEALT = f"{PACKED}, blocks binary, lines binary, hot binary, apart binary"
#: What the rows of a scan are.
LEAVES, PLACE, CLASS, KEY = range(4)
_FOUND = "kind int, doc_id long, th long, pos int, words int, id long, seq int, next int, kd long, kt long, kp int, same boolean, far int, n long, c long, b0 long, c0 long, c1 long, c2 long, key long"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _document() -> list[Column]:
    """What tells documents apart, without nulls, so that rows that are gathered by it lie where they are joined."""
    return [F.col("th"), F.coalesce("doc_id", F.lit(0)).alias("known_id"), F.isnull("doc_id").alias("nil")]


_DOCUMENT = ["th", "known_id", "nil"]


def _told(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """The documents' texts with the columns of ``facts``, which has _DOCUMENT; other texts are passed by a bounded filter."""
    return likely_in(_texts(docs).select("*", *_document()[1:]), _DOCUMENT, facts).join(facts, _DOCUMENT)


def _fields(rows: np.ndarray) -> bytes:
    """Rows field by field, as that compresses better."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def _rows(packed_rows: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The rows of all ``_fields``."""
    out = []
    for x in packed_rows.drop_null():
        data, at = x.as_buffer(), 0
        rows = np.empty(len(data) // kind.itemsize, kind)
        for f in kind.names:
            rows[f] = np.frombuffer(data, kind[f], len(rows), at)
            at += len(rows) * kind[f].itemsize
        out.append(rows)
    return np.concatenate([np.empty(0, kind), *out])


def _in_order(rows: np.ndarray, *last: np.ndarray) -> np.ndarray:
    """The order by class, document (null first), text hash, place."""
    return np.lexsort((*last, rows["pos"], rows["th"], rows["doc_id"], rows["known"], rows["id"]))


def _scan(docs: DataFrame, percent: int) -> DataFrame:
    """In one pass over the texts, four kinds of rows.

    LEAVES: a block that goes, with the first one of its class (kd, kt, kp), whether the words of both are the same in order, and how far on both
    go on alike to a next block (0: they do not).  PLACE: the place and class of any paragraph whose class has lines, short texts or very many copies;
    CLASS: such a class's first paragraph, its number of paragraphs, the set's size and bitmaps; KEY: id and key of the band keys that two classes or more have.

    Blocks meet in the bucket of their class, so that those of classes without lines are settled there.
    """
    n, many = buckets(docs), bands(percent)
    kinds = {f.split()[0]: {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split()[1]] for f in f"{_DEALT}, {_FOUND}".split(", ")}
    schema = pa.schema([(f.split()[0], kinds[f.split()[0]]) for f in _DEALT.split(", ")])

    def dealt(buckets_of: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
        order = np.argsort(buckets_of, kind="stable")
        rows, of = rows[order], buckets_of[order]
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
        own = {"bucket": pa.array(of[edges[:-1]].astype(np.int32)), name: pa.array([_fields(rows[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())}
        return pa.record_batch([own[f.name] if f.name in own else pa.nulls(len(edges) - 1, f.type) for f in schema], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = lambda rows: (rows["id"].view(np.uint64) >> np.uint64(32)) % np.uint64(n)
        for batch in (x for batch in batches for x in slices(batch)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            known, ids, hashes = np.asarray(batch.column("doc_id").is_valid()), np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("th"))
            for a, b in steps(texts):
                p = Paragraphs(texts[a:b])
                if not len(p.ids):
                    continue

                def filled(which: np.ndarray, kind: np.dtype, own: np.ndarray = p.text + a, p: Paragraphs = p) -> np.ndarray:
                    rows = np.zeros(int(which.sum()), kind)
                    rows["known"], rows["doc_id"], rows["th"], rows["pos"], rows["id"] = known[own[which]], ids[own[which]], hashes[own[which]], p.pos[which], p.ids[which]
                    return rows

                blocks, lines = filled(~p.banded, _BLOCK), filled(p.banded, _LINE)
                blocks["seq"], blocks["next"] = p.seq[~p.banded], p.next[~p.banded]
                lines["words"], lines["n"] = p.words[p.banded], p.sizes[p.banded]
                keys, bitmaps = p.banded_only(many)
                for k, f in enumerate(BITS):
                    lines[f] = bitmaps[:, k]
                blocks = blocks[_in_order(blocks)]
                begin = np.flatnonzero(np.r_[True, blocks["id"][1:] != blocks["id"][:-1]]) if len(blocks) else np.empty(0, np.int64)
                count = np.diff(np.r_[begin, len(blocks)])
                apart = np.repeat(count > MANY, count)
                apart[begin] = False  # the first one stands for them in the bucket of its class
                hot = np.zeros(int((count > MANY).sum()), _HOT)
                hot["id"], hot["c"] = blocks["id"][begin[count > MANY]], count[count > MANY] - 1
                first = np.unique(lines["id"], return_index=True)[1]  # copies in a step are packed once
                columns = packed(lines["id"][first], np.full(len(first), many), keys[first].ravel(), n)
                yield pa.record_batch([columns.get(f.name, pa.nulls(len(columns["bucket"]), f.type)) for f in schema], schema=schema)
                yield dealt(by_class(blocks[~apart]), blocks[~apart], "blocks")
                yield dealt(by_class(lines), lines, "lines")
                yield dealt(by_class(hot), hot, "hot")
                yield dealt(mix(blocks["th"][apart].view(np.uint64)) % np.uint64(n), blocks[apart], "apart")

    @released
    def find(table: pa.Table) -> pa.Table:
        def told(kind: int, size: int, **of) -> pa.Table:
            of = {"kind": np.full(size, kind, np.int32), **of}
            # Unsigned hashes keep their bits.
            cast = lambda x: x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x.view(np.int32) if x.dtype == np.uint32 else x))
            return pa.table({f: cast(of[f]).cast(kinds[f]) if f in of else pa.nulls(size, kinds[f]) for f in (x.split()[0] for x in _FOUND.split(", "))})

        ids_of = lambda rows, known="known", doc="doc_id": pa.array(np.ascontiguousarray(rows[doc]), mask=rows[known] == 0)
        blocks, lines, hot, apart = _rows(table.column("blocks"), _BLOCK), _rows(table.column("lines"), _LINE), _rows(table.column("hot"), _HOT), _rows(table.column("apart"), _BLOCK)
        slow = np.union1d(lines["id"], hot["id"])
        later = np.isin(blocks["id"], slow)
        out = []
        for rows in (blocks[later], apart):
            out.append(told(PLACE, len(rows), doc_id=ids_of(rows), th=rows["th"], pos=rows["pos"], words=np.full(len(rows), BLOCK), id=rows["id"], seq=rows["seq"], next=rows["next"]))
        out.append(told(PLACE, len(lines), doc_id=ids_of(lines), th=lines["th"], pos=lines["pos"], words=lines["words"], id=lines["id"], seq=np.zeros(len(lines), np.uint32), next=np.zeros(len(lines), np.uint32)))
        # The first paragraph of each class, by words and a block before a line where places are the same.
        every = np.zeros(int(later.sum()) + len(lines), np.dtype([*_BLOCK.descr, ("words", "i4"), ("line", "i4")]))
        for rows, part in ((blocks[later], every[: int(later.sum())]), (lines, every[int(later.sum()) :])):
            for f in set(rows.dtype.names) & set(every.dtype.names):
                part[f] = rows[f]
        every["words"][: int(later.sum())], every["line"] = BLOCK, np.r_[np.full(int(later.sum()), -1), np.arange(len(lines))]
        order = _in_order(every, every["line"], every["words"])
        every = every[order]
        begin = np.flatnonzero(np.r_[True, every["id"][1:] != every["id"][:-1]]) if len(every) else np.empty(0, np.int64)
        firsts, count = every[begin], np.diff(np.r_[begin, len(every)])
        np.add.at(count, np.searchsorted(firsts["id"], hot["id"]), hot["c"])
        line = np.maximum.reduceat(every["line"], begin) if len(every) else begin
        facts = {"n": lines["n"][line] * (line >= 0)} if len(lines) else {"n": np.zeros(len(line), np.int64)}
        for f in BITS if len(lines) else []:
            facts[f] = pa.array(lines[f][line], mask=(line < 0) | ((facts["n"] < LARGE) if f != "b0" else False))
        out.append(told(CLASS, len(firsts), doc_id=ids_of(firsts), th=firsts["th"], pos=firsts["pos"], words=firsts["words"], id=firsts["id"], seq=firsts["seq"], next=firsts["next"], c=count, **facts))
        # Classes of blocks only are settled here.
        rows = blocks[~later]
        rows = rows[_in_order(rows)]
        if len(rows):
            new = np.r_[True, rows["id"][1:] != rows["id"][:-1]]
            twice = np.r_[False, rows[1:][list(_BLOCK.names[:5])] == rows[:-1][list(_BLOCK.names[:5])]]
            kept = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            own = (rows["known"] == kept["known"]) & (rows["doc_id"] == kept["doc_id"]) & (rows["th"] == kept["th"])
            goes = ~new & ~twice & ~(own & (rows["pos"] < kept["pos"] + BLOCK))
            rows, kept = rows[goes], kept[goes]
            out.append(told(LEAVES, len(rows), doc_id=ids_of(rows), th=rows["th"], pos=rows["pos"], kd=ids_of(kept), kt=kept["th"], kp=kept["pos"], same=rows["seq"] == kept["seq"], far=np.where(rows["next"] == kept["next"], rows["next"] & np.uint32(31), np.uint32(0))))
        own, full, _, _ = shared(table.filter(table.column("ids").is_valid()))
        out.append(told(KEY, len(own), id=own, key=full))
        return pa.concat_tables(out)

    return _texts(docs).mapInArrow(make, _DEALT).groupBy("bucket").applyInArrow(find, _FOUND)


def _sets_from(docs: DataFrame, classes: DataFrame, width: int = WIDTH):
    """Of a table of class ids, the sets, made again from the place of each class's first paragraph; other texts are passed by a bounded filter."""

    def sets_of(ids: DataFrame) -> DataFrame:
        places = F.collect_list(F.struct("id", "f.pos", "f.words")).alias("places")
        wanted = written(likely_in(classes, ["id"], ids).join(ids, "id").groupBy("f.doc_id", "f.th").agg(places), "wanted")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (x for batch in batches for x in slices(batch)):
                texts, places = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist()
                for a, b in steps(texts):
                    w, rows = Words(texts[a:b]), []
                    shingles = windows(w.hashes, width)
                    for t in range(a, b):
                        for u in places[t]:
                            at, n = int(w.cut[t - a]) + u["pos"], u["words"]
                            rows.append((u["id"], (np.unique(shingles[at : at + n - width + 1]) if n >= width else windows(w.hashes[at : at + n], n)).tobytes()))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["id", "tokens"])

        # Rows alike in id and text lie together after the join: one of them is taken there, and the sets need no shuffle.
        return _told(docs, wanted.select(*_document(), "places")).dropDuplicates(_DOCUMENT).select("text", "places").mapInArrow(make, "id long, tokens binary")

    return sets_of


def leaving(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every paragraph that goes: doc_id, th, pos, words; kd, kt, kp, kw, the same of the one that stays; same and far as in a scan."""
    scanned = written(_scan(docs, percent), "paragraphs")
    first = F.struct("doc_id", "th", "pos", "words").alias("f")
    classes = scanned.where(f"kind = {CLASS}").select("id", "n", "c", *BITS, first, "seq", "next")
    keys = scanned.where(f"kind = {KEY}").select("id", "key")
    postings = keys.join(likely_in(classes, ["id"], keys).select("id", "n", "c", *BITS), "id")
    # Of near copies, the text that occurs most often is the likeliest to be what the others were made from.
    postings = postings.select("key", F.col("id").alias("gid"), "n", F.lit(None).cast("long").alias("pos"), (-F.col("c")).alias("far"), *BITS)
    labels = link(postings, None, _sets_from(docs, classes), percent, banded=True)
    of = classes.where("c > 1").union(likely_in(classes.where("c = 1"), ["id"], labels))
    of = of.join(labels, "id", "left").where("label is not null or c > 1").select("id", F.coalesce("label", "id").alias("label"), F.struct("f.*", "seq", "next").alias("f"))
    of = written(of, "clusters")
    keep = of.groupBy("label").agg(F.min("f").alias("k"))
    told = of.join(keep, "label").select("id", *(F.col(f"k.{x}").alias(y) for x, y in (("doc_id", "kd"), ("th", "kt"), ("pos", "kp"), ("words", "kw"), ("seq", "kseq"), ("next", "knext"))))
    rows = scanned.where(f"kind = {PLACE}").select("doc_id", "th", "pos", "words", "id", "seq", "next").join(told, "id")
    # Neither what stays, nor what overlaps it.
    rows = rows.where(~(F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt")) & (F.col("pos") < F.col("kp") + F.col("kw"))))
    both = (F.col("words") == BLOCK) & (F.col("kw") == BLOCK) & (F.col("seq") != 0)
    same, far = both & (F.col("seq") == F.col("kseq")), F.when(both & (F.col("next") == F.col("knext")), F.col("next").bitwiseAND(31)).otherwise(0)
    rows = rows.select("doc_id", "th", "pos", "words", "kd", "kt", "kp", "kw", same.alias("same"), far.alias("far"))
    size = F.lit(BLOCK).alias
    return rows.unionByName(scanned.where(f"kind = {LEAVES}").select("doc_id", "th", "pos", size("words"), "kd", "kt", "kp", size("kw"), "same", "far"))


def runs(rows: DataFrame) -> DataFrame:
    """What leaves, blocks that go on alike to the next one as one: doc_id, th, pos, words, kd, kt, kp, kw; room, the words that may go before it in the
    text of the one that stays (null: it stays elsewhere); and places, those of its paragraphs that begin with its first REACH words.

    The words of such blocks and between them are the same as in the text of the one that stays, at the same distance: only the run's ends have others beside them.
    """
    own = F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt"))
    rows = rows.withColumn("room", F.when(own, F.col("pos") - F.col("kp") - F.col("kw"))).withColumn("apart", F.col("pos") - F.col("kp"))
    line = ["doc_id", "th", "kd", "kt", "apart", "same", "room", F.when(~F.col("same"), F.struct("words", "kw")).alias("odd")]
    names = ["doc_id", "th", "kd", "kt", "apart", "same", "room", "odd"]
    rows = rows.select(*line, "pos", "words", "kp", "kw", "far")
    order = Window.partitionBy(*names).orderBy("pos")
    on = F.col("same") & (F.lag("far").over(order) == F.col("pos") - F.lag("pos").over(order))
    rows = rows.withColumn("new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order))
    of = rows.groupBy(*names, "run").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("words")).alias("stop"), F.min("kp").alias("kp"), F.max(F.col("kp") + F.col("kw")).alias("kstop"), F.collect_list("pos").alias("all"))
    places = F.filter("all", lambda p: p < F.col("pos") + REACH)
    return of.select("doc_id", "th", "pos", (F.col("stop") - F.col("pos")).alias("words"), "kd", "kt", "kp", (F.col("kstop") - F.col("kp")).alias("kw"), "room", F.when(F.col("same"), places).alias("places"))


_BESIDE = "doc_id long, th long, pos array<int>, words int, kept boolean, kd long, kt long, kp int, kw int, room int, places array<int>, before binary, after binary"


def gone(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, th and the stretches of words (first, behind the last, document where they stay) that go from each text."""
    begin = mark()
    rows = settled(runs(leaving(docs, percent)), "runs", begin)
    none = lambda kind: F.lit(None).cast(kind)
    stay = rows.select(F.col("kd").alias("doc_id"), F.col("kt").alias("th"), F.col("kp").alias("pos"), F.col("kw").alias("words")).distinct()
    stay = stay.select("*", F.lit(True).alias("kept"), F.col("doc_id").alias("kd"), F.col("th").alias("kt"), F.col("pos").alias("kp"), F.col("words").alias("kw"), none("int").alias("room"), none("array<int>").alias("places"))
    asked = rows.withColumn("kept", F.lit(False)).unionByName(stay)
    asked = asked.groupBy(*_document()).agg(F.collect_list(F.struct("pos", "words", "kept", "kd", "kt", "kp", "kw", "room", "places")).alias("units"))
    side = REACH - 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for batch in batches for x in slices(batch)):
            texts, units = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("units")
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            cut = np.cumsum(np.r_[0, np.asarray(pc.list_value_length(units))]).tolist()
            every = list(zip(*(x.to_pylist() for x in units.flatten().flatten()), strict=True))
            for a, b in steps(texts):
                w = Words(texts[a:b])
                short = w.hashes.astype(np.uint32)
                out: dict[tuple, list[int]] = {}
                for t in range(a, b):
                    begin, end = int(w.cut[t - a]), int(w.cut[t - a + 1])
                    for pos, words, kept, kd, kt, kp, kw, room, places in every[cut[t] : cut[t + 1]]:
                        first = begin + pos
                        last = first + words
                        # Repeated lines have the same words beside them again and again: one row says where.
                        room = None if room is None else min(room, side)
                        places = None if places is None else tuple([x - pos for x in places])
                        row = (ids[t], hashes[t], words, kept, kd, kt, kp, kw, room, places, short[max(begin, first - side) : first][::-1].tobytes(), short[last : min(end, last + side)].tobytes())
                        out.setdefault(row, []).append(pos)
                columns = list(zip(*out, strict=True)) or [()] * (len(_KINDS) - 1)
                columns.insert(2, list(out.values()))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _KINDS, strict=True)], schema=_KINDS)

    beside = settled(_told(docs, asked).select("doc_id", "th", "text", "units").mapInArrow(look, _BESIDE), "beside", begin)
    key = ["kd", "kt", "kp", "kw"]
    stays = beside.where("kept").select(*key, F.col("before").alias("k_before"), F.col("after").alias("k_after"))
    same = F.col("l.kd").eqNullSafe(F.col("k.kd")) & (F.col("l.kt") == F.col("k.kt")) & (F.col("l.kp") == F.col("k.kp")) & (F.col("l.kw") == F.col("k.kw"))
    leaves = beside.where("not kept").alias("l").join(stays.alias("k"), same)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def alike(x: pa.Array, y: pa.Array) -> np.ndarray:
            """Words that agree from the paragraph on."""
            pad = lambda v, fill: np.frombuffer(b"".join((s or b"").ljust(4 * side, fill) for s in v.to_pylist()), np.uint32).reshape(-1, side)
            size = np.minimum(pc.binary_length(x), pc.binary_length(y)) // 4
            agree = (pad(x, b"\0") == pad(y, b"\0")) & (np.arange(side) < np.asarray(size)[:, None])
            return np.cumprod(agree, axis=1).sum(1)

        for batch in batches:
            words = np.asarray(batch.column("words")).astype(np.int64)
            room = np.asarray(batch.column("room").fill_null(side))
            left = np.minimum(alike(batch.column("before"), batch.column("k_before")), room)
            right = alike(batch.column("after"), batch.column("k_after"))
            # How far from its own place the last of a run's blocks stands whose stretch begins at the run's first word.
            places = batch.column("places")
            flat, of = np.asarray(places.flatten()).astype(np.int64), np.repeat(np.arange(len(words)), np.asarray(pc.list_value_length(places).fill_null(0)))
            last = np.zeros(len(words), np.int64)
            np.maximum.at(last, of, np.where(flat + left[of] <= np.minimum(side, room)[of], flat, 0))
            own = np.where(np.asarray(places.is_valid()), np.minimum(last + BLOCK + side, words + right), words + right)
            pos = batch.column("pos")
            at, of = np.asarray(pos.flatten()).astype(np.int64), np.repeat(np.arange(len(words)), np.asarray(pc.list_value_length(pos)))
            order = np.lexsort((at, of))
            at, of = at[order], of[order]
            a, b, e = at - left[of], at + (words + right)[of], at + own[of]
            # Of a row's stretches that touch or overlap, only the first one's beginning counts; all have one length.
            new = np.r_[True, (of[1:] != of[:-1]) | (a[1:] > b[:-1])] if len(of) else np.empty(0, bool)
            ends = np.r_[np.flatnonzero(new)[1:], len(of)] - 1 if len(of) else np.empty(0, np.int64)
            of = pa.array(of[new])
            yield pa.record_batch([batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(a[new], pa.int64()), pa.array(b[ends], pa.int64()), pa.array(e[new], pa.int64()), batch.column("kd").take(of)], names=["doc_id", "th", "a", "b", "e", "kd"])

    wide = leaves.select("l.doc_id", "l.th", "l.pos", "l.words", "l.room", "l.places", "l.before", "l.after", "k.k_before", "k.k_after", "l.kd").mapInArrow(widen, "doc_id long, th long, a long, b long, e long, kd long")
    # A stretch within another one says nothing more.
    wide = wide.groupBy("doc_id", "th", "a").agg(F.max("b").alias("b"), F.max(F.struct("e", "kd")).alias("m")).select("doc_id", "th", "a", "b", "m.kd")
    return settled(wide.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b", "kd"))).alias("gone")), "gone", begin)


_KINDS = pa.schema([(n, {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in _BESIDE.split(", "))])


def merged(stretches: list[dict]) -> list[tuple[int, int, int | None]]:
    """Stretches of words in order, those that touch or overlap as one, with the first one's document."""
    out: list[list] = []
    for s in stretches:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"], s["kd"]])
    return [tuple(x) for x in out]


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every stretch that goes: doc_id, its first and last byte and number of words, and the document where the text of its beginning stays."""
    told = gone(docs, percent)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for batch in batches for x in slices(batch)):
            rows = []
            for doc, text, stretches in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                start, stop, _ = word_hashes(np.frombuffer(text, np.uint8), True)
                rows += [(doc, int(start[a]), int(stop[b - 1]), b - a, kept) for a, b, kept in merged(stretches)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "begin_byte", "end_byte", "n_words", "kept_doc_id"])

    return _told(docs, told.select(*_document(), "gone")).select("doc_id", "text", "gone").mapInArrow(name, "doc_id long, begin_byte long, end_byte long, n_words long, kept_doc_id long")


def without(text: str, stretches: list[dict]) -> str:
    """The text without the stretches of words."""
    data = text.encode()
    start, stop, _ = word_hashes(np.frombuffer(data, np.uint8), True)
    out, at = [], 0
    for a, b, _ in merged(stretches):
        begin, end = int(start[a]), int(stop[b - 1])
        while data[end : end + 1] in _IN_LINE:
            end += 1
        line = data.rfind(b"\n", 0, begin) + 1
        if not data[max(line, at) : begin].strip(_STRIP) and (line >= at or at == 0):  # nothing else stands before it in its line
            if data[end : end + 1] == b"\n":
                begin, end = max(line, at), end + 1
            elif end == len(data) and line:
                begin = max(line - 1, at)
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]]).decode()


_IN_LINE, _STRIP = (b" ", b"\t", b"\x0b", b"\x0c", b"\r"), b" \t\x0b\x0c\r"


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, stretches: pd.Series) -> pd.Series:
    return pd.Series([without(t, s) for t, s in zip(text, stretches, strict=True)], dtype=object)


def strip(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without the stretches that go, with all columns; n_chars, if there, is that of the new text."""
    told = gone(docs, percent)
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("_row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_th"))
    rows = told_apart(rows, ["_th", "_id"], told.select(F.col("th").alias("_th"), F.col("doc_id").alias("_id")))
    # Documents outside of the slots stay without a shuffle.
    asked = rows.where("_in").join(told, (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    apart = rows.where("_in is null").select("_row.*").unionByName(asked.where("gone is null").select("_row.*"))
    less = asked.where("gone is not null").withColumn("_text", _without(F.col("_row.text"), F.col("gone")))
    less = less.where(F.btrim("_text", F.lit(BLANKS)) != "")
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text") if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    columns = [(new[c].cast(kinds[c]) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    return apart.unionByName(less.select(*columns))


# The same in SQL, over a table documents whose ids are distinct, with all pairs of lines and short texts that share a shingle in place of bands.
ORACLE = f"""
with recursive pieces as (
  select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as p from documents where text is not null)
), placed as (
  select doc_id, i, x, regexp_matches(x, '[^\\x20\\x09-\\x0D]') as word, octet_length(encode(x)) as size, (sum(octet_length(encode(x))) over w)::bigint as stop, (sum(length(x) - length(replace(x, chr(10), ''))) over w)::bigint as line
  from pieces window w as (partition by doc_id order by i rows unbounded preceding)
), words as (
  select doc_id, row_number() over (partition by doc_id order by i) - 1 as k, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, stop - size as begin, stop, line from placed where word
), docs as (
  select doc_id, list(w order by k) as ws, list(begin order by k) as begins, list(stop order by k) as stops, count(*) as n from words group by doc_id
), least as (
  select doc_id, k, n - {BLOCK - 1} as places, min(('0x' || substr(md5(w), 1, 8))::bigint * 16777216 + k) over (partition by doc_id order by k rows between current row and {REACH - 1} following) as m
  from words join (select doc_id, n from docs) using (doc_id) where k <= n - {BLOCK}
), units as (
  select doc_id, a, m, bool_or(near) as near from (
    select doc_id, m % 16777216 as a, {BLOCK} as m, false as near from least where k <= places - {REACH} or (k = 0 and places < {REACH})
    union all select doc_id, min(k), count(*), true from words group by doc_id, line having count(*) >= {BLOCK}
    union all select doc_id, 0, n, true from docs where n < {BLOCK}) group by doc_id, a, m
), sets as (
  select doc_id, a, m, near, list_sort(list_distinct(list_transform(range(a, a + greatest(1, m - {WIDTH - 1})), lambda i: array_to_string(ws[i + 1:i + least(m, {WIDTH})], ' ')))) as s from units join docs using (doc_id)
), classed as (
  select doc_id, a, m, md5(array_to_string(s, '|')) as id, near, s from sets
), classes as (
  select id, any_value(s) as s, any_value(len(s)) as n, bool_or(near) as near, min(row(doc_id, a, m)) as f, count(*) as c from classed group by id
), tokens as (
  select id, n, unnest(s) as s from classes where near
), pairs as (
  select x.id as x, y.id as y, x.n as n, y.n as m, count(*) as c from tokens x join tokens y using (s) where x.id < y.id and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) group by all
), linked as (
  select x, y from pairs where 100 * c >= {PERCENT} * (n + m - c)
), ways as (
  select x, y from linked union all select y, x from linked
), reach(id, other) as (
  select x, x from ways union select r.id, b.y from reach r join ways b on b.x = r.other
), labels as (
  select id, min(other) as label from reach group by id
), of as (
  select id, coalesce(label, id) as label, f, c from classes left join labels using (id)
), keep as (
  select label, min(f) as f from of group by label having sum(c) > 1
), leaves as (
  select u.doc_id, u.a, u.m, keep.f[1] as kd, keep.f[2] as kp, keep.f[3] as kw from classed u join (select id, label from of) o using (id) join keep using (label)
), beside as (
  select l.*, d.ws as dw, k.ws as ks, least({REACH - 1}, a, kp, case when l.doc_id = kd then a - kp - kw else a end) as most_left, least({REACH - 1}, d.n - a - m, k.n - kp - kw) as most_right
  from (select doc_id, a, m, kd, kp, kw from leaves where not (doc_id = kd and a < kp + kw)) l join docs d using (doc_id) join docs k on k.doc_id = l.kd
), wide as (
  select doc_id, a - coalesce(list_position(list_transform(range(1, most_left + 1), lambda j: dw[a - j + 1] = ks[kp - j + 1]), false) - 1, most_left) as x,
    a + m + coalesce(list_position(list_transform(range(1, most_right + 1), lambda j: dw[a + m + j] = ks[kp + kw + j]), false) - 1, most_right) as y, kd from beside
), ends as (
  select doc_id, x, max(row(y, kd)) as e from wide group by doc_id, x
), marked as (
  select *, coalesce(x > max(e[1]) over (partition by doc_id order by x rows between unbounded preceding and 1 preceding), true) as new from ends
), islands as (
  select *, sum(new::int) over (partition by doc_id order by x) as island from marked
), spans as (
  select doc_id, min(x) as x, max(e[1]) as y, arg_min(e[2], x) as kd from islands group by doc_id, island
)
select doc_id, begins[x + 1]::bigint as begin_byte, stops[y]::bigint as end_byte, (y - x)::bigint as n_words, kd as kept_doc_id from spans join docs using (doc_id)
"""
