"""N-gram Jaccard join of documents by a grouped prefix join.

A document's set is its distinct 5-word shingles, lower-cased.  Documents with equal sets are one class, known by a 64-bit
hash of the set.  Whatever the order of shingles, two sets that are similar enough must share some among the first of each (the
prefix).  That is used twice:

1. In the order of hashes, of which a set's first quarter is its prefix, a class must share about a sixth of the prefix with
   prefixes of others (``prefix``, ``least``); the classes that do not are done.
2. The others' shingles are put in the order of their number of classes, rarest first; here one of the prefix must be shared.
   Shingles of a single class never meet, so a class whose prefix holds no other is done.  Classes with identical prefixes and
   sizes are one group; pairs of groups are filtered by size and by position, then expanded, and their members verified on
   whole sets (``linking``).

Either step needs one shuffle of six bytes a shingle, packed by batch: the first one of a quarter of all shingles, which the documents' own
facts join, the second one of those of the classes that the first one leaves.  What returns are counts and the shingles that are shared.
The number of buckets follows the table's bytes and the shingles left, so that a bucket does not grow.
Sets that are needed again are made from their texts, which stay where they are.

Cases: null and wordless texts have empty sets and link with nothing; fewer than five words are one token; copies and
repeated rows are one class; a null document id takes part and is never the smallest; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import likely_in, told_apart, written
from quillspark.llm.linking import BUCKET_BYTES, PACKED, PERCENT, buckets, by_class, dealt, few_buckets, link, packed, shared, table_bytes, undealt
from quillspark.llm.shingles import mix, released, slices, steps, token_sets

WIDTH = 5
#: Shares that a class's documents are dealt into where they meet their component.
SALTS = 16
_SALT = np.uint64(0x5851F42D4C957F2D)
#: A set's prefix in the order of hashes has at least one shingle in so many of those by which similar sets may differ beyond these.
MORE = 4
#: Shingles that a bucket of the second step holds, about.
BUCKET_TOKENS = 1 << 22


def class_numbers(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sorted, non-empty set; the sets lie one after another."""
    if not len(sizes):
        return np.empty(0, np.int64)
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)
    mixed = np.bitwise_xor.reduceat(mix(tokens + mix(place * _SALT)), starts)
    return mix(mixed + sizes.astype(np.uint64) * _SALT).view(np.int64)


def class_number(tokens: np.ndarray) -> int:
    """A 64-bit hash of a sorted set; 0 for the empty one."""
    return int(class_numbers(tokens, np.zeros(1, np.int64), np.array([len(tokens)]))[0]) if len(tokens) else 0


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in parts of bounded size, with their texts' sets."""
    for part in (x for batch in batches for x in slices(batch)):
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for a, b in steps(texts):
            yield part.slice(a, b - a), list(token_sets(texts[a:b], width))


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class numbers (0 for an empty set) and sizes of sets, and their tokens one after another."""
    sizes = np.array([len(s) for s in sets], np.int64)
    some = sizes > 0
    tokens = np.concatenate([np.empty(0, np.uint64), *sets])
    ids = np.zeros(len(sets), np.int64)
    ids[some] = class_numbers(tokens, np.cumsum(np.r_[0, sizes[some]])[:-1], sizes[some])
    return ids, sizes, tokens


def _extra(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles prefixes in the order of hashes have in common, at least, where a set of such a size is the smaller one of two similar ones."""
    return sizes * (100 - percent) // (100 * MORE) + 1


def prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of sets are their prefixes in the order of hashes.

    Of the shingles that two similar sets have in common, percent of either or more, the first ``_extra`` are then in both prefixes.
    """
    return np.minimum(sizes, sizes - -(-percent * sizes // 100) + _extra(sizes, percent))


def least(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of its prefix a set shares, at least, if it is similar to another one, which may be smaller."""
    return _extra(-(-percent * sizes // 100), percent)


_DOC = np.dtype([("known", "u1"), ("doc_id", "i8"), ("th", "i8"), ("id", "i8"), ("n", "i8")])
_SCANNED = "part int, ids binary, counts binary, doc_id long, th long, id long, n long"
_FIELDS = [(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in PACKED.split(", ")]


def _once(ids: np.ndarray) -> np.ndarray:
    """Whether each class number is the first one of its kind in a step: copies in a step are packed once."""
    out = np.zeros(len(ids), bool)
    out[np.unique(ids, return_index=True)[1]] = True
    return out


def scan(docs: DataFrame, parts: int, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """In one pass over the texts: doc_id, th (hash of the text), id (class) and n (size of the set) of every document; and how many
    shingles of its prefix in the order of hashes each class shares, packed and dealt by class: part, ids, counts.

    Shingles are dealt by their buckets; documents travel with them in packed rows, so that nothing is read or written twice.
    """
    n = few_buckets(table_bytes(docs), MORE * BUCKET_BYTES)
    schema = pa.schema([*_FIELDS, ("docs", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _steps(batches, width):
            ids, sizes, _ = _numbered(sets)
            rows = np.zeros(len(sets), _DOC)
            rows["known"], rows["doc_id"] = np.asarray(part.column("doc_id").is_valid()), np.asarray(part.column("doc_id").fill_null(0))
            rows["th"], rows["id"], rows["n"] = np.asarray(part.column("th")), ids, sizes
            once, held = _once(ids), prefix(sizes, percent)
            first = [s[:k] for s, k, o in zip(sets, held.tolist(), once.tolist(), strict=True) if o]
            columns = packed(ids[once], held[once], np.concatenate([np.empty(0, np.uint64), *first]), n)
            columns["docs"] = pa.nulls(len(columns["bucket"]), pa.binary())
            yield pa.record_batch([columns[f.name] for f in schema], schema=schema)
            own = {"bucket": pa.array([int(mix(rows["th"][:1].view(np.uint64))[0] % np.uint64(n))], pa.int32()), "docs": pa.array([rows.tobytes()], pa.binary())}
            yield pa.record_batch([own.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    names = [f.split()[0] for f in _SCANNED.split(", ")]

    @released
    def find(table: pa.Table) -> pa.Table:
        told = table.column("docs").is_valid()
        rows = np.concatenate([np.empty(0, _DOC), *(np.frombuffer(x.as_buffer(), _DOC) for x in table.column("docs").drop_null())])
        ids = pa.array(np.ascontiguousarray(rows["doc_id"]), pa.int64(), mask=rows["known"] == 0)
        plain = pa.table([*(pa.nulls(len(rows), k) for k in (pa.int32(), *[pa.binary()] * 2)), ids, *(pa.array(np.ascontiguousarray(rows[f])) for f in ("th", "id", "n"))], names=names)
        own, counts = np.unique(shared(table.filter(pc.invert(told)))[0], return_counts=True)
        part, ids, _, counts = dealt(own, own, counts.astype(np.int32), parts)
        return pa.concat_tables([plain, pa.table([part, ids, counts, *(pa.nulls(len(part), pa.int64()) for _ in range(4))], names=names)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    both = written(texts.mapInArrow(make, f"{PACKED}, docs binary").groupBy("bucket").applyInArrow(find, _SCANNED), "scanned")
    return both.where("part is null").select("doc_id", "th", "id", "n"), both.where("part is not null").select("part", "ids", "counts")


def _alike(met: DataFrame, classes: DataFrame, parts: int, percent: int) -> DataFrame:
    """The classes (id, n, th) that share enough of their prefixes in the order of hashes, of which ``met`` has the counts."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in left.column(name))])
        own, of = np.unique(join("ids", np.int64), return_inverse=True)
        total = np.bincount(of, join("counts", np.int32), len(own))
        ids = np.asarray(right.column("id"))
        at = np.minimum(np.searchsorted(own, ids), max(len(own) - 1, 0))
        got = np.where(own[at] == ids, total[at], 0) if len(own) else np.zeros(len(ids))
        return right.select(["id", "n", "th"]).filter(pa.array(got >= least(np.asarray(right.column("n")), percent)))

    return met.groupBy("part").cogroup(by_class(classes, parts).groupBy("part")).applyInArrow(make, "id long, n long, th long")


def keys_of(docs: DataFrame, alike: DataFrame, parts: int, width: int) -> DataFrame:
    """The keys that two classes or more have, with their numbers of classes, packed and dealt by class: part, ids, keys, counts.

    Only texts of the classes ``alike`` are read, and what a bounded filter passes besides.
    """
    n = few_buckets(alike.agg(F.sum("n")).first()[0] or 0, BUCKET_TOKENS)
    schema = pa.schema(_FIELDS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _steps(batches, width):
            ids, sizes, tokens = _numbered(sets)
            once = _once(ids)
            columns = packed(ids[once], sizes[once], tokens[np.repeat(once, sizes)], n)
            yield pa.record_batch([columns[f.name] for f in schema], schema=schema)

    @released
    def find(table: pa.Table) -> pa.Table:
        own, keys, counts, _ = shared(table)
        return pa.table(dealt(own, keys, counts, parts), names=["part", "ids", "keys", "counts"])

    texts = likely_in(docs.select(F.xxhash64("text").alias("th"), "text"), ["th"], alike).select("text")
    return texts.mapInArrow(make, PACKED).groupBy("bucket").applyInArrow(find, "part int, ids binary, keys binary, counts binary")


def _prefixes(shared_rows: DataFrame, classes: DataFrame, parts: int, percent: int) -> DataFrame:
    """id, n, gid, pos (place of the first key), far and keys: the part of each class's prefix that other classes have, if any."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes = dict(zip(right.column("id").to_pylist(), right.column("n").to_pylist(), strict=True))
        own, keys, counts = undealt(left)
        weight = np.log2(counts)
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else []
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (n := sizes.get(int(own[a]))) is None:
                continue  # not among ``classes``
            prefix = n - -(-percent * n // 100) + 1
            alone = max(n - int(b - a), 0)  # shingles of this class only come first
            if alone < prefix:
                some = keys[a : min(b, a + prefix - alone)]
                gid = class_number(np.append(some.view(np.uint64), np.uint64(n)))
                # The more common its rarest shingles are, the nearer a set is to the middle of its near copies.
                far = -round(1000 * weight[a : a + len(some)].sum() / prefix)
                out.append((int(own[a]), n, gid, alone, far, some.tolist()))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("id", "n", "gid", "pos", "far", "keys"), columns, kinds, strict=True)})

    return shared_rows.groupBy("part").cogroup(by_class(classes, parts).groupBy("part")).applyInArrow(make, "id long, n long, gid long, pos long, far long, keys array<long>")


def sets_from(docs: DataFrame, known: DataFrame, width: int):
    """Of a table of class ids, the sets, made again from one text of each class; other texts are passed by a bounded filter."""

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = likely_in(known, ["id"], ids).join(ids, "id").groupBy("id").agg(F.min("th").alias("th"))
        wanted = written(wanted, "wanted")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: set[int] = set()
            for _, sets in _steps(batches, width):
                rows = {i: s.tobytes() for i, s in zip(_numbered(sets)[0].tolist(), sets, strict=True) if len(s) and i not in last}
                last = set(rows) if len(last) > 10_000 else last | set(rows)
                yield pa.record_batch([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["id", "tokens"])

        found = likely_in(docs.select(F.xxhash64("text").alias("th"), "text"), ["th"], wanted).select("text").mapInArrow(make, "id long, tokens binary")
        return found.join(wanted.select("id"), "id").dropDuplicates(["id"])

    return sets_of


def document_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The facts of all documents, and id and label of the classes that are linked with another."""
    parts = buckets(docs)
    known, met = scan(docs, parts, width, percent)
    classes = known.where("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.min("th").alias("th"))
    alike = written(_alike(met, classes, parts, percent), "alike")
    keys = written(keys_of(docs, alike, parts, width), "keys")
    prefixes = written(_prefixes(keys, alike.select("id", "n"), parts, percent), "prefixes")
    groups = prefixes.groupBy("gid").agg(F.min(F.struct("n", "pos", "far", "keys")).alias("g")).select("gid", "g.n", "g.pos", "g.far", F.posexplode("g.keys").alias("k", "key"))
    postings = groups.select("key", "gid", "n", (F.col("pos") + F.col("k")).alias("pos"), "far")
    return known, link(postings, prefixes.select("gid", "id"), sets_from(docs, known, width), percent)


def components_of(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles and component_id of every document, and fd, ft: doc_id and th of its component's first one (null: it is alone)."""
    known, labels = document_classes(docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th")).alias("f")
    classes = known.where("n > 0").groupBy("id").agg(first, F.count("*").alias("c")).join(labels, "id", "left")
    # Only classes with other documents in their component come back to the documents.
    classes = written(classes.where("label is not null or c > 1").select("id", F.coalesce("label", "id").alias("label"), "f"), "classes")
    of = classes.join(classes.groupBy("label").agg(F.min("f").alias("k")), "label")
    salt = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    of = written(of.select("id", F.col("k.doc_id").alias("fd"), F.col("k.th").alias("ft"), F.lit(True).alias("more")), "components")
    # A class of very many copies is dealt by salts.
    out = known.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")).join(of.select("*", salt), ["id", "salt"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("more"), F.col("fd")).otherwise(F.col("doc_id")).alias("component_id"), "fd", "ft")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns; documents without words stay."""
    of = components_of(docs, width, percent).where("ft is not null")
    told = of.select("doc_id", "th", (F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft"))).alias("keep"))
    told = written(told.groupBy("doc_id", "th").agg(F.first("keep").alias("keep"), F.count("*").alias("c")), "told")
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("_row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_th"))
    rows = told_apart(rows, ["_th", "_id"], told.select(F.col("th").alias("_th"), F.col("doc_id").alias("_id")))
    # Rows outside of the slots stay without a shuffle.
    apart = rows.where("_in is null").select("_row.*")
    asked = rows.where("_in").join(told, (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    asked = asked.where(F.coalesce("keep", F.lit(True)))
    alike = Window.partitionBy("_id", "_th").orderBy(F.lit(0))
    again = asked.where("c > 1").withColumn("_rn", F.row_number().over(alike)).where("_rn = 1").select("_row.*")
    return apart.unionByName(asked.where("c is null or c = 1").select("_row.*")).unionByName(again)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return components_of(docs).select("doc_id", "n_shingles", "component_id")


# The same in SQL, over a table documents whose ids are distinct: all pairs of documents that share a shingle are counted.
ORACLE = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sh as (
  select doc_id, unnest(list_distinct(case when len(w) >= {WIDTH} then list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w
), n as (
  select doc_id, count(s) as n from w left join sh using (doc_id) group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by all
), linked as (
  select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {PERCENT} * (a.n + b.n - c)
), ways as (
  select x, y from linked union all select y, x from linked
), reach(doc_id, other) as (
  select doc_id, doc_id from n union select r.doc_id, b.y from reach r join ways b on b.x = r.other
)
select doc_id, n as n_shingles, min(other) as component_id from reach join n using (doc_id) group by all
"""
