"""Exact links between sets of 64-bit tokens from posting lists, without all pairs of a list.

A set is known by its class number (a hash of the whole set), so that exact copies are one class from the start.  Classes
with the same postings and size are one group.  Links are found in these steps:

1. Each list's most central group (least ``far``) of each band of sizes is paired with the band's others, by the groups' first classes,
   and each group's first class with its others: stars, linear in the lists' and groups' lengths.  Verified pairs give components.
2. In lists in which components still meet and that are long, what is outside of the largest one is paired with its most central
   member and with drawn ones: stars again, in one step.  Where lists come from MinHash bands, the sets in them are first put into new lists, by
   the rarest of their tokens (a prefix filter), which a token common to many sets does not make long.  Only the rows outside of a list's largest
   component are joined with what is known of the list.
3. In lists whose classes are still in more than one component, every pair of groups from different components is
   tried, unless both are in the list's largest one, under the size, position and bitmap filters; the pairs that pass are
   expanded to their classes and verified.

Two classes that share a list are therefore in one component or have been compared: no link between components is lost.

Cases: an empty set has no token and meets none; ties between heads go by group number; a list of one class gives no pair; empty postings give
no label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import likely_in, mark, partitions, settled, written
from quillspark.llm.components import components
from quillspark.llm.shingles import release, released
from quillspark.scratch import drop, since

PERCENT = 80
#: Further stars that are tried, at once, before pairs are.
MORE_STARS = 3
#: Pairs for each row of a list up to which no further stars are worth their while.
FEW_PAIRS = 8
#: Bytes of the table that a bucket of tokens stands for, and the bounds of the number of buckets: beyond the upper one a step's
#: tokens would be rows of their own.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 64, 1 << 18
#: The least number of buckets where their number does not follow the partitions'.
FEW_BUCKETS = 16
#: Tokens of sets that are packed at a time, or those of one set.
STEP_TOKENS = 1 << 18
#: A run of a packed row is as long as two bytes can say.
LONGEST_RUN = 65535

PACKED = "bucket int, ids binary, counts binary, low binary, high binary"
_SPREAD = 0x9E3779B97F4A7C15


def table_bytes(df: DataFrame) -> int:
    """The size of a table by the plan's statistics: files' sizes, without reading them; 0 where the plan does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def buckets(df: DataFrame) -> int:
    """Buckets for the tokens of a table: their number grows with its bytes, so that a bucket does not."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, partitions(df.sparkSession), -(-table_bytes(df) // BUCKET_BYTES)))


def few_buckets(size: int, most: int) -> int:
    """Buckets of at most ``most`` (bytes, or tokens), of ``size`` in all: the fewer they are, the more tokens share the id of their set."""
    return min(MOST_BUCKETS, max(FEW_BUCKETS, -(-size // most)))


def packed(ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, n: int) -> dict[str, pa.Array]:
    """Columns of (bucket, ids, counts, low, high): the tokens of the sets ``ids``, ``counts`` of each, dealt into ``n`` buckets.

    Of a token's 64 bits, 48 are stored and the bucket adds the others' remainder.
    """
    if not len(tokens):
        return {f.split()[0]: pa.array([], pa.int32() if f.endswith("int") else pa.binary()) for f in PACKED.split(", ")}
    bucket = ((tokens >> np.uint64(32)) % np.uint64(n)).astype(np.uint16 if n <= 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, tokens = bucket[order], np.repeat(np.arange(len(ids)), counts)[order], tokens[order]
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]
    at = np.arange(len(new))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    runs = np.flatnonzero(since % LONGEST_RUN == 0)
    lengths = np.diff(np.r_[runs, len(new)]).astype(np.uint16)
    owners = np.asarray(ids, np.int64)[owner[runs]]
    low, high = tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint16)
    edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
    run_edges = np.searchsorted(runs, edges)
    part = lambda x, cuts: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
    return {"bucket": pa.array(bucket[edges[:-1]].astype(np.int32)), "ids": part(owners, run_edges), "counts": part(lengths, run_edges), "low": part(low, edges), "high": part(high, edges)}


def shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's packed rows: ids, whole keys and counts of the keys that two ids or more have, by key; and the ids that come twice or more."""
    none = np.empty(0, np.int64)
    if not len(table):
        return none, none, none.astype(np.int32), none
    joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
    own = np.repeat(joined("ids", np.int64), joined("counts", np.uint16))
    key = joined("low", np.uint32).astype(np.uint64)
    key |= joined("high", np.uint16).astype(np.uint64) << np.uint64(32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.r_[False, key[1:] == key[:-1]]
    # Keys of one row only are most; they go before anything else is done.
    many = same | np.r_[same[1:], False]
    own, key = own[order[many]], key[many]
    del order, same, many
    order = np.lexsort((own, key))
    own, key = own[order], key[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])] if len(own) else np.empty(0, bool)
    again = np.unique(own[~new])
    own, key = own[new], key[new]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else none
    count = np.diff(np.r_[begin, len(key)])
    count = np.repeat(count, count)
    key += np.uint64(table.column("bucket")[0].as_py() * _SPREAD & (2**64 - 1))
    return own[count > 1], key[count > 1].view(np.int64), count[count > 1].astype(np.int32), again


def dealt(own: np.ndarray, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[pa.Array]:
    """Columns of (part, ids, keys, counts): what ``shared`` has found, packed and dealt by class."""
    part = (own.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    own, keys, counts, part = own[order], keys[order], counts[order], part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.empty(0, np.int64)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
    return [pa.array(part[edges[:-1]], pa.int32()), cut(own), cut(keys), cut(counts)]


def by_class(df: DataFrame, parts: int) -> DataFrame:
    """``df`` with the part that ``dealt`` gives its class (id)."""
    return df.withColumn("part", F.expr(f"cast(case when id >= 0 then id % {parts} else pmod(id % {parts} + {2**64 % parts}, {parts}) end as int)"))


def undealt(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys and counts of a part, by id, the rarest keys first."""
    join = lambda n, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(n))])
    own, keys, counts = join("ids", np.int64), join("keys", np.int64), join("counts", np.int32)
    order = np.lexsort((keys, counts, own))
    return own[order], keys[order], counts[order]


def _fits(left: str, right: str, bits: list[str], percent: int, place: bool = True) -> Column:
    """Bounds that no pair as similar as asked for fails, on columns with these prefixes.

    Size; the place of the pair's first common token in either set (null: not known); and bitmaps (null: none): sets differ in as many
    tokens as their bitmaps have different bits, or more.
    """
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    out = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    if place:
        most = F.least(n - F.col(f"{left}pos"), m - F.col(f"{right}pos"))
        out &= F.coalesce((100 + percent) * most >= percent * (n + m), F.lit(True))
    for kind in sorted({b[0] for b in bits}):
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{left}{b}").bitwiseXOR(F.col(f"{right}{b}"))) for b in bits if b[0] == kind])
        out &= (100 + percent) * (n + m - F.coalesce(differ, F.lit(0))) >= 2 * percent * (n + m)
    return out


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets are as similar as asked for."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def by_rarest(sets: DataFrame, percent: int) -> DataFrame:
    """gid, key and pos of the rarest tokens of each set (id, tokens): two sets as similar as asked for share one of them.

    Tokens are packed by bucket to be counted, and those that two sets or more have come back packed by set: no token is a row.
    """
    n = buckets(sets)
    schema = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in PACKED.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = np.asarray(batch.column("id")), np.asarray(pc.binary_length(batch.column("tokens"))) // 8
            step = np.cumsum(sizes) // STEP_TOKENS
            edges = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(ids) else np.empty(0, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                tokens = np.frombuffer(b"".join(batch.column("tokens").slice(a, b - a).to_pylist()), np.uint64)
                columns = packed(ids[a:b], sizes[a:b], tokens, n)
                yield pa.record_batch([columns[f.name] for f in schema], schema=schema)

    @released
    def find(table: pa.Table) -> pa.Table:
        own, keys, counts, _ = shared(table)
        return pa.table(dealt(own, keys, counts, n), names=["part", "ids", "keys", "counts"])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        own, keys, _ = undealt(left)
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
        held = np.diff(np.r_[begin, len(own)])
        order = np.argsort(np.asarray(right.column("id")))
        at = order[np.searchsorted(np.asarray(right.column("id")), own[begin], sorter=order)]
        size = np.asarray(right.column("n"))[at]
        # Tokens of this set only come first.
        pos = np.arange(len(own)) + np.repeat(size - held - begin, held)
        some = pos <= np.repeat(size - -(-percent * size // 100), held)
        out = pa.table({"gid": own[some], "key": keys[some], "pos": pos[some]})
        release()
        return out

    keys = sets.select("id", "tokens").mapInArrow(pack, PACKED).groupBy("bucket").applyInArrow(find, "part int, ids binary, keys binary, counts binary")
    sizes = by_class(sets.select("id", F.expr("octet_length(tokens) div 8").alias("n")), n)
    return keys.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(rank, "gid long, key long, pos long")


def link(postings: DataFrame, members: DataFrame | None, sets_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT, banded: bool = False) -> DataFrame:
    """``linked``, as a table that is all that stays in the shared folder."""
    begin = mark()
    return settled(linked(postings, members, sets_of, percent, banded), "labels", begin)


def linked(postings: DataFrame, members: DataFrame | None, sets_of: Callable[[DataFrame], DataFrame], percent: int, banded: bool) -> DataFrame:
    """id and label of every class that is linked with another.

    ``postings``: key, gid, n (size), pos (place of the key in the set's order, or null), far (the less, the more the set is expected
    to have in common with its list) and, if any, the words of bitmaps (those whose columns begin alike are one); ``members``: gid, id (None: groups are classes);
    ``sets_of``: from a table of ids, their sets as id and tokens (sorted, packed); ``banded``: whether keys are MinHash bands.
    """
    postings = written(postings, "postings")
    bits = [c for c in postings.columns if c not in ("key", "gid", "n", "pos", "far")]
    own = ["gid", "n", "pos", *bits]
    # Sizes in one band pass the size filter with each other, so a star's head suits its whole list.
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / (math.log(100 / min(percent, 99)) / 2)).cast("int").alias("band")
    heads = postings.groupBy("key", band).agg(F.min(F.struct("far", *own)).alias("h"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("key", "band", *(F.col(f"h.{c}").alias(f"h_{c}") for c in own))
    star = postings.select("*", band).join(heads, ["key", "band"]).where((F.col("gid") != F.col("h_gid")) & _fits("", "h_", bits, percent, place=False))
    star = star.select(F.col("h_gid").alias("hg"), "gid").distinct()
    if members is None:
        pairs = star.select(F.col("hg").alias("a"), F.col("gid").alias("b"))
    else:
        members = written(members, "members")
        first = written(members.groupBy("gid").agg(F.min("id").alias("first")), "first")
        inside = members.join(first, "gid").select(F.col("first").alias("a"), F.col("id").alias("b"))
        across = star.join(first.select(F.col("gid").alias("hg"), F.col("first").alias("a")), "hg").join(first.withColumnsRenamed({"first": "b"}), "gid").select("a", "b")
        pairs = inside.union(across)
    begin = mark()
    links = [settled(verified(pairs, sets_of, percent), "links", begin)]

    held: list = []

    def labelled(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int, int]:
        """The labels so far, every class's group and component, the lists' rows with their components, the lists in which components meet (with their
        largest one and numbers of rows), and how many pairs and rows these are.  The rows and lists of the call before go."""
        begin = mark()
        labels = settled(components(reduce(DataFrame.union, links), "a", "b"), "labels", begin)
        if members is None:
            rows = postings.join(labels.withColumnsRenamed({"id": "gid"}), "gid", "left").withColumn("comp", F.coalesce("label", "gid")).drop("label")
            rows, placed = rows.withColumn("some", F.col("gid")), None
        else:
            placed = written(members.join(labels, "id", "left").select("gid", "id", F.coalesce("label", "id").alias("comp")), "placed")
            rows = postings.join(placed.groupBy("gid", "comp").agg(F.min("id").alias("some")), "gid")
        begin = mark()
        rows = written(rows, "rows")
        drop(held)
        mixed = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top"))
        mixed = written(mixed.where("comps > 1").select("key", F.col("top.comp").alias("major"), (F.col("all") - F.col("top.c")).alias("apart"), "all"), "mixed")
        held[:] = since(begin)
        work, size = mixed.agg(F.coalesce(F.sum(F.col("apart") * F.col("all")), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        return labels, placed, rows, mixed, work, size

    def outside() -> DataFrame:
        """The rows of lists in which components meet that are not in the list's largest one."""
        return written(rows.join(mixed.select("key", "major"), "key").where("comp <> major"), "outside")

    labels, placed, rows, mixed, work, size = labelled(postings)
    if banded and work > FEW_PAIRS * size:
        begin = mark()
        facts = written(rows.join(mixed, "key", "left_semi").select(*own, "far").dropDuplicates(["gid"]), "facts")
        sets = written(sets_of(facts.select(F.col("gid").alias("id"))), "sets")
        lists = by_rarest(sets, percent).join(facts.drop("pos"), "gid")
        done = since(begin)
        labels, placed, rows, mixed, work, size = labelled(lists.select(*postings.columns))
        drop(done)
    if not size:
        return labels
    apart, both = outside(), likely_in(rows, ["key"], mixed)
    if work > FEW_PAIRS * size:  # where pairs are few for each row, they are tried at once
        draws = [F.xxhash64(F.lit(k), "gid") if k else F.col("far") for k in range(MORE_STARS)]
        inner = both.groupBy("key", "comp", band).agg(*(F.min(F.struct(x.alias("draw"), *own, "some")).alias(f"h{k}") for k, x in enumerate(draws)))
        inner = inner.join(mixed.select("key", F.col("major").alias("comp")), ["key", "comp"])
        inner = inner.select("key", "band", F.explode(F.array_distinct(F.array(*(F.col(f"h{k}").dropFields("draw") for k in range(MORE_STARS))))).alias("h"))
        inner = inner.select("key", "band", F.col("h.some").alias("a"), *(F.col(f"h.{c}").alias(f"h_{c}") for c in own))
        again = apart.select("*", band).join(inner, ["key", "band"]).where(_fits("", "h_", bits, percent)).select("a", F.col("some").alias("b"))
        begin = mark()
        found = settled(verified(again, sets_of, percent), "links", begin)
        if not found.isEmpty():
            links.append(found)
            again = both.select(*postings.columns)
            labels, placed, rows, mixed, work, size = labelled(again if members is None else again.distinct())
            if not size:
                return labels
            apart, both = outside(), rows
    left = apart.select("key", "major", *(F.col(c).alias(f"l_{c}") for c in (*own, "comp")))
    right = both.select("key", *(F.col(c).alias(f"r_{c}") for c in (*own, "comp")))
    other = (F.col("l_comp") != F.col("r_comp")) & ((F.col("r_comp") == F.col("major")) | (F.col("l_comp") < F.col("r_comp")))
    cross = left.join(right, "key").where(other & _fits("l_", "r_", bits, percent))
    if members is None:
        more = cross.select(F.col("l_gid").alias("a"), F.col("r_gid").alias("b"))
    else:
        cross = cross.select("l_gid", "l_comp", "r_gid", "r_comp").distinct()
        of = lambda side: placed.select(F.col("gid").alias(f"{side}_gid"), F.col("comp").alias(f"{side}_comp"), F.col("id").alias("a" if side == "l" else "b"))
        more = cross.join(of("l"), ["l_gid", "l_comp"]).join(of("r"), ["r_gid", "r_comp"]).select("a", "b")
    begin = mark()
    last = settled(verified(more, sets_of, percent), "links", begin)
    return labels if last.isEmpty() else components(reduce(DataFrame.union, [*links, last]), "a", "b")
