"""Minimax contiguous partition of atomic groups into shards.

An atomic group is all rows with equal texts; groups are put in the order of their texts' digests.  The smallest shard capacity for which
the groups, taken in order, fill no more shards than there are is found by binary search with a greedy check, and the order is
cut where the greedy check cuts it.  Where that capacity is the size of one group (a hot group of copies), the group is a shard of its own, in its
place, and the rest of the order is cut into the shards that are left by the same search, so that these do not stay empty.

Groups are too many for the driver, so it gets cells: ranges of digests with their sizes, at most CELLS at a time.  Cuts can only fall into
some of the cells; these are refined by longer digests, and the search is made again, until all cells that matter are single groups: the capacity and the
cuts are those of the groups themselves.

Slots are ranks counted on three levels, so no shard's rows meet in one task.

Cases: a null text has no bytes and the checksum of the empty text; repeated rows and copies stay together; ties in rank go by document
id; fewer groups than shards leave the last shards empty; an empty table gives no row; a very long text is a row like others; other
columns are not read.  Laws: ``bytes`` (sizes near equal) and ``rows`` (counts near equal).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

SHARDS = 24
#: Hexadecimal digits of the digest that a cell has at first, and in all.
FIRST_DIGITS, DIGITS = 4, 32
#: Cells that the driver gets at a time.
CELLS = 16**FIRST_DIGITS
#: Shares that a cell's rows are dealt into to be ranked.
SALTS = 256


class Cell(NamedTuple):
    """All texts whose digest begins with ``prefix``: their weight, number, and whether they are one group."""

    prefix: str
    weight: int
    rows: int
    single: bool


def greedy_cuts(upto: list[int], capacity: int, begin: int = 0, end: int | None = None) -> list[int] | None:
    """Ends of the shards that are filled in turn, from units ``begin`` to ``end`` with running totals ``upto`` (from 0); None if one is too large."""
    cuts, at, end = [], begin, len(upto) - 1 if end is None else end
    while at < end:
        to = min(bisect_right(upto, upto[at] + capacity) - 1, end)
        if to == at:
            return None
        cuts.append(at := to)
    return cuts


def smallest_capacity(sizes: list[int], shards: int, segments: list[tuple[int, int]] | None = None) -> int:
    """The least capacity with which the units of all segments, in order, need no more shards than there are."""
    upto = [0, *accumulate(sizes)]
    segments = [(0, len(sizes))] if segments is None else segments
    total = sum(upto[b] - upto[a] for a, b in segments)
    low, high = max([-(-total // max(1, shards)), *(s for a, b in segments for s in sizes[a:b])]), max(total, 0)
    while low < high:
        middle = (low + high) // 2
        if sum(len(greedy_cuts(upto, middle, a, b)) for a, b in segments) > shards:
            low = middle + 1
        else:
            high = middle
    return low


class Plan(NamedTuple):
    """The cells behind which each shard ends, in order, and the cells that have to be refined before that is certain."""

    ends: list[int]
    unsure: set[int]


def plan(cells: list[Cell], shards: int) -> Plan:
    """The partition of cells in order; cells of several groups are split by no cut, but are named if one could."""
    sizes, n = [c.weight for c in cells], len(cells)
    upto, alone, left = [0, *accumulate(sizes)], [], shards
    while True:
        edges = [-1, *sorted(alone), n]
        segments = [(a + 1, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a + 1]
        if not segments:
            return Plan(sorted(x + 1 for x in alone), set())
        high = smallest_capacity(sizes, left, segments)
        largest = max((i for a, b in segments for i in range(a, b)), key=lambda i: (sizes[i], -i))
        if sizes[largest] < high:
            break
        if not cells[largest].single:
            return Plan([], {largest})
        # The capacity is that of one group, which has a shard of its own then.
        alone.append(largest)
        left -= 1
    low = _lower_bound(cells, upto, left, segments, high)
    unsure: set[int] = set()
    for a, b in segments:
        unsure |= _between(cells, upto, low, high, a, b)
    ends = sorted([x + 1 for x in alone] + [e for a, b in segments for e in greedy_cuts(upto, high, a, b)])
    return Plan(ends, unsure)


def _filled(cells: list[Cell], upto: list[int], x: int, capacity: int, end: int, split: bool) -> int:
    """Where a shard that begins at weight ``x`` ends at most (``split``: cells of several groups are cut anywhere) or at least."""
    to = x + capacity
    if to >= upto[end]:
        return upto[end]
    cell = bisect_right(upto, to) - 1
    return to if split and not cells[cell].single else max(x, upto[cell])


def _lower_bound(cells: list[Cell], upto: list[int], shards: int, segments: list[tuple[int, int]], high: int) -> int:
    """A capacity that the groups need at least: as if cells of several groups could be cut anywhere."""

    def enough(capacity: int) -> bool:
        used = 0
        for a, b in segments:
            x = upto[a]
            while x < upto[b]:
                to = _filled(cells, upto, x, capacity, b, True)
                used += 1
                if to <= x or used > shards:
                    return False
                x = to
        return used <= shards

    low = 0
    while low < high:
        middle = (low + high) // 2
        if enough(middle):
            high = middle
        else:
            low = middle + 1
    return low


def _between(cells: list[Cell], upto: list[int], low: int, high: int, a: int, b: int) -> set[int]:
    """Cells of several groups that a cut may fall into, for any capacity from ``low`` to ``high``."""
    out, least, most = set(), upto[a], upto[a]
    while least < upto[b]:
        now = _filled(cells, upto, least, low, b, False)
        most = _filled(cells, upto, most, high, b, True)
        first = bisect_right(upto, now) - 1
        last = min(bisect_right(upto, most), b)
        here = {i for i in range(max(first, a), last) if not cells[i].single and upto[i] < most and upto[i + 1] > now and most < upto[b]}
        # A cell that is filled exactly to its end is not cut.
        out |= {i for i in here if not (now == most == upto[i])}
        if now <= least:
            return out | {i for i in range(bisect_right(upto, least) - 1, b) if not cells[i].single and (upto[i + 1] - upto[i] > 0) and upto[i] <= least + high}
        least = now
    return out


def refined(cells: list[Cell], shards: int, finer: Callable[[list[str], int], list[Cell]]) -> tuple[list[Cell], list[int]]:
    """The cells and the shards' ends after as many refinements as are needed; ``finer`` gets prefixes and a number of digits."""
    while True:
        made = plan(cells, shards)
        if not made.unsure:
            return cells, made.ends
        some = [cells[i] for i in sorted(made.unsure)]
        digits = DIGITS
        if sum(c.rows for c in some) > CELLS:
            digits = max(len(c.prefix) for c in some) + 1
            while digits < DIGITS and len(some) * 16 ** (digits + 1 - min(len(c.prefix) for c in some)) <= CELLS:
                digits += 1
        cells = sorted([c for i, c in enumerate(cells) if i not in made.unsure] + finer([c.prefix for c in some], digits))


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law {law!r}: bytes or rows")
    spark, t = docs.sparkSession, F.coalesce(docs[text], F.lit("")).cast("binary")
    keyed = docs.select(docs[key].alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("digest"))
    keyed = written(keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int")), "sharding")
    weight = F.sum("size") if law == "bytes" else F.count("*")

    def collected(rows: DataFrame, digits: int) -> list[Cell]:
        of = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(weight.alias("w"), F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        return [Cell(r.prefix, r.w, r.n, r.a == r.b) for r in of.orderBy("prefix").collect()]  # at most CELLS rows

    def finer(prefixes: list[str], digits: int) -> list[Cell]:
        asked = F.broadcast(spark.createDataFrame([(p,) for p in prefixes], "prefix string"))  # at most CELLS rows
        inside = keyed
        for size in sorted({len(p) for p in prefixes}):
            inside = inside.withColumn(f"p{size}", F.substring("digest", 1, size))
        parts = [inside.join(asked.where(F.length("prefix") == size), F.col(f"p{size}") == F.col("prefix"), "left_semi") for size in sorted({len(p) for p in prefixes})]
        out: list[Cell] = []
        for p in parts:
            out += collected(p, digits)
        return out

    cells, ends = refined(collected(keyed, FIRST_DIGITS), shards, finer)
    # A shard begins at the digest that its first cell begins with: so many bounds as there are shards.
    bounds = [cells[e].prefix for e in ends[:-1]]
    place = F.lit(0)
    for b in bounds:
        place = place + (F.col("digest") >= b).cast("int")
    unit = F.substring("digest", 1, FIRST_DIGITS)
    used: dict[int, int] = {}
    upto: dict[tuple[int, str], int] = {}
    for i, c in enumerate(cells):
        k = bisect_right(ends, i)
        upto.setdefault((k, c.prefix[:FIRST_DIGITS]), used.get(k, 0))
        used[k] = used.get(k, 0) + c.rows
    # At most CELLS rows and one more for each shard.
    of = F.broadcast(spark.createDataFrame([(k, u, n) for (k, u), n in upto.items()], "shard int, unit string, unit_from long"))
    keyed = keyed.withColumn("shard", place).withColumn("unit", unit)
    inside = Window.partitionBy("shard", "unit").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("shard", "unit", "salt").agg(F.count("*").alias("n")).withColumn("salt_from", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "unit", "salt").orderBy("digest", "doc_id")))
    out = ranked.join(starts, ["shard", "unit", "salt"]).join(of, ["shard", "unit"])
    slot = (F.col("unit_from") + F.col("salt_from") + F.col("rank") - 1).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
