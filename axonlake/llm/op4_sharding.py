"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by a 128-bit hash of the text; groups that are larger than a fair part of what the larger ones leave come after all
others and have a shard each, so that none parts the others into stretches of uneven size. The smallest shard capacity for which a greedy
walk over the ordered group sizes needs at most n shards is found by binary search. The search runs on the driver
over a bounded histogram of key ranges: a walk that may stop anywhere in a range bounds the capacity from below,
one that stops between ranges bounds it from above, and only ranges in which a walk between both bounds can stop
are split further, a bounded number at a time, until the bounds meet. The cuts keep to the capacity found, as near to equal
sizes as it allows.

Plan: one pass over the texts keeps (id, size, crc, two hashes); everything later reads that narrow table.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, kept, saved, table

#: Bits by which a level splits ranges of keys: a level gives about 2**LEVEL_BITS ranges at most.
LEVEL_BITS = 14
#: Ranges whose groups number fewer than this in all are read group by group.
LEAF_GROUPS = 1 << LEVEL_BITS


def _unsigned(c: Column) -> Column:
    """Orders the 64-bit hash from 0: the sign bit is flipped away by a shift to 63 bits."""
    return F.shiftrightunsigned(c, 1)


class Atom(NamedTuple):
    """A range of keys: k1 from start on, its lower `shift` bits free. Of one group alone, it can't be cut; k2 tells groups of equal k1 apart."""

    start: int
    k2: int | None
    shift: int
    size: int
    groups: int


def _walk(prefix: list[int], atoms: list[Atom], capacity: int, shards: int, inside: bool, at: int = 0) -> list[int] | None:
    """Where the greedy walk ends each shard, in size units, or None if it needs more shards.

    inside: it may stop anywhere in a range of several groups, so no real walk gets further; else only between ranges.
    """
    ends, total = [], prefix[-1]
    for _ in range(shards):
        if at + capacity >= total:
            return [*ends, total]
        i = bisect_right(prefix, at + capacity) - 1
        end = at + capacity if inside and atoms[i].groups > 1 else prefix[i]
        if end <= at:
            return None
        ends.append(end)
        at = end
    return None


def _least(prefix: list[int], atoms: list[Atom], shards: int, inside: bool, low: int) -> int:
    """Smallest capacity of low or more for which the walk suffices."""
    high = prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if _walk(prefix, atoms, mid, shards, inside) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _prefix(atoms: list[Atom]) -> list[int]:
    prefix = [0]
    for a in atoms:
        prefix.append(prefix[-1] + a.size)
    return prefix


def _to_split(atoms: list[Atom], prefix: list[int], shards: int, low: int, high: int) -> list[int]:
    """Ranges of several groups in which a walk with a capacity from low to high may stop; first those larger than low."""
    large = [i for i, a in enumerate(atoms) if a.size > low and a.groups > 1]
    if large:  # fewer than shards
        return large
    near: set[int] = set()
    first = last = 0
    for _ in range(shards):
        first = prefix[bisect_right(prefix, first + low) - 1]  # no range is larger than low, so this goes on
        last = min(prefix[-1], last + high)
        near.update(range(bisect_right(prefix, first) - 1, min(bisect_right(prefix, last), len(atoms))))
    several = [i for i in near if i < len(atoms) and atoms[i].groups > 1]
    return sorted(several, key=lambda i: -atoms[i].size)[: 1 << LEVEL_BITS - 1]


def _heavy(sizes: list[int], shards: int) -> list[int]:
    """Items larger than a fair part of what the larger ones leave: each gets a shard to itself. Fewer than shards."""
    order, total, n = sorted(range(len(sizes)), key=lambda i: -sizes[i]), sum(sizes), 0
    while n < min(len(sizes), shards - 1) and sizes[order[n]] * (shards - n) > total:
        total -= sizes[order[n]]
        n += 1
    return sorted(order[:n])


def _balanced(prefix: list[int], atoms: list[Atom], capacity: int, shards: int) -> list[int]:
    """First atom of each shard but the first: a shard takes its part of what is left, up to the capacity, and so much that the rest fits."""
    cuts, at, total = [], 0, prefix[-1]
    heavy = _heavy([a.size for a in atoms], shards)
    for left in range(shards, 1, -1):
        most = bisect_right(prefix, prefix[at] + capacity) - 1
        alone = [i for i in heavy if i >= at]
        part = (total - prefix[at] - sum(atoms[i].size for i in alone)) // max(1, left - len(alone))
        end = bisect_right(prefix, prefix[at] + part) - 1
        if end < len(atoms) and prefix[end + 1] - prefix[at] - part < prefix[at] + part - prefix[end]:
            end += 1  # nearer
        if alone:
            end = at + 1 if alone[0] == at else min(end, alone[0])
        end = min(max(end, at + 1), most)

        def fits(i: int, left: int = left) -> bool:
            return _walk(prefix, atoms, capacity, left - 1, False, prefix[i]) is not None

        if not fits(end):
            low, high = end + 1, most  # the further a shard reaches, the less is left: the nearest end that fits
            while low < high:
                mid = (low + high) // 2
                if fits(mid):
                    high = mid
                else:
                    low = mid + 1
            end = low
        at = end
        if at >= len(atoms):
            break
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> list[tuple[int, int | None]]:
    """First key (k1, k2) of each shard but the first. groups: k1 long (63 bits), k2 long, size long; k2 is null where k1 suffices.

    A level brings about 2**LEVEL_BITS rows at most to the driver, whatever the groups; each splits every range chosen at
    least in two, so there are 63 levels at most, and about log(groups) of them in practice.
    """
    top = groups.agg(F.sum("size"), F.max("size")).first()
    if not top[0]:
        return []
    atoms = _split(groups, [Atom(0, None, 63, top[0], 2)], LEVEL_BITS)
    low = max(top[1], -(-top[0] // shards))
    while True:
        prefix = _prefix(atoms)
        high = _least(prefix, atoms, shards, False, low)
        low = _least(prefix, atoms, shards, True, low)
        if low == high:
            return [(atoms[i].start, atoms[i].k2) for i in _balanced(prefix, atoms, high, shards)]
        chosen = set(_to_split(atoms, prefix, shards, low, high))
        split = [atoms[i] for i in chosen]
        bits = max(1, LEVEL_BITS - (len(split) - 1).bit_length())
        atoms = sorted([a for i, a in enumerate(atoms) if i not in chosen] + _split(groups, split, bits), key=lambda a: (a.start, a.k2 is not None, a.k2 or 0))


def _split(groups: DataFrame, split: list[Atom], bits: int) -> list[Atom]:
    """The ranges as smaller ones; as single groups where these are few, or where equal k1 leave nothing else.

    Rows find their range by an equality with its shift and prefix, a join with a table of bounded size for each shift.
    """
    spark, out = groups.sparkSession, []
    alone = sum(a.groups for a in split) <= LEAF_GROUPS
    for shift in sorted({a.shift for a in split}):
        mine = [(a.start >> shift,) for a in split if a.shift == shift]
        rows = groups.withColumn("c", F.shiftright("k1", shift)).join(F.broadcast(spark.createDataFrame(mine, "c long")), "c") if shift < 63 else groups
        if shift == 0 or (alone and shift < 63):
            out += [Atom(r["k1"], r["k2"], 0, r["size"], 1) for r in rows.select("k1", "k2", "size").collect()]
            continue
        to = max(0, shift - bits)
        parts = rows.groupBy(F.shiftright("k1", to).alias("part")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        out += [Atom(r["part"] << to, None, to, r["s"], r["n"]) for r in parts]
    return out


def heavy_groups(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Keys of the groups that get a shard to themselves, fewer than shards, largest first: a group is one if it has more than the fair part of what the larger ones leave."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    out = []
    for r in groups.orderBy(F.desc("size"), "k1", "k2").limit(shards - 1).collect():
        if r["size"] * (shards - len(out)) <= total:
            break
        total -= r["size"]
        out.append((r["k1"], r["k2"]))
    return out


def _is(key: tuple[int, int]) -> Column:
    return (F.col("k1") == key[0]) & (F.col("k2") == key[1])


def shard_of(cuts: list[tuple[int, int]], heavy: list[tuple[int, int]], shards: int) -> Column:
    """Shard of a row by comparison of its key with the cuts and the heavy groups' keys, which have the last shards: no join."""
    out = F.lit(0)
    for k1, k2 in cuts:
        past = F.col("k1") >= k1 if k2 is None else (F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))
        out = out + past.cast("int")
    for k, key in enumerate(heavy):
        out = F.when(_is(key), F.lit(shards - len(heavy) + k)).otherwise(out)
    return out.cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard so that the largest shard's bytes are as few as contiguous groups allow.

    Returns the id, size, text_crc32, shard and slot (0, 1, ... in each shard). Rows of equal text share a
    shard; groups of more than their part of all bytes have the last shards for themselves, and the other shards stay near equal. A null text has no bytes:
    size 1, crc 0, and is a group of its own beside that of empty texts. Repeated rows each get a slot of their own; an empty table
    gives no rows; other columns are ignored. Ties: equal hashes of 126 bits count as equal texts; rows of equal text and id are
    numbered in any order. Slots count the rows of a shard within the tasks that read the narrow table, and then over tasks, so no
    task sorts more rows than it read, however many are alike.
    """
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        _unsigned(F.xxhash64(F.lit(17), text)).alias("k1"),
        _unsigned(F.xxhash64(text, F.lit(71))).alias("k2"),
    )
    rows = kept(narrow, "shard-rows", cell="cell")
    groups = saved(rows.groupBy("k1", "k2").agg(F.sum("size").alias("size")), "shard-groups")
    try:
        heavy = heavy_groups(groups, shards)
        rest = groups
        for key in heavy:
            rest = rest.where(~_is(key))
        cuts = minimax_cuts(rest, shards - len(heavy))
    finally:
        drop(groups)
    placed = rows.withColumn("shard", shard_of(cuts, heavy, shards))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell").count()  # a row for each task and shard
    before = counts.select("shard", "cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy("k1", "k2", "doc_id")
    out = placed.withColumn("at", F.row_number().over(order)).join(before, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
