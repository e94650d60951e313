"""All pairs of a group's traces, by blocks: a trace travels once for each block that it meets, not once for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Traces of a block, about, and of one whose pairs are slow to measure; pairs that are measured at once; rows of a batch that leaves a task.
BLOCK = 1024
SMALL = 256
SLICE = 1 << 15
ROWS = 1 << 13
#: Equal traces that go to one block together, about, where pairs are slow to measure.
COPIES = 16


class Met:
    """The traces of two blocks that meet, or of one that meets itself: items by place, their order, and arrays by length."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.table = table
        self.items = table.column("_item").combine_chunks()
        self.codes = pc.rank(self.items, tiebreaker="dense").to_numpy().astype(np.int64)
        self.same = table.column("_same")[0].as_py()
        self.x = table.column("_x").combine_chunks()
        self.lengths = self.x.value_lengths().fill_null(-1).to_numpy()
        nulls = np.repeat(np.arange(len(self.x)), np.maximum(self.lengths, 0))[self.x.flatten().is_null().to_numpy(zero_copy_only=False)]
        #: Traces that are missing, or miss a value.
        self.holes = self.lengths < 0
        self.holes[nulls] = True
        side = table.column("_side").to_numpy()
        self.sides = [np.arange(len(side))] * 2 if self.same else [np.flatnonzero(~side), np.flatnonzero(side)]

    def arrays(self, places: np.ndarray) -> np.ndarray:
        """Traces of one length; a missing value is not a number."""
        n = max(0, int(self.lengths[places[0]]))
        return self.x.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(places), n)

    def by_length(self, side: int) -> list[np.ndarray]:
        own = self.sides[side]
        return [own[self.lengths[own] == n] for n in np.unique(self.lengths[own])]

    def rectangles(self, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, places, arrays, arrays, which of the pairs to take): each two items of the blocks once, most pairs at once."""
        right = [(q, self.arrays(q)) for q in self.by_length(1)]
        for p in self.by_length(0):
            x = self.arrays(p)
            for q, y in right:
                step = max(1, most // len(q))
                for s in range(0, len(p), step):
                    a, b = self.codes[p[s : s + step], None], self.codes[q][None, :]
                    on = a < b if self.same else a != b
                    yield p[s : s + step], q, x[s : s + step], y, on

    def ordered(self, i: np.ndarray, j: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Items of the places, the smaller one first."""
        turn = self.codes[i] > self.codes[j]
        return self.items.take(pa.array(np.where(turn, j, i))), self.items.take(pa.array(np.where(turn, i, j)))


def met_blocks(
    traces: DataFrame,
    keys: list[str],
    item: str,
    column: str,
    found: Callable[[Met], Iterator[dict]],
    schema: str,
    cells: tuple[str, str] | None = None,
    alone: Callable[[Met], dict] | None = None,
    kept: StructType | None = None,
    slow: bool = False,
) -> DataFrame:
    """(keys, columns of schema) of what found() yields for each two blocks of a group, and for each block with itself.

    found() gives columns by name. With cells, two columns of whole numbers, only blocks of the same cell and of neighbouring ones meet. A group, or
    a cell, has blocks of about BLOCK traces, told apart by a hash of the item, so a task holds two of them, however large a group is. Traces without
    a key or an item meet nothing; an empty table gives none.

    With alone, each block is looked at by itself before any two meet: alone() gives columns of kept, a value for each trace, that travel on with the
    traces in the table of Met. Where all pairs are slow to measure, blocks are small and partitions twice as many: no task has many pairs more than
    others; and a block is told by a hash of the trace, so that equal ones meet others together. More than COPIES equal ones go to several blocks.
    """
    p, q = (F.col(c) for c in cells) if cells else (F.lit(0), F.lit(0))
    rows = traces.where(F.col(item).isNotNull()).select(*keys, p.cast("long").alias("_p"), q.cast("long").alias("_q"), F.col(item).alias("_item"), F.col(column).alias("_x"))
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)] if cells else [(0, 0)]
    sizes = rows.groupBy(*keys, "_p", "_q").agg(F.ceil(F.count("*") / (min(BLOCK, SMALL) if slow else BLOCK)).alias("n"))
    shifts = F.array(*[F.struct(F.lit(a).alias("p"), F.lit(b).alias("q")) for a, b in near])
    around = sizes.select(*keys, F.explode(shifts).alias("d"), F.struct("_p", "_q", "n").alias("cell"))
    around = around.groupBy(*keys, (F.col("cell._p") + F.col("d.p")).alias("_p"), (F.col("cell._q") + F.col("d.q")).alias("_q")).agg(F.collect_list("cell").alias("around"))
    own = F.filter("around", lambda c: (c["_p"] == F.col("_p")) & (c["_q"] == F.col("_q")))[0]["n"]
    block = F.xxhash64("_item")
    if slow:
        rows = rows.withColumn("_h", F.xxhash64("_x"))
        shared = [*keys, "_p", "_q", "_h"]
        many = rows.groupBy(*shared).agg(F.ceil(F.count("*") / COPIES).alias("_parts")).where("_parts > 1")
        rows = rows.join(many, shared, "left")
        block = F.xxhash64("_h", F.pmod(block, F.coalesce("_parts", F.lit(1))))
    dealt = rows.join(around, [*keys, "_p", "_q"]).withColumn("_own", F.struct("_p", "_q", F.pmod(block, own).alias("k")))
    dealt = dealt.select(*keys, "_item", "_x", "_own", "around")
    # Pairs are slow for the bytes of their blocks: without a number of partitions of its own, adaptive execution would merge them into few tasks.
    n = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions")) * (2 if slow else 1)
    own_columns = kept.names if alone else []

    def by_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        size = table.num_rows
        for name, values in alone(Met(table.append_column("_same", pa.repeat(True, size)).append_column("_side", pa.repeat(False, size)))).items():
            table = table.append_column(name, values)
        yield from table.to_batches()

    if alone:
        dealt = dealt.repartition(n, *keys, "_own").groupBy(*keys, "_own").applyInArrow(by_itself, StructType(dealt.schema.fields + kept.fields))
    dealt = dealt.select(*keys, "_item", "_x", "_own", *own_columns, F.explode("around").alias("c")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.n") - 1)))
    other = F.struct(F.col("c._p").alias("_p"), F.col("c._q").alias("_q"), F.col("k").alias("k"))
    sent = dealt.select(*keys, F.least("_own", other).alias("_lo"), F.greatest("_own", other).alias("_hi"), (F.col("_own") > other).alias("_side"), (F.col("_own") == other).alias("_same"), "_item", "_x", *own_columns)
    names = list(keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        key = [table.column(k)[0] for k in names]
        for got in found(Met(table)):
            size = len(next(iter(got.values())))
            whole = pa.RecordBatch.from_arrays([*(pa.repeat(k, size) for k in key), *got.values()], [*names, *got])
            for s in range(0, size, ROWS):
                yield whole.slice(s, ROWS)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.select(*keys).schema.fields)
    return sent.repartition(n, *keys, "_lo", "_hi").groupBy(*keys, "_lo", "_hi").applyInArrow(meet, f"{out}, {schema}")


def _item_type(traces: DataFrame, item: str) -> str:
    return traces.schema[item].dataType.simpleString()


def paired(traces: DataFrame, keys: list[str], item: str, column: str, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], holes: bool = False, slow: bool = False) -> DataFrame:
    """(keys, i, j, dist) of all pairs i < j of a group. With holes, the distance of a trace that misses a value, or of two lengths, is null. slow: as in met_blocks()."""
    kind = _item_type(traces, item)

    def found(met: Met) -> Iterator[dict]:
        for p, q, x, y, on in met.rectangles(4 * SLICE if slow else SLICE):  # copies are measured once of those at once
            dist = measure(x, y, on)[on]
            a, b = np.nonzero(on)
            i, j = p[a], q[b]
            none = met.holes[i] | met.holes[j] | (met.lengths[i] != met.lengths[j]) if holes else (met.lengths[i] < 0) | (met.lengths[j] < 0)
            dist[none] = np.nan
            first, second = met.ordered(i, j)
            yield {"i": first, "j": second, "dist": pa.array(dist, mask=none if holes else None)}

    return met_blocks(traces, keys, item, column, found, f"i {kind}, j {kind}, dist double", slow=slow)


# ---------------------------------------------------------------- sums of absolute differences


def l1(x: np.ndarray, y: np.ndarray, on: np.ndarray | None = None) -> np.ndarray:
    """Sums of absolute differences of all rows of x and y, in the order of the samples; of rows of two lengths they are not a number."""
    if x.shape[1] != y.shape[1]:
        return np.full((len(x), len(y)), np.nan)
    out, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        np.subtract(a[:, None], b[None, :], out=gap)
        np.abs(gap, out=gap)
        out += gap
    return out


def l1_distances(traces: DataFrame, keys: list[str], item: str = "trial", column: str = "dff") -> DataFrame:
    """(keys, i, j, dist) of all pairs i < j of a group's traces; null where a value is missing or lengths differ."""
    return paired(traces, keys, item, column, l1, holes=True)


def _both_ways(met: Met) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, places, distances) of the pairs that have one; others are not a number and not on."""
    for p, q, x, y, on in met.rectangles():
        on = on & ~met.holes[p][:, None] & ~met.holes[q][None, :]
        if x.shape[1] == y.shape[1] and on.any():
            yield p, q, on, l1(x, y)


def l1_neighbours(traces: DataFrame, keys: list[str], eps: float, most: int, item: str = "trial", column: str = "dff") -> DataFrame:
    """(keys, i, n, near): how many other traces of the group lie within eps of each that has any, and those themselves where there are most or fewer (else null)."""
    kind = _item_type(traces, item)

    def found(met: Met) -> Iterator[dict]:
        n, kept = np.zeros(len(met.items), np.int64), [[] for _ in range(len(met.items))]
        for p, q, on, dist in _both_ways(met):
            within = on & (dist <= eps)
            for at, others, m in ((p, q, within), (q, p, within.T)):
                n[at] += m.sum(axis=1)
                few = np.flatnonzero(n[at] <= most)
                for a, b in zip(*np.nonzero(m[few]), strict=True):
                    kept[at[few[a]]].append(others[b])
        has = np.flatnonzero(n)
        lists = [kept[i] if n[i] <= most else [] for i in has]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(offsets), met.items.take(pa.array(np.array([j for x in lists for j in x], np.int64))))
        yield {"i": met.items.take(pa.array(has)), "n": pa.array(n[has]), "near": near}

    parts = met_blocks(traces, keys, item, column, found, f"i {kind}, n long, near array<{kind}>")
    total = parts.groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("near")).alias("near"))
    return total.withColumn("near", F.when(F.col("n") <= most, F.col("near")))


def l1_nearest(traces: DataFrame, keys: list[str], k: int, item: str = "trial", column: str = "dff") -> DataFrame:
    """(keys, i, near): the k smallest positive distances of each trace within its group, ascending; fewer if there are fewer, no row if there is none."""
    kind = _item_type(traces, item)

    def found(met: Met) -> Iterator[dict]:
        best, n = np.full((len(met.items), k), np.nan), np.zeros(len(met.items), np.int64)
        for p, q, on, dist in _both_ways(met):
            on = on & ~(dist <= 0)
            dist = np.where(on, dist, np.nan)  # sorted last, as is a distance that is not a number itself
            for at, d, m in ((p, dist, on), (q, dist.T, on.T)):
                n[at] += m.sum(axis=1)
                both = np.concatenate([best[at], np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d], axis=1)
                best[at] = np.sort(both, axis=1)[:, :k]
        has = np.flatnonzero(n)
        take = np.arange(k)[None, :] < n[has][:, None]
        offsets = np.concatenate([[0], np.cumsum(take.sum(axis=1))]).astype(np.int32)
        yield {"i": met.items.take(pa.array(has)), "near": pa.ListArray.from_arrays(pa.array(offsets), pa.array(best[has][take]))}

    parts = met_blocks(traces, keys, item, column, found, f"i {kind}, near array<double>")
    return parts.groupBy(*keys, "i").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
