"""Time warping between trials: all distances of a group, or only those under a radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .pairs import Met, met_blocks, paired

#: Pairs whose tables are computed at once: a diagonal of them all stays near the processor.
TABLES = 512
#: Pairs of a turn, about, after which it is known anew what is connected.
TURN = 1 << 11
#: Bytes of a line of the processor's caches.
LINE = 64


def _empty(shape: tuple[int, ...], kind: type) -> np.ndarray:
    """An array that begins with a line of the cache: no vector register is loaded from two lines, or stored to two."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    room = np.empty(size + LINE, np.uint8)
    start = -room.ctypes.data % LINE
    return room[start : start + size].view(kind).reshape(shape)


class _Tables:
    """Warping tables of w pairs of n and m samples, a diagonal of them all at a time; each diagonal takes the place of the last but one.

    Cell (i, k - i) of diagonal k is at i - k // 2 of its row, where cell (i - 1, k - i - 1) of diagonal k - 2 was. What nothing was written to lies
    outside the table and is infinite. All slices are made once, and serve for any number of pairs.
    """

    def __init__(self, n: int, m: int, w: int, kind: type):
        self.kind, self.w, middle = kind, w, m // 2 + 2
        self.x, self.y = _empty((n, w), kind), _empty((m, w), kind)  # y from its end, so that cells of a diagonal are two slices
        self.rows, cost = _empty((2, n + m + 4, w), kind), _empty((min(n, m), w), kind)
        self.start, self.steps = self.rows[0, middle], []
        for k in range(n + m - 1):
            a, b = max(0, k - m + 1), min(n, k + 1)
            at, was, last = middle - k // 2, middle - (k - 1) // 2, self.rows[1 - k % 2]
            self.steps.append((self.x[a:b], self.y[m - 1 - k + a : m - 1 - k + b], cost[: b - a], self.rows[k % 2, a + at : b + at], last[a + was : b + was], last[a + was - 1 : b + was - 1]))

    def distances(self, radius: float = np.inf, done: int = 0) -> np.ndarray:
        """Of the pairs in x and y; those beyond the radius may be given up, as infinite. done: diagonals that are there already."""
        if not done:
            self.rows.fill(np.inf)
            self.start.fill(0)
        whole = len(self.steps)
        stops = [k for k in range(16, whole, 16) if k > done and 2 * k > whole + 3] if radius < np.inf else []
        subtract, size, least, add = np.subtract, np.abs, np.minimum, np.add
        for a, b in zip([done, *stops], [*stops, whole], strict=True):
            for x, y, cost, new, one, two in self.steps[a:b]:
                subtract(x, y, cost)
                size(cost, cost)
                least(new, one, new)
                least(new, two, new)
                add(new, cost, new)
            if b < whole:  # every path crosses this diagonal or the one before
                live = np.minimum(self.steps[b - 1][3].min(axis=0), self.steps[b - 2][3].min(axis=0)) <= radius
                if 2 * live.sum() <= self.w:
                    out = np.full(self.w, np.inf, self.kind)
                    if live.any():
                        left = _Tables(len(self.x), len(self.y), int(live.sum()), self.kind)
                        left.x[:], left.y[:], left.rows[:] = self.x[:, live], self.y[:, live], self.rows[:, :, live]
                        out[live] = left.distances(radius, b)
                    return out
        return self.steps[-1][3][0]


def _measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, radius: float = np.inf, kind: type = float) -> np.ndarray:
    """Warping distances of rows i of x and rows j of y, TABLES at once; those beyond the radius may be given up, as infinite."""
    out = np.empty(len(i), kind)
    x, y = np.ascontiguousarray(x.T, kind), np.ascontiguousarray(y.T[::-1], kind)
    t = None
    for s in range(0, len(i), TABLES):
        a, b = i[s : s + TABLES], j[s : s + TABLES]
        if t is None or t.w != len(a):
            t = _Tables(len(x), len(y), len(a), kind)
        np.take(x, a, axis=1, out=t.x, mode="clip")
        np.take(y, b, axis=1, out=t.y, mode="clip")
        out[s : s + TABLES] = t.distances(radius)
    return out


def _single(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, radius: float) -> tuple[np.ndarray, float] | None:
    """Distances in single precision, and by how much those up to the radius may be off; None where that is much."""
    ends = [f(v) for f in (np.min, np.max) for v in (x, y)]
    middle, half = (min(ends) + max(ends)) / 2, (max(ends) - min(ends)) / 2
    # Rounded samples, differences and sums: each cell of a path adds at most so much.
    slack = (x.shape[1] + y.shape[1]) * 2.0**-23 * (4 * half + 2 * radius + abs(middle) * 2.0**-20)
    if slack <= 0.01 * radius and half < 1e30:
        return _measured(x - middle, y - middle, i, j, radius + slack, np.float32), slack
    return None


def _within(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, radius: float) -> np.ndarray:
    """_measured(), where single precision doesn't tell that a distance is beyond the radius; else infinite."""
    got = _single(x, y, i, j, radius) if len(i) and radius < np.inf else None
    if not got:
        return _measured(x, y, i, j, radius)
    out, few = np.full(len(i), np.inf), np.flatnonzero(got[0] <= radius + got[1])
    out[few] = _measured(x, y, i[few], j[few], radius)
    return out


def _near(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, radius: float) -> np.ndarray:
    """Whether distances are within the radius: only those that single precision doesn't tell are measured in double."""
    got = _single(x, y, i, j, radius) if len(i) else None
    if not got:
        return _measured(x, y, i, j, radius) <= radius
    out, open_ = got[0] <= radius - got[1], np.flatnonzero(np.abs(got[0] - radius) <= got[1])
    out[open_] = _measured(x, y, i[open_], j[open_], radius) <= radius
    return out


def dtw_many(x: np.ndarray, y: np.ndarray, radius: float = np.inf) -> np.ndarray:
    """Warping distances of row pairs of x (p, n) and y (p, m): absolute costs, no band.

    With a radius, a pair whose distance is beyond it may be given up, as infinite: single precision, less its largest possible error, tells most of
    these, and a table is left where two diagonals are beyond; every path crosses one of them, and costs only grow.
    """
    every = np.arange(len(x))
    return _within(x, y, every, every, radius)


def _first(x: np.ndarray) -> np.ndarray:
    """For each row the first one that is equal to it."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(v.tobytes(), i) for i, v in enumerate(x)], np.int64)


def _warped(x: np.ndarray, y: np.ndarray, on: np.ndarray, radius: float = np.inf) -> np.ndarray:
    """Warping distances of the rows of x and y that are on, copies measured once; an empty trace is far from all but empty ones."""
    out = np.full(on.shape, np.inf)
    if not x.shape[1] or not y.shape[1]:
        return np.full(on.shape, 0.0 if x.shape[1] == y.shape[1] else np.inf)
    i, j = np.nonzero(on)
    every, at = _first(x)[i] * len(y) + _first(y)[j], np.zeros(on.size, np.int64)
    at[every] = 1
    once = np.flatnonzero(at)
    at[once] = np.arange(len(once))
    out[i, j] = _within(x, y, *np.divmod(once, len(y)), radius)[at[every]]
    return out


def trial_pairs(trials: DataFrame, keys: list[str], item: str, column: str) -> DataFrame:
    """Pairs i < j of a group's trials, with both arrays: for small groups, as each array travels once for each pair."""
    a = trials.select(*keys, F.col(item).alias("i"), F.col(column).alias("x"))
    b = trials.select(*keys, F.col(item).alias("j"), F.col(column).alias("y"))
    return a.join(b, keys).where("i < j").select(*keys, "i", "j", "x", "y")


def dtw_distances(trials: DataFrame, keys: list[str], item: str = "trial", column: str = "dff") -> DataFrame:
    """A16 over J12: (keys, i, j, dist) of all pairs; not a number where a value is missing."""
    return paired(trials.withColumn(column, F.col(column).cast("array<double>")), keys, item, column, _warped, slow=True)


def least_distance(a: str, b: str) -> Column:
    """A bound from below for the warping distance of two traces, by their ends and extremes.

    A path starts at both first samples and ends at both last ones; and what is largest (or smallest) in one trace meets something no larger
    (no smaller) than the other's extreme.
    """

    def gap(c: str) -> Column:
        return F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))

    single = (F.col(f"{a}.n") == 1) & (F.col(f"{b}.n") == 1)  # the same cell is start and end
    return F.greatest(F.when(single, gap("first")).otherwise(gap("first") + gap("last")), gap("hi"), gap("lo"))


def candidate_pairs(trials: DataFrame, keys: list[str], eps: float, item: str = "trial", column: str = "dff") -> DataFrame:
    """(keys, i, j), i < j, of a group's trials that least_distance() doesn't keep apart: a join on cells of first and last sample, of a few numbers a trial."""
    x = F.col(column)
    width = eps if eps > 0 else 1.0
    few = F.struct(F.element_at(x, 1).alias("first"), F.element_at(x, -1).alias("last"), F.array_max(x).alias("hi"), F.array_min(x).alias("lo"), F.size(x).alias("n"))
    own = trials.where(F.size(x) > 0).select(*keys, F.col(item).alias("i"), few.alias("_f"))
    own = own.select("*", F.floor(F.col("_f.first") / width).alias("_first"), F.floor(F.col("_f.last") / width).alias("_last"))
    near = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
    other = own.select(*keys, F.col("i").alias("j"), F.col("_f").alias("_g"), "_first", "_last", F.explode(near).alias("_by"))
    other = other.withColumn("_first", F.col("_first") + F.col("_by.p")).withColumn("_last", F.col("_last") + F.col("_by.q")).drop("_by")
    return own.join(other, [*keys, "_first", "_last"]).where((F.col("i") < F.col("j")) & (least_distance("_f", "_g") <= eps)).select(*keys, "i", "j")


def _apart(x: np.ndarray, y: np.ndarray, each: bool = False) -> np.ndarray:
    """least_distance() of all rows of x and y, or of each row of x and the same one of y."""

    def gap(f) -> np.ndarray:
        return np.abs(f(x) - f(y)) if each else np.abs(f(x)[:, None] - f(y)[None, :])

    first, last = gap(lambda v: v[:, 0]), gap(lambda v: v[:, -1])
    ends = first if x.shape[1] == y.shape[1] == 1 else first + last
    return np.maximum(np.maximum(ends, gap(lambda v: v.max(axis=1))), gap(lambda v: v.min(axis=1)))


def near_pairs(trials: DataFrame, keys: list[str], eps: float, item: str = "trial", column: str = "dff") -> DataFrame:
    """A16 under a radius: (keys, i, j, dist) of the pairs i < j whose distance is eps or less.

    Only traces whose first and last samples lie in the same cell or in neighbouring ones meet, by blocks; least_distance() then chooses the pairs
    whose tables are begun. Equals dtw_distances() where dist <= eps; empty traces, and those with a value that is missing or not finite, are near
    nothing. Items are expected once in a group; an empty table gives none.
    """
    kind = trials.schema[item].dataType.simpleString()

    def found(met: Met) -> Iterator[dict]:
        for p, q, x, y, on in met.rectangles():
            dist = _warped(x, y, on & (_apart(x, y) <= eps), eps)
            a, b = np.nonzero(dist <= eps)
            first, second = met.ordered(p[a], q[b])
            yield {"i": first, "j": second, "dist": pa.array(dist[a, b])}

    return met_blocks(_celled(trials, keys, eps, column), keys, item, column, found, f"i {kind}, j {kind}, dist double", ("_first", "_last"))


def _likely(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x the rows of y, those that differ least sample by sample first: an order to look in, no more."""
    n = min(x.shape[1], y.shape[1])
    with np.errstate(all="ignore"):
        x, y = x[:, :n].astype(np.float32), y[:, :n].astype(np.float32)
        return np.argsort((y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), axis=1)


class _Looking:
    """Places p that look for near ones among places q, the likeliest first. What a row has passed is measured or connected, and stays so."""

    def __init__(self, p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.p, self.q, self.order, self.at = p, q, _likely(x, y), np.zeros(len(p), np.int64)

    def turn(self, root: np.ndarray, main: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows and columns of the next pairs of those that aren't in the main part, without what is connected; None if all have looked."""
        rows = np.flatnonzero((root[self.p] != main) & (self.at < len(self.q)))
        if not len(rows):
            return None
        step = -(-TURN // len(rows))
        a, next_ = np.repeat(rows, step), (self.at[rows, None] + np.arange(step)).ravel()
        self.at[rows] += step
        a, next_ = a[next_ < len(self.q)], next_[next_ < len(self.q)]
        b = self.order[a, next_]
        on = root[self.p[a]] != root[self.q[b]]
        return a[on], b[on]


def _joined(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, codes: np.ndarray, eps: float, root: np.ndarray) -> list[tuple[int, int]]:
    """Near pairs of places p and q that connect what isn't connected; root is brought up to date.

    Two parts are told apart once one of them has looked whole, so the largest one doesn't look. A pair whose items are connected already isn't
    measured: an item of a dense group costs a few tables, and only one that is near few others, or none, meets all of them.
    """
    links, same = [], p is q
    done = np.zeros((len(p), len(q)), bool)
    ways = [_Looking(p, q, x, y)] if same else [_Looking(p, q, x, y), _Looking(q, p, y, x)]
    both = p if same else np.concatenate([p, q])
    while True:
        parts, sizes = np.unique(root[both], return_counts=True)
        turns = [w.turn(root, parts[sizes.argmax()]) for w in ways]
        if all(t is None for t in turns):
            return links
        looked = [t if k == 0 else t[::-1] for k, t in enumerate(turns) if t]
        a, b = (np.concatenate(v) for v in zip(*looked, strict=True))
        a, b = np.divmod(np.unique((np.minimum(a, b) if same else a) * len(q) + (np.maximum(a, b) if same else b)), len(q))  # two may look for each other
        a, b = a[~done[a, b]], b[~done[a, b]]
        done[a, b] = True
        few = (codes[p[a]] != codes[q[b]]) & (_apart(x[a], y[b], each=True) <= eps)
        a, b = a[few], b[few]
        near = _near(x, y, a, b, eps)
        for i, j in zip(p[a[near]], q[b[near]], strict=True):
            u, v = sorted((root[i], root[j]))
            if u != v:
                root[root == v] = u
                links.append((i, j))


def _links(met: Met, eps: float, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, places, distances) of near pairs that connect what isn't connected; root, a place for each trace, is brought up to date."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def once(side: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and traces by length, one of equal ones; in a block by itself these are linked."""
        out = []
        for p in met.by_length(side):
            x = met.arrays(p)
            first = _first(x)
            some = first == np.arange(len(p))
            i, j = p[first[~some]], p[~some]
            if met.same and eps >= 0:
                on = met.codes[i] != met.codes[j]
                i, j = i[on], j[on]
                root[j] = root[i]
                found.append((i, j, np.zeros(len(i))))
            out.append((p[some], x[some]) if eps >= 0 else (p, x))
        return out

    left = once(0)
    right = left if met.same else once(1)
    for k, (p, x) in enumerate(left):
        for q, y in right[k:] if met.same else right:
            if links := _joined(p, q, x, y, met.codes, eps, root):
                i, j = np.array(links, np.int64).T
                found.append((i, j, _measured(x, y, np.searchsorted(p, i), np.searchsorted(q, j))))
    i, j, dist = (np.concatenate(v) for v in zip(*found, strict=True))
    return i, j, dist


def linking_pairs(trials: DataFrame, keys: list[str], eps: float, item: str = "trial", column: str = "dff") -> DataFrame:
    """(keys, i, j, dist): those of near_pairs() that connect what all of them connect.

    Each block is connected by itself first. Where two blocks meet, what is connected in either is known, so parts look for one link, not each
    item for its own: the tables of a dense group go with its items, not with its pairs.
    """
    kind = trials.schema[item].dataType

    def alone(met: Met) -> dict:
        root = np.arange(len(met.items))
        i, j, dist = _links(met, eps, root)
        first, second = met.ordered(i, j)
        none = len(root) - len(i)  # a block has fewer links than traces: they are kept in its first rows
        return {"_root": met.items.take(pa.array(root)), "_i": _padded(first, none), "_j": _padded(second, none), "_dist": _padded(pa.array(dist), none)}

    def found(met: Met) -> Iterator[dict]:
        if met.same:
            t = met.table.filter(pc.is_valid(met.table.column("_dist")))
            yield {"i": t.column("_i").combine_chunks(), "j": t.column("_j").combine_chunks(), "dist": t.column("_dist").combine_chunks()}
            return
        i, j, dist = _links(met, eps, pc.index_in(met.table.column("_root").combine_chunks(), value_set=met.items).to_numpy().astype(np.int64))
        first, second = met.ordered(i, j)
        yield {"i": first, "j": second, "dist": pa.array(dist)}

    kept = StructType([StructField("_root", kind), StructField("_i", kind), StructField("_j", kind), StructField("_dist", DoubleType())])
    out = f"i {kind.simpleString()}, j {kind.simpleString()}, dist double"
    return met_blocks(_celled(trials, keys, eps, column), keys, item, column, found, out, ("_first", "_last"), alone, kept)


def _padded(values: pa.Array, n: int) -> pa.Array:
    return pa.concat_arrays([values, pa.nulls(n, values.type)])


def _celled(trials: DataFrame, keys: list[str], eps: float, column: str) -> DataFrame:
    """Whole, finite traces with the cells of their first and last samples: near ones are in neighbouring cells. A group within eps is one cell."""
    x = F.col(column).cast("array<double>")
    own = trials.withColumn(column, x).where((F.size(column) > 0) & F.forall(column, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))))
    ends = {"_first": F.element_at(column, 1), "_last": F.element_at(column, -1)}
    spans = own.groupBy(*keys).agg(*[F.struct(F.min(e).alias("lo"), F.max(e).alias("hi")).alias(f"_s{c}") for c, e in ends.items()])

    def cell(c: str):
        s = F.col(f"_s{c}")
        # A trace wider than eps, by more than quotients are rounded.
        width = F.greatest(F.lit(eps * (1 + 1e-6)), (s["hi"] - s["lo"]) * 1e-9)
        return F.when(width > 0, F.floor((ends[c] - s["lo"]) / width)).otherwise(0)

    return own.join(spans, keys).select(*own.columns, *[cell(c).alias(c) for c in ends])


def noise_split(trials: DataFrame, labels: DataFrame, keys: list[str], item: str = "trial") -> tuple[DataFrame, DataFrame]:
    """Trials without those that the labels (keys, item, is_noise) call noise, and those alone. Trials without a label stay."""
    noise = labels.where("is_noise").select(*keys, F.col("item").alias(item))
    return trials.join(noise, [*keys, item], "left_anti"), trials.join(noise, [*keys, item], "left_semi")
