"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of BLOCK dimensions. A pair of
cosine c or more has a squared distance of 2 - 2c at most; so in some block its squared distance is at most that
block's proportional share. Each block is range-joined under its share: vectors go to cells of the block's coordinates, cut
at normal quantiles, as many as the label's size asks for, and as guests to later cells that the share reaches. In a cell,
vectors are halved along their widest coordinate, and halves out of reach of each other never meet; what remains is compared in the block's
coordinates. Candidates are verified by the exact cosine of the vectors as given, in double precision; a
pair counts in the first block that admits it, so the union of the blocks needs no deduplication.

A label of up to CHUNK vectors is one cell, whose task goes through all blocks. Equal vectors are folded first. The homes of a crowded cell are dealt
out as pairs of chunks, its guests to each chunk of homes, before their first shuffle. A task
returns each vector's number of links and one edge to the root of its group within the task, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, kept, mapped, merge_roots, table

BLOCK = 8
#: Vectors of a label, or homes of a cell, that one side of a task takes; of guests it takes GUESTS times as many.
CHUNK, GUESTS = 4096, 4
#: Parts of a coordinate at most, and the borders of two and of four parts of a standard normal coordinate.
PARTS = 4
BORDERS = {n: np.array([NormalDist().inv_cdf(k / n) for k in range(1, n)]) for n in (1, 2, PARTS)}
#: Labels or cells up to which their sizes are broadcast; beyond, vectors are joined with them by one of SALTS salts.
FEW_CELLS, SALTS = 50_000, 16
#: Bits of a vector's first name; vectors that share it go by their second.
NAME_BITS = 64
#: Rows that aren't halved any more, candidates verified at a time, and rows compared at a time.
LEAF, VERIFY, ROWS = 256, 1 << 15, 256
_EPS = 1e-9


def blocks_of(dim: int) -> list[tuple[int, int]]:
    n = max(1, dim // BLOCK)
    cuts = np.linspace(0, dim, n + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shares(dim: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may have."""
    return np.array([(2 - 2 * cosine) * (b - a) / dim for a, b in blocks_of(dim)]) + _EPS


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def places(r: np.ndarray, dim: int, share: float, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, cells and whether a row is a guest there, for a block's coordinates r: level halvings, first one of each coordinate, then one more of each.

    A row has its home, and is a guest in each later cell whose squared distance is within the share: of two rows of different
    cells that are within it, the one of the earlier cell is a guest of the other's.
    """
    width = r.shape[1]
    rows = np.arange(len(r))
    home, cell, cost = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), np.zeros(len(r))
    for c in range(min(level, width)):
        inner = BORDERS[PARTS if c < level - width else 2] / np.sqrt(dim)
        x = r[rows, c]
        below, above = np.concatenate([[-np.inf], inner]), np.concatenate([inner, [np.inf]])
        far = cost[:, None] + np.maximum(0, np.maximum(below - x[:, None], x[:, None] - above)) ** 2
        k, part = np.nonzero(far <= share + _EPS)
        home = home[k] * PARTS + np.searchsorted(inner, x, side="right")[k]
        cell, cost, rows = cell[k] * PARTS + part, far[k, part], rows[k]
    keep = cell >= home
    return rows[keep], cell[keep], (cell > home)[keep]


def _cells(cosine: float):
    def run(batches):
        known: dict[int, np.ndarray] = {}
        kinds = [pa.int32(), pa.int64(), pa.bool_()]
        for b in batches:
            dims, levels = b.column(1).to_numpy(), b.column(2).to_numpy()
            # a label that is one cell has block -1
            whole = np.flatnonzero(levels == 0)
            parts = [(whole, np.full(len(whole), -1), np.zeros(len(whole), np.int64), np.zeros(len(whole), bool))]
            for d, level in {(d, n) for d, n in zip(dims.tolist(), levels.tolist(), strict=True) if n}:
                at = np.flatnonzero((dims == d) & (levels == level))
                r = unit(_matrix(b.column(3).take(pa.array(at)), d)) @ known.setdefault(d, rotation(d))
                for block, (share, (lo, hi)) in enumerate(zip(shares(d, cosine), blocks_of(d), strict=True)):
                    rows, cell, guest = places(r[:, lo:hi], d, share, level)
                    parts.append((at[rows], np.full(len(rows), block), cell, guest))
            row, *found = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dims)))]).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(x[order], t) for x, t in zip(found, kinds, strict=True)], ["block", "cell", "guest"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), cells)], [*b.schema.names, "cells"])

    return run


def within(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Which rows of x and y are within the share of each other."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= share + _EPS


def in_reach(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Which rows of x are within reach of y's box."""
    return ((x >= y.min(0) - reach) & (x <= y.max(0) + reach)).all(1)


def near_pairs(x: np.ndarray, y: np.ndarray | None, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of all pairs within the share, each pair once. y None: pairs of different rows of x.

    Sides are halved at the median of their widest coordinate until they are small or within half a reach, and
    rows that are out of reach of the other side's box are left out on the way.
    """
    reach, other = np.sqrt(share) + _EPS, x if y is None else y
    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(x)), None if y is None else np.arange(len(y)))]
    while stack:
        i, j = stack.pop()
        if j is not None:
            i = i[in_reach(x[i], other[j], reach)]
            j = j[in_reach(other[j], x[i], reach)] if len(i) else i
            if not len(j):
                continue
        left = j is None or len(i) >= len(j)
        wide, points = (i, x) if left else (j, other)
        if len(wide) > LEAF:
            spread = np.ptp(points[wide], axis=0)
            c = int(spread.argmax())
            if spread[c] > reach / 2:
                v = points[wide, c]
                middle = np.median(v)
                low = v <= middle if (v > middle).any() else v < middle
                one, two = wide[low], wide[~low]
                if j is None:
                    stack += [(one, None), (two, None), (one, two)]
                else:
                    stack += [(one, j), (two, j)] if left else [(i, one), (i, two)]
                continue
        for s in range(0, len(i), ROWS):
            p, q = np.nonzero(within(x[i[s : s + ROWS]], x[i] if j is None else other[j], share))
            if j is None:
                p, q = p[p + s < q], q[p + s < q]
            yield i[p + s], (i if j is None else j)[q]


def block_links(left: np.ndarray, right: np.ndarray | None, block: int, cosine: float):
    """Yields (i, j) index arrays of linked pairs that this block (-1: any, each pair once) is the first to admit. right None: pairs within left."""
    dim = left.shape[1]
    parts, share, q = blocks_of(dim), shares(dim, cosine), rotation(dim)
    u = unit(left)
    v = u if right is None else unit(right)
    ur = u @ q
    vr = ur if right is None else v @ q
    starts = [p for p, _ in parts]
    for k in range(len(parts)) if block < 0 else [block]:
        a, b = parts[k]
        x = np.ascontiguousarray(ur[:, a:b])
        for p, r in gathered(near_pairs(x, None if right is None else np.ascontiguousarray(vr[:, a:b]), share[k])):
            good = (u[p] * v[r]).sum(1) >= cosine
            p, r = p[good], r[good]
            first = (np.add.reduceat((ur[p] - vr[r]) ** 2, starts, axis=1) <= share).argmax(axis=1) == k
            if first.any():
                yield p[first], r[first]


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, VERIFY at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def cut():
        p, r = (np.concatenate(x) for x in zip(*held, strict=True))
        return ((p[s : s + VERIFY], r[s : s + VERIFY]) for s in range(0, len(p), VERIFY))

    for p, r in pairs:
        held.append((p, r))
        n += len(p)
        if n >= VERIFY:
            yield from cut()
            held, n = [], 0
    if n:
        yield from cut()


def _join(cosine: float):
    """Links within one chunk of a cell (i = j), or between two: side 0 is chunk i, side 1 chunk j."""

    def run(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        i, j = key[4].as_py(), key[5].as_py()
        dim, block = key[1].as_py(), key[2].as_py()
        side = data.column("side").to_numpy()
        x = _matrix(data.column("embedding"), dim)
        node, mult = data.column("node").to_numpy(), data.column("mult").to_numpy()
        la, ra = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        tasks = [(la, ra)] if len(ra) and len(la) else []
        if i == j and len(la) > 1:
            tasks.append((la, None))
        for left, right in tasks:
            for p, r in block_links(x[left], None if right is None else x[right], block, cosine):
                p, r = left[p], (left if right is None else right)[r]
                np.add.at(links, p, mult[r])
                np.add.at(links, r, mult[p])
                merge_roots(parent, p, r)
        hit = np.flatnonzero(links > 0)
        return pa.table({"node": node[hit], "links": links[hit], "root": node[parent[hit]]}, schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    return run


def _with(rows: DataFrame, sizes: DataFrame, keys: list[str], spread: Column, how: str) -> DataFrame:
    """rows joined with the written table sizes, one row a key: broadcast while it is short, else by key and salt."""
    if sizes.count() <= FEW_CELLS:
        return rows.join(F.broadcast(sizes), keys, how)
    salted = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread, F.lit(9)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how)


def similar_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared only where labels are equal and not null and the lengths are equal. Null, empty and zero
    vectors, vectors with a null or non-finite component, and rows with a null id link with nothing: no links, own component.
    Repeated rows are vectors of their own and link with each other. An empty table gives no rows; other
    columns are ignored. component_id is the smallest id reachable by links.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    # a float or a double compares with infinity as such; forall is null if a component is
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"fit": fit, "k1": F.shiftright(F.xxhash64("label", "embedding"), 64 - NAME_BITS), "k2": F.xxhash64("embedding", F.lit(5), "label")})
    with Scratch() as scratch:
        fits = rows.where("fit").withColumn("dim", F.size("embedding"))
        # how finely a label is cut goes by its different vectors, about counted; it changes no result
        sizes = fits.groupBy("label", "dim").agg(F.approx_count_distinct("k1").alias("n")).where(F.col("n") > CHUNK)
        sizes = scratch.saved(sizes.select("label", "dim", F.ceil(F.log2(F.col("n") / CHUNK)).cast("int").alias("level")), "vector-labels")
        classes = fits.groupBy("k1", "k2", "label").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"))
        classes = _with(classes.withColumn("dim", F.size("embedding")), sizes, ["label", "dim"], F.col("k1"), "left")
        classes = classes.select("k1", "dim", F.coalesce("level", F.lit(0)).alias("level"), "embedding", "label", "k2", "first", "mult")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", cells array<struct<block:int,cell:long,guest:boolean>>"
        placed = scratch.saved(mapped(classes, _cells(cosine), schema, rows=1024), "vectors")
        # About vectors^2 / 2^65 different ones share their first name: none in most tables, a few in the largest.
        twice = [r["k1"] for r in placed.groupBy("k1").count().where("count > 1").select("k1").collect()]
        node = F.when(F.col("k1").isin(*twice), F.col("k2")).otherwise(F.col("k1")) if twice else F.col("k1")
        own = placed.select(node.alias("node"), "mult", "embedding", "label", "dim", F.explode("cells").alias("c")).select("node", "mult", "embedding", "label", "dim", "c.*")
        group = ["label", "dim", "block", "cell"]
        # a cell that holds guests only has no pairs
        guests = F.count_if("guest")
        crowd = own.groupBy(*group).agg((F.count("*") - guests).alias("homes"), guests.alias("guests")).where("homes > 0")
        crowd = scratch.saved(crowd.select(*group, F.ceil(F.col("homes") / CHUNK).cast("int").alias("h"), F.ceil(F.col("guests") / (CHUNK * GUESTS)).cast("int").alias("g")), "vector-cells")
        counted = _with(own, crowd, group, F.col("node"), "inner")
        counted = counted.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("guest"), F.col("g")).otherwise(F.col("h"))).cast("int"))
        # Chunks of homes are 0 to h - 1, of guests h to h + g - 1. Homes of chunk c are the left side of (c, j) for j >= c, and the right one of (i, c) for i < c; guests meet each chunk of homes.
        left = F.transform(F.sequence(F.col("chunk"), F.col("h") + F.col("g") - 1), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(0).alias("side")))
        homes = F.sequence(F.lit(0), F.col("h") - 1)
        right = F.transform(F.filter(homes, lambda i: i < F.col("chunk")), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side")))
        guest = F.transform(homes, lambda i: F.struct(i.alias("i"), (F.col("h") + F.col("chunk")).alias("j"), F.lit(1).alias("side")))
        dealt = counted.select(*group, "node", "mult", "embedding", F.explode(F.when(F.col("guest"), guest).otherwise(F.concat(left, right))).alias("d"))
        dealt = dealt.select(*group, "d.i", "d.j", "d.side", "node", "mult", "embedding")
        found = scratch.saved(dealt.groupBy(*group, "i", "j").applyInArrow(_join(cosine), "node long, links long, root long"), "vector-links")
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = placed.select(node.alias("node"), "first", "mult").join(roots, "node", "left").join(counts, "node", "left")
        known = known.select("node", "first", F.coalesce("component", "node").alias("root"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        best = known.groupBy("root").agg(F.min("first").alias("component_id"))
        named = kept(known.join(best, "root").select("node", "n_links", "component_id"), "vector-classes")
    out = rows.select("vec_id", F.when(F.col("fit"), node).alias("node")).join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
