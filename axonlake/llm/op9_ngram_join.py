"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are the rows, distinct word n-grams the columns of a 0/1 incidence matrix; the product of this matrix with its
transpose holds the overlaps. Rows with equal n-gram sets are folded into one.

Which entries of the product are formed: columns are ordered from rare to frequent by a fixed-size count sketch, and a row of n
n-grams meets others in its first n - ceil(t n) + 1 columns only, since a pair of similarity t or more shares one
of these. Where two rows meet, their sizes and the positions of the column bound the overlap from above; entries below
what t asks for are discarded there. So do parity sketches: bits, each the parity of the number of a row's n-grams that hash there.
Two sketches differ in no more bits than the sets differ in n-grams: narrow ones inside the join, wide ones before rows are read.

What is left of the product is accumulated block by block: the columns are dealt to BLOCKS blocks by their hash, a row holds a list for each, and
an entry adds up the overlaps of one block after the other; as soon as the sum and the most that the remaining blocks can add, by
their sizes, stay below the bound, the entry is discarded. The rows lie in a table bucketed by row, so that reading them moves the entries, not the rows.

Only entries that can still change a class are formed. In a round every column names a few pivots of its rows;
a pivot is compared with the column's other rows and then leaves the column; linked rows merge, and a column
whose rows are all of one class has nothing left to say. Columns with few rows are compared out. So a group
of g near copies costs about g comparisons, not g * g, and no link between different classes is lost.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, components, fitted, kept, mapped, packed, remove, shared_dir, table, unpacked

#: Counters of the sketch of column frequencies: a fixed size, 4 bytes each.
SKETCH_BITS, SLICES = 20, 16
#: Bits of the filter that tells which rows are still of interest.
FILTER_BITS = 24
#: Bits of a set's first name; sets that share it go by their second.
NAME_BITS = 64
#: Blocks of columns that the overlap of a pair is accumulated over.
BLOCKS = 8
#: 64-bit words of the parity sketches: of the entries that are compared first, of those compared later, of rows.
FIRST, PARITY, WIDE = 4, 8, 64
#: By round: pivots of a column, and rows up to which a column is compared out instead. Later rounds double the pivots.
PIVOTS, SMALL = (1, 16, 64), (0, 64, 1024)
#: Sets that a task remembers, to send equal ones once.
SEEN = 200_000

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 10, _MULT[0]), dtype=np.uint64)
#: Bytes hashed at a time, short texts together, long ones in pieces cut between words.
PIECE = 1 << 18


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word: a polynomial in its bytes, mixed with its length."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_SPACE[b])
    if not len(at):
        return np.empty(0, np.uint64), at
    first = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1))
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = _POWERS if lengths.max() <= len(_POWERS) else np.cumprod(np.full(lengths.max(), _MULT[0]), dtype=np.uint64)
    h = np.add.reduceat(_BYTE[b[at]] * powers[place], first)
    h = (h ^ (h >> np.uint64(29)) ^ lengths.astype(np.uint64)) * _MULT[1]
    return h ^ (h >> np.uint64(32)), at[first]


def _pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes, cut at a space, so that a long text needs little memory at a time."""
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def _from_words(h: np.ndarray, data: bytes, n: int) -> np.ndarray:
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(data.split()), seed=len(h))], np.uint64)
    m = len(h) - n + 1
    s = h[:m] * _MULT[0]
    for k in range(1, n):
        s ^= s >> np.uint64(29)
        s = (s + h[k : m + k]) * _MULT[k % len(_MULT)]
    s ^= s >> np.uint64(32)
    s *= _MULT[1]
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each text, A-Z in lower case, words between ASCII white space.

    A text of fewer words counts as one n-gram; no words or no text give none.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            ends = np.cumsum([len(d) + 1 for d in group])
            h, at = _hash_words(b"\n".join(group))
            cuts = np.searchsorted(at, ends)
            for d, a, z in zip(group, (0, *cuts[:-1]), cuts, strict=True):
                out.append(_from_words(h[a:z], d, n))
            group.clear()

    for t in texts:
        data = t.encode("utf-8", "surrogatepass").lower() if t else b""
        if len(data) > PIECE:
            flush()
            out.append(_from_words(np.concatenate([_hash_words(p)[0] for p in _pieces(data)]), data, n))
            continue
        group.append(data)
        if sum(map(len, group)) >= PIECE:
            flush()
    flush()
    return out


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit names of a set."""
    data, n = grams.tobytes(), len(grams)
    return (xxhash.xxh3_64_intdigest(data, seed=n) >> 64 - NAME_BITS) - (1 << NAME_BITS - 1), xxhash.xxh3_64_intdigest(data, seed=~n & (1 << 64) - 1) - (1 << 63)


def name_of(grams: np.ndarray, shared: frozenset[int]) -> int:
    """The first name, or the second where several sets share the first."""
    first, second = set_key(grams)
    return second if first in shared else first


def in_blocks(grams: np.ndarray) -> list[np.ndarray]:
    """A row's sorted columns by block: the upper bits of the hash."""
    shift = np.uint64(64 - (BLOCKS - 1).bit_length())
    cuts = np.searchsorted(grams, np.arange(1, BLOCKS, dtype=np.uint64) << shift)
    return np.split(_signed(grams), cuts)


def parity(grams: np.ndarray, size: int) -> list[int]:
    """A parity sketch as so many signed 64-bit words, a power of two; halves of one xored give the one of half the size."""
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % (64 * size), minlength=64 * size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def need(size: int, percent: int) -> int:
    """Least overlap with any partner."""
    return -(-percent * size // 100)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            every = (np.concatenate(waiting) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
            sketch[:] += np.bincount(every, minlength=1 << SKETCH_BITS).astype(np.uint32)
            waiting.clear()

        names = ["doc_id", "h1", "h2", "n", "node", "other", "bits", "slice", "counts"]
        for b in batches:
            sets = ngram_sets(b.column(3).to_pylist(), n)
            k = len(sets)
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            waiting += [s for s in sets if len(s)]
            if sum(map(len, waiting)) >= 1 << SKETCH_BITS:
                count()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array([parity(s, PARITY) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if waiting:
            count()
        if sketch.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, SLICES)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 6, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _add_slices(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
    for b in batches:
        for x in b.column(b.schema.get_field_index("counts")).to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def order_columns(grams: np.ndarray, sketch: np.ndarray, first: int) -> np.ndarray:
    """The first columns of a row in the order that all rows share: by sketched count, then hash."""
    c = sketch[(grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    if first < len(grams):
        limit = np.partition(c, first - 1)[first - 1]
        at = np.flatnonzero(c <= limit)
        return grams[at[np.argsort(c[at], kind="stable")]][:first]
    return grams[np.argsort(c, kind="stable")]


def _prefixes(n: int, percent: int, sent, twice: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sketch = set(), sent.value
        for b in batches:
            cols, nodes, sizes, at = [], [], [], []
            for s in ngram_sets(b.column(0).to_pylist(), n):
                if not len(s) or (key := name_of(s, twice)) in done:
                    continue
                if len(done) >= SEEN:
                    done.clear()
                done.add(key)
                first = order_columns(s, sketch, len(s) - need(len(s), percent) + 1)
                cols.append(first)
                nodes.append(np.full(len(first), key))
                sizes.append(np.full(len(first), len(s)))
                at.append(np.arange(len(first)))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(cols))), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32))], ["gram", "node", "n", "at"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        bits[b.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)] = True
    parts = [zlib.compress(p.tobytes(), 1) for p in np.split(np.packbits(bits), SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "bits"])


def _or_slices(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << FILTER_BITS) // 8 // SLICES, np.uint8)
    for b in batches:
        for x in b.column(b.schema.get_field_index("bits")).to_pylist():
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "bits"])


def _full_rows(n: int, sent, twice: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        bits = np.unpackbits(np.frombuffer(b"".join(map(zlib.decompress, sent.value)), np.uint8)).astype(bool)
        for b in batches:
            nodes, rows, wide = [], [], []
            wanted = bits[b.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)]
            for s in ngram_sets(b.column(1).filter(pa.array(wanted)).to_pylist(), n):
                if not len(s) or (key := name_of(s, twice)) in done:
                    continue
                if len(done) >= SEEN:
                    done.clear()
                done.add(key)
                nodes.append(key)
                rows += in_blocks(s)
                wide.append(parity(s, WIDE))
            if nodes:
                blocks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))
                blocks = pa.ListArray.from_arrays(pa.array(range(0, len(rows) + 1, BLOCKS), pa.int32()), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sum(map(len, rows[i : i + BLOCKS])) for i in range(0, len(rows), BLOCKS)], pa.int32()), pa.array(wide, pa.list_(pa.int64())), blocks], ["node", "n", "wide", "blocks"])

    return run


def _may_link(percent: int, words: int) -> Column:
    """Bounds from the sizes of a and b, the positions of one shared column, and the parity sketches."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    most = F.least("a.at", "b.at") + 1 + F.least(F.col("a.n") - F.col("a.at") - 1, F.col("b.n") - F.col("b.at") - 1)
    differ = sum(F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(words))
    total = F.col("a.n") + F.col("b.n")
    return (100 * small >= percent * large) & (most * (100 + percent) >= percent * total) & (differ * (100 + percent) <= (100 - percent) * total)


def accumulated(percent: int) -> Column:
    """Overlap of blocks_a and blocks_b, summed block by block; -1 as soon as what the blocks to come can add stays below the bound."""
    total = F.col("n_a") + F.col("n_b")

    def most(x: Column) -> Column:
        return F.least(F.size(x["a"]), F.size(x["b"]))

    def add(s: Column, x: Column) -> Column:
        more = F.struct((s["o"] + F.size(F.array_intersect(x["a"], x["b"]))).alias("o"), (s["rest"] - most(x)).alias("rest"))
        return F.when((s["o"] + s["rest"]) * (100 + percent) >= percent * total, more).otherwise(F.struct(F.lit(-1).alias("o"), F.lit(0).alias("rest")))

    blocks = F.zip_with("blocks_a", "blocks_b", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rest = F.aggregate(blocks, F.lit(0), lambda s, x: s + most(x))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("o"), rest.alias("rest")), add, lambda s: s["o"])


def _overlaps(pairs: DataFrame, rows: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """(a, b, linked): entries of the product, exact for the pairs that the wide sketches leave."""

    def sides(*names: str) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.select(F.col("node").alias(k), *[F.col(n).alias(f"{n}_{k}") for n in names]) for k in "ab")

    left, right = sides("wide", "n")
    total = F.col("n_a") + F.col("n_b")
    differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(left, "a").join(right, "b").select("a", "b", (differ * (100 + percent) <= (100 - percent) * total).alias("near"))
    near = scratch.saved(fitted(near, size), "ngram-near")
    left, right = sides("blocks", "n")
    both = near.where("near").join(left, "a").join(right, "b").select("a", "b", accumulated(percent).alias("o"), total.alias("total"))
    linked = both.select("a", "b", ((F.col("o") >= 0) & (100 * F.col("o") >= percent * (F.col("total") - F.col("o")))).alias("linked"))
    out = scratch.saved(fitted(fitted(linked, size).unionByName(near.where("not near").select("a", "b", F.lit(False).alias("linked"))), size), "ngram-found")
    scratch.drop(near)
    return out


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ngrams, component_id): classes of documents linked at Jaccard similarity percent / 100 or more.

    component_id is the smallest doc_id reachable by links. Null texts and texts without words have no n-grams,
    link with nothing and stay alone; texts of fewer than n words count as one n-gram; equal sets link; repeated
    rows are each returned. A null doc_id takes part and gets its class's smallest id (null if it has no other). An empty
    table gives no rows; other columns are ignored. n-grams are compared by 64-bit hashes, sets named by two of them.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.col(text_col).alias("text"))
    rows = _classed(docs, n, percent)
    # A table of its own, so that adaptive execution sees the join as one of two shuffles and splits the rows of a large class.
    best = kept(rows.groupBy("root").agg(F.min("doc_id").alias("first")), "ngram-first")
    out = rows.join(best, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_ngrams"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of similar_classes(), with all its columns: the one of smallest id, then of smallest text hash.

    Rows are told by id and text, so of rows of one id and different texts each goes by its own text. Null ids come after all others.
    Rows of null text or without words resemble nothing and all stay. Of repeated rows of one id and text one stays, any if other columns
    differ. An empty table gives no rows; columns of any name stay.
    """
    text = F.col(text_col)
    wordless = text.isNull() | ~text.rlike(r"[^ \t\n\x0B\f\r]")
    keyed = packed(docs, text=text, doc_id=F.col(id_col).cast("long"), h1=F.xxhash64(text), h2=F.xxhash64(text, F.lit(5)), wordless=wordless)
    rows = _classed(keyed.select("doc_id", "h1", "h2", "text"), n, percent).where("root is not null")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    chosen = rows.groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    chosen = chosen.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "h1", "h2")
    mine = keyed.where("not wordless").select("row", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h1", "h2")
    same = Window.partitionBy("none", "id", "h1", "h2").orderBy(F.lit(0))
    first = mine.withColumn("at", F.row_number().over(same)).where("at = 1").join(chosen, ["none", "id", "h1", "h2"], "left_semi")
    return unpacked(first.select("row").unionByName(keyed.where("wordless").select("row")), docs.columns)


def _classed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, h1, h2, n, root) for every row of docs(doc_id, h1, h2, text); root is null for rows without n-grams, else the same in a class."""
    spark = docs.sparkSession
    schema = "doc_id long, h1 long, h2 long, n long, node long, other long, bits array<long>, slice int, counts binary"
    with Scratch() as scratch:
        profile = scratch.saved(mapped(docs, _profile(n), schema), "ngram-profile")
        slices = profile.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect()
        sets = profile.where("node is not null")
        # About rows^2 / 2^65 sets share their first name: none in most tables, a few in the largest.
        twice = frozenset(r["node"] for r in sets.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("node").collect())
        node = F.when(F.col("node").isin(*twice), F.col("other")).otherwise(F.col("node")) if twice else F.col("node")
        docs_n = kept(profile.where("slice is null").select("doc_id", "h1", "h2", "n", node.alias("node")), "ngram-docs")
        if not slices:
            return docs_n.select("doc_id", "h1", "h2", "n", F.col("node").alias("root"))
        sketch = np.concatenate([np.frombuffer(bytes(r["counts"]), np.uint32) for r in sorted(slices, key=lambda r: r["slice"])])
        sent = spark.sparkContext.broadcast(sketch)  # 4 MB, whatever the input
        entries = scratch.saved(mapped(docs.select("text"), _prefixes(n, percent, sent, twice), "gram long, node long, n int, at int"), "ngram-entries")
        shared = entries.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("gram")
        both = entries.join(shared.hint("shuffle_hash"), "gram", "left_semi").groupBy("gram", "node").agg(F.first("n").alias("n"), F.first("at").alias("at"))
        parities = sets.select(node.alias("node"), "bits").groupBy("node").agg(*[F.first(F.col("bits")[k]).alias(f"p{k}") for k in range(PARITY)])
        parities = scratch.saved(parities, "ngram-parities")
        folded = []
        for k in range(FIRST):
            word = F.col(f"p{k}")
            for i in range(k + FIRST, PARITY, FIRST):
                word = word.bitwiseXOR(F.col(f"p{i}"))
            folded.append(word.alias(f"p{k}"))
        several = scratch.saved(both.join(parities.select("node", *folded), "node"), "ngram-several")
        scratch.drop(entries, profile)
        a, b = several.alias("a"), several.alias("b")
        cond = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") != F.col("b.node")) & _may_link(percent, FIRST)
        active = scratch.saved(a.join(b, cond, "left_semi").select("gram", "node", "n", "at").join(parities, "node"), "ngram-active")
        scratch.drop(several, parities)
        roots = classes_of(active, docs, docs_n, n, percent, twice)
        sent.unpersist()
        return docs_n.join(roots, "node", "left").select("doc_id", "h1", "h2", "n", F.coalesce("root", "node").alias("root"))


_FIELDS = ("node", "n", "at", *[f"p{k}" for k in range(PARITY)])


def classes_of(active: DataFrame, docs: DataFrame, docs_n: DataFrame, n: int, percent: int, twice: frozenset[int] = frozenset()) -> DataFrame:
    """(node, root) for every node with a link. active: gram, node, n, at, parity words of the entries that may link."""
    spark = active.sparkSession
    roots = spark.createDataFrame([], "node long, root long")
    nodes = active.select("node").distinct()
    # Of each set, one document tells its n-grams.
    keys = docs_n.where("node is not null").groupBy("node").agg(F.min(F.xxhash64("doc_id")).alias("key")).join(nodes, "node", "left_semi").select("key")
    parts = mapped(keys, _bits, "slice int, bits binary", rows=4096).groupBy("slice").applyInArrow(_or_slices, "slice int, bits binary").collect()
    if not parts:
        return roots
    sent = spark.sparkContext.broadcast([bytes(r["bits"]) for r in sorted(parts, key=lambda r: r["slice"])])
    rows = mapped(docs.select(F.xxhash64("doc_id").alias("key"), "text"), _full_rows(n, sent, twice), "node long, n int, wide array<long>, blocks array<array<long>>")
    name = f"axonlake_rows_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        with Scratch() as scratch:
            rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]).write.option("path", path).bucketBy(buckets, "node").sortBy("node").saveAsTable(name)
            rows = spark.table(name)
            todo, tested, turn = active, None, 0
            while True:
                size = todo.count()
                rooted = fitted(todo.join(roots, "node", "left").select("gram", *_FIELDS, F.coalesce("root", "node").alias("root")), size)
                open_ = rooted.groupBy("gram").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram", "m")
                now = scratch.saved(fitted(rooted.join(fitted(open_, size), "gram"), size), "ngram-open")
                size = now.count()
                if not size:
                    break
                slots = PIVOTS[turn] if turn < len(PIVOTS) else PIVOTS[-1] << (turn - len(PIVOTS) + 1)
                whole = F.col("m") <= SMALL[min(turn, len(SMALL) - 1)]
                mine = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), *_FIELDS, "root")
                pivots = now.where(~whole).groupBy("gram", F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot")).agg(F.min(mine).alias("p"))
                pivots = scratch.saved(fitted(pivots, size).select("gram", *[f"p.{f}" for f in _FIELDS], "p.root"), "ngram-pivots")
                cond = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.root") != F.col("b.root")) & _may_link(percent, PARITY)
                pairs = pivots.alias("a").join(now.where(~whole).alias("b"), cond).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
                if turn:
                    out = now.where(whole).alias("a").join(now.where(whole).alias("b"), cond & (F.col("a.node") < F.col("b.node")))
                    pairs = pairs.unionByName(out.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
                pairs = fitted(fitted(pairs, size).distinct(), size)
                if tested is not None:
                    pairs = fitted(pairs.join(tested, ["a", "b"], "left_anti"), size)
                found = _overlaps(pairs, rows, percent, size, scratch)
                edges = found.where("linked").select("a", "b")
                if turn:
                    edges = edges.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
                roots = components(edges).withColumnRenamed("component", "root")
                failed = found.where("not linked").select("a", "b")
                was, tested = tested, scratch.saved(fitted(failed if tested is None else tested.unionByName(failed), size), "ngram-tested")
                rest = now.where(~whole).join(pivots.select("gram", "node"), ["gram", "node"], "left_anti").select("gram", *_FIELDS)
                todo_was, todo = todo, scratch.saved(fitted(rest, size), "ngram-todo")
                scratch.drop(now, pivots, found, was, None if todo_was is active else todo_was)
                turn += 1
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
        sent.unpersist()
    return roots


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", F.col("n_ngrams").alias("n_shingles"), "component_id")
