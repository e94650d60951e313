"""What the training-data operators share: scratch tables, batch bounds, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a Python worker takes at a time, so that long texts stay small in its memory.
BATCH_ROWS, BATCH_BYTES = 64, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The session's Arrow batches cut to so many rows, fewer where rows are long. The session's settings stay as they are."""
    for b in batches:
        each = max(1, min(rows, BATCH_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, each):
            yield b.slice(at, each)


def give_back() -> None:
    """Returns what this process has freed to the system: workers live on between tasks, beside the executor's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, function: Callable, schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow in small batches; the worker's memory is given back when a task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(pieces(batches, rows))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """df's columns as one struct `row`, so that none clashes with a name of ours, and more columns beside it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(None).alias("none"))
    return df.select(whole.alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The caller's columns again."""
    return df.select(*[F.col("row")[c].alias(c) for c in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine, where none is named, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="axonlake-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a scratch table in the shared folder and reads it back: cuts the lineage, and outlives executors.

    drop() deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/axonlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._axonlake_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_axonlake_path", None)
        if path:
            remove(t.sparkSession, path)


class Scratch:
    """Scratch tables of one operator; as a context, deletes what is left of them at its end, also after a failure."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(saved(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame | None) -> None:
        drop(*tables)
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        drop(*self.tables)
        self.tables = []


def kept(df: DataFrame, name: str, cell: str | None = None) -> DataFrame:
    """saved(), for what a lazy result still reads: a checkpoint, whose files Spark's cleaner removes with the last plan that uses them.

    Written as Parquet first, as checkpoint() computes its input twice. cell names a column with the number of the task that read a row.
    """
    shared_dir(df.sparkSession)
    first = saved(df, name)
    out = (first.withColumn(cell, F.spark_partition_id()) if cell else first).checkpoint()
    drop(first)
    return out


#: Rows of a narrow table that one task takes.
ROWS_EACH = 50_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many rows ask for: a small table's stages don't run the session's shuffle partitions."""
    k = max(1, -(-rows // ROWS_EACH))
    return df.coalesce(k) if k < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: Edges from which one task builds a forest.
EDGES_EACH = 1 << 20


def merge_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the groups of a[i] and b[i]: hooks larger roots under smaller ones until nothing changes."""
    while True:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(x, y)[open_], np.minimum(x, y)[open_])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as (node, smallest node of its group); what is held is at most an edge for each node, and EDGES_EACH more."""
    u, v, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([*u, *v]), return_inverse=True)
        half, parent = sum(map(len, u)), np.arange(len(nodes))
        merge_roots(parent, at[:half], at[half:])
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        return nodes[child], nodes[parent[child]]

    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
        held += b.num_rows
        if held > EDGES_EACH:
            x, y = joined()
            u, v, held = [x], [y], 0
    if u:
        x, y = joined()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Each task turns its edges into a forest; where one task can take them all, that is the result. Else alternating large-star
    and small-star steps (Kiveris et al., 2014) follow as joins and grouped minima, each written to the shared folder, until it can or nothing
    changes. A hub is a grouped minimum (combined before the shuffle) and a join that adaptive execution can split, never a list of
    neighbours. Self loops and null ends are ignored; an empty table gives no rows; repeated edges count once.
    """
    with Scratch() as scratch:
        e = scratch.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
        mark = _mark(e)
        while mark[0]:
            tasks = -(-mark[0] // EDGES_EACH)
            forest = scratch.saved(mapped(e.coalesce(tasks), _forest, "u long, v long", rows=EDGES_EACH), "forest")
            scratch.drop(e)
            if tasks == 1:
                e = forest
                break
            e, size = forest, mark[0]
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = scratch.saved(fitted(large.distinct(), size), "large-star")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = small.unionByName(low.select("u", F.col("m").alias("v")))
            nxt = scratch.saved(fitted(small.distinct(), size), "small-star")
            scratch.drop(e, large)
            e, was, mark = nxt, mark, _mark(nxt)
            if was == mark:
                break
        roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        heads = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
        return kept(fitted(roots.unionByName(fitted(heads, mark[0]).distinct()), mark[0]), "components")
