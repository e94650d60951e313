"""Periodic runs of words: all-lag vectorised scan.

A run is a stretch of words with smallest period q that is at least MIN_EXP periods and LEAST words long and that no neighbouring word
extends. A text becomes an array of word ids, which is compared with itself at every shift q up to n / MIN_EXP; a run is a stretch
of agreements of its length less q. Shifts are compared in blocks, at every s-th word first: a stretch of 2 s agreements holds two neighbouring
such words, so a shift where no two agree has none. The others are compared whole and their agreements run-length encoded.
A stretch whose period is a multiple of a smaller one is told by the prime divisors of q (periods of a stretch of two and more of them divide
each other: Fine and Wilf, 1965).

The scan is quadratic where a text repeats throughout, so a text over LONG_BYTES is dealt out as ranges of shifts, each a row of its own with the
word ids; what they find meets again by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

MIN_EXP, LEAST = 4, 6
#: Texts over so many bytes are dealt out by ranges of shifts: so many comparisons a range, and so many shifts at least, as each carries all ids.
LONG_BYTES, RANGE_WORK, RANGE_LAGS = 1 << 16, 1 << 28, 1024
#: Comparisons of a block of shifts.
BLOCK = 1 << 21

RUN = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: A change to a document's words before they are scanned, by its id.
Change = Callable[[int | None, list[bytes]], list[bytes]]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks (0x20, 0x09 to 0x0D)."""
    return text.encode("utf-8").split() if text else []


def ids_of(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int32) if words else np.empty(0, np.int32)


def shortest(q: int) -> int:
    """Least agreements at shift q that make a run."""
    return max(LEAST, MIN_EXP * q) - q


def _likely(ids: np.ndarray, lo: int, hi: int) -> Iterator[int]:
    """Shifts of [lo, hi) at which two neighbouring sampled words agree with those q further."""
    n, q = len(ids), lo
    ends = np.concatenate([ids, np.full(hi, -1, np.int32)])
    while q < hi:
        s = max(1, shortest(q) // 2)
        at = np.arange(s - 1, n - q, s)
        k = min(hi - q, max(1, BLOCK // max(1, len(at))))
        same = np.lib.stride_tricks.sliding_window_view(ends, k)[at + q] == ids[at, None]
        yield from (q + np.flatnonzero((same[:-1] & same[1:]).any(axis=0))).tolist()
        q += k


def _primes_of(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def runs_at(ids: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose smallest period is in [lo, hi), by period and start."""
    out = []
    for q in _likely(ids, lo, min(hi, len(ids) // MIN_EXP + 1)):
        same = np.zeros(len(ids) - q + 2, np.int8)
        same[1:-1] = ids[:-q] == ids[q:]
        turns = np.flatnonzero(np.diff(same))
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts >= shortest(q)
        smaller = [q // p for p in _primes_of(q)] if long.any() else []
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            if not any((ids[s : s + q] == ids[s + d : s + d + q]).all() for d in smaller):
                out.append((s, e - s + q, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that stand in no run after its first period, joined by one space."""
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            cover[s + q] += 1
            cover[s + n] -= 1
        words = [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]
    return b" ".join(words).decode("utf-8")


def _structs(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def _whole(change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, texts = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                words = change(doc_id, words) if change and words else words
                runs = sorted(runs_at(ids_of(words), 1, len(words) + 1))
                counts.append(len(words))
                found.append(_structs(runs))
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, _RUN), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def _ids(change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                each.append(ids_of(change(doc_id, words) if change and words else words))
            lags = [len(x) // MIN_EXP for x in each]
            step = [max(RANGE_LAGS, RANGE_WORK // max(1, len(x))) for x in each]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(lags, pa.int64()), pa.array(step, pa.int64())], ["key", "ids", "lags", "step"])

    return run


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, ids, lo, step in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs = runs_at(np.frombuffer(ids, np.int32), lo, lo + step)
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs)), *(pa.array(c, pa.int64()) for c in zip(*runs, strict=True))], ["key", "start", "length", "period"])


def _collapse(change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, texts = [], [], []
            for doc_id, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                words = change(doc_id, words) if change and words else words
                runs = [(r["start"], r["length"], r["period"]) for r in runs or []]
                counts.append(len(words))
                found.append(_structs(runs))
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, _RUN), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: runs by start, then period, and the text without what they repeat.

    A null or empty text has no words, no runs and an empty collapsed text. Whole texts are read, however long; long_bytes only decides which are
    dealt out. Repeated rows each come back, an empty table gives no rows, other columns are ignored. change, if given, is applied to a
    document's words first; it must depend on its arguments alone.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id long, n_words long, runs {RUN}, collapsed string"
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = mapped(own.where(size <= long_bytes), _whole(change), schema)
    # Rows of one id and text find the same runs: a key made of both is the same in each reading of the table.
    long = own.where(size > long_bytes).select("doc_id", "text", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256).alias("key"))
    ids = mapped(long.dropDuplicates(["key"]), _ids(change), "key string, ids binary, lags long, step long", rows=1)
    ranges = ids.where("lags > 0").select("key", "ids", "step", F.explode(F.expr("sequence(1L, lags, step)")).alias("lo")).repartition("key", "lo")
    found = mapped(ranges.select("key", "ids", "lo", "step"), _range, "key string, start long, length long, period long", rows=1)
    runs = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    runs = runs.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    rest = mapped(long.join(runs, "key", "left").select("doc_id", "text", "runs"), _collapse(change), schema, rows=1)
    return short.unionByName(rest)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, told by its id, with its words from some place on replaced by a repetition; a row without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), change=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
