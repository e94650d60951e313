"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and then towards its diagonal. A
document's score comes from the difference of the two log densities: Mahalanobis distances by the cached
Cholesky factors, plus log determinants and log priors.

Plan: one pass turns whole texts into a narrow table of statistics; moments are grouped sums over it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, mapped, table

NAMES = ("log_words", "word_length", "word_spread", "upper", "digit", "comma_stop", "symbol", "high", "distinct_words", "adjacent_repeats", "distinct_lines", "line_length", "deflated", "top_word")
D = len(NAMES)
#: Shares of the pooled covariance in a class's, and of the diagonal in the result.
POOL, DIAGONAL = 0.1, 0.1
#: Scores at or above this are predicted as 1.
THRESHOLD = 0.7
#: Words and bytes of usual text that each text is taken to have besides its own, so that short texts aren't odd by chance.
PRIOR_WORDS, PRIOR_BYTES = 20, 120
#: Bytes of a text given to the compressor at a time.
BLOCK = 1 << 16

_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 comma or stop, 5 symbol, 6 other scripts and accents
for _c in range(256):
    ch = chr(_c)
    _CLASS[_c] = 6 if _c >= 128 else 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if _c in b" \t\n\r\v\f" else 4 if ch in ".,;:!?'\"()-" else 5


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics; those of a text without words are zeros."""
    out = np.zeros(D)
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    n, size = len(words), len(data)
    by = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    lengths = np.fromiter(map(len, words), np.int64, n)
    mean = (lengths.sum() + PRIOR_WORDS * 6) / (n + PRIOR_WORDS)
    spread = np.sqrt((((lengths - mean) ** 2).sum() + PRIOR_WORDS * 9) / (n + PRIOR_WORDS))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = data.split(b"\n")
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[i : i + BLOCK])) for i in range(0, size, BLOCK)) + len(packer.flush())
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))

    def share(count: int, usual: float = 0.0) -> float:
        return np.sqrt((count + usual * PRIOR_BYTES) / (size + PRIOR_BYTES))

    out[:] = (
        np.log1p(n),
        np.log(mean),
        np.log(spread),
        share(by[1], 0.02),
        share(by[2]),
        share(by[4], 0.02),
        share(by[5]),
        share(by[6]),
        np.log((len(seen) + PRIOR_WORDS) / (n + PRIOR_WORDS)),
        np.sqrt(repeats / (n + PRIOR_WORDS)),
        (len(set(lines)) + 3) / (len(lines) + 3),
        np.log1p(size / len(lines)),
        np.log((packed - 8 + 0.5 * 2 * PRIOR_BYTES) / (size + 2 * PRIOR_BYTES)),
        np.sqrt(max(seen.values()) / (n + PRIOR_WORDS)),
    )
    return out


@dataclass
class Discriminant:
    means: np.ndarray  # (2, D)
    factors: np.ndarray  # (2, D, D) inverse Cholesky factors
    offsets: np.ndarray  # (2,) log prior minus half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        logs = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def shrunk(covariances: list[np.ndarray], counts: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL) -> list[np.ndarray]:
    pooled = sum(c * n for c, n in zip(covariances, counts, strict=True)) / counts.sum()
    out = []
    for c in covariances:
        s = (1 - pool) * c + pool * pooled
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s))
        out.append(s + np.eye(len(s)) * (1e-4 + 1e-3 * np.trace(pooled) / len(s)))
    return out


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant | None:
    """From each class's row count, sums and sums of products; None unless both classes have rows."""
    if (counts < 1).any():
        return None
    means = sums / counts[:, None]
    cov = [squares[k] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    low = [np.linalg.cholesky(s) for s in shrunk(cov, counts)]
    offsets = np.array([np.log(counts[k] / counts.sum()) - np.log(np.diag(low[k])).sum() for k in (0, 1)])
    return Discriminant(means, np.array([np.linalg.inv(x) for x in low]), offsets)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in b.column(1).to_pylist()]
        flat = np.concatenate(x) if x else np.empty(0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), pa.array(flat))], ["doc_id", "x"])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text, in the order of NAMES."""
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _describe, "doc_id long, x array<double>")


def train(described: DataFrame, labels: DataFrame) -> Discriminant | None:
    """labels: doc_id, quality (0 or 1; other values and nulls teach nothing). Every labelled row counts."""
    joined = described.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    upper = [(i, j) for i in range(D) for j in range(i, D)]
    x = [F.col("x")[i] for i in range(D)]
    rows = joined.groupBy("quality").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("p")).collect()
    counts, sums, squares = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for r in rows:
        k = int(r["quality"])
        counts[k], sums[k] = r["n"], r["s"]
        for (i, j), v in zip(upper, r["p"], strict=True):
            squares[k, i, j] = squares[k, j, i] = v
    return discriminant(counts, sums, squares)


def held_out():
    """True where crc32 of doc_id as text leaves remainder 2 by 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learned from labels of rows not held out.

    Null and empty texts have statistics of zero and get a score like any other. Without labels of both classes
    every score is 0.5. Repeated rows are scored each, and a label repeated or joined to a repeated row counts
    each time; an empty table gives no rows; other columns are ignored.
    """
    described = kept(describe(docs), "quality-statistics")
    model = train(described.where(~held_out()), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            s = model.scores(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(described.select("doc_id", held_out().alias("held_out"), "x"), run, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
