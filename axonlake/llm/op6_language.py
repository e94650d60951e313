"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text with non-letters folded to one
mark. Document frequencies cover every training document. The weights are learned with follow-the-
regularised-leader (proximal, per-coordinate rates, L1 and L2 penalties) from a bounded sample of training
documents; a temperature, fitted on held-back rows of the sample, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, give_back, mapped, saved, table

BITS = 14
DIM = 1 << BITS
#: Rows sampled in all, which the driver holds packed: 600 a language up to 40 languages, fewer each beyond.
MOST_SAMPLED = 24_000
#: Expected number of sampled training documents for each language: the bound of the sample.
PER_LANG = 600
UNDETERMINED = "und"
#: Texts are counted in slices of about so many characters, so that a long text needs no more memory.
SLICE = 1 << 20

_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_FOLD = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed 1-, 2- and 3-grams of code points, as feature ids by position of their first character."""
    shift = np.uint32(32 - BITS)
    a = codes * _MULT[0]
    yield (a * np.uint32(0x9E3779B1)) >> shift
    b = a[:-1] ^ (codes[1:] * _MULT[1] + np.uint32(0x165667B1))
    yield (b * np.uint32(0x85EBCA6B)) >> shift
    c = (b[:-1] * np.uint32(31)) ^ (codes[2:] * _MULT[2] + np.uint32(0x27D4EB2F))
    yield (c * np.uint32(0xC2B2AE35)) >> shift


def counts(text: str) -> np.ndarray | None:
    """Feature counts of a text, or None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    low = codes < 0x250
    folded = np.where(low, _FOLD[np.where(low, codes, 0)], codes)
    if not (folded != 32).any() or (not (folded[low] != 32).any() and not any(c.isalpha() for c in text)):
        return None
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)  # runs of non-letters count once
    folded = np.concatenate(([np.uint32(32)], folded[keep], [np.uint32(32)])).astype(np.uint32)
    total = np.zeros(DIM, np.int64)
    for s in range(0, len(folded), SLICE):
        for ids in _grams(folded[s : s + SLICE + 2]):
            total += np.bincount(ids[:SLICE], minlength=DIM)
    return total


def weighted(ids: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of the features present, of unit length."""
    x = np.log1p(count) * idf[ids]
    return x / np.sqrt((x * x).sum())


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIM + 1, languages), the last row is the intercept
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text) if text else None
        if c is None or not self.langs:
            return UNDETERMINED, 0.0
        ids = np.flatnonzero(c)
        p = softmax((weighted(ids, c[ids], self.idf) @ self.weights[ids] + self.weights[-1]) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[Callable[[], tuple[np.ndarray, np.ndarray]]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """FTRL-proximal over sparse rows, each a function that gives (ids, values), in a fixed shuffled order; returns the dense weights, mostly zero."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    penalty = np.full((DIM + 1, 1), l1)
    penalty[-1] = 0

    def weights(i):
        a, b = z[i], np.sqrt(n[i])
        return np.where(np.abs(a) > penalty[i], -(a - np.sign(a) * penalty[i]) / ((beta + b) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, values = rows[r]()
            w = weights(ids)
            p = softmax(values @ w)
            p[y[r]] -= 1
            g = values[:, None] * p[None, :]
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    return weights(np.arange(DIM + 1))


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least negative log likelihood on a fixed grid, ties to the smaller."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """train: doc_id, text, lang. Null languages and texts without letters teach nothing.

    One pass over all training texts sums document frequencies (a fixed DIM numbers for each task) and returns
    the sparse counts of the sampled rows: for each language those whose id and text hash lowest, per_lang expected. Rows of one id
    with other texts, and rows without an id, are drawn each by itself.
    """
    spark = train.sparkSession
    train = train.where("lang is not null and text is not null")
    per = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return LanguageModel([], np.ones(DIM), np.zeros((DIM + 1, 0)), 1.0)
    langs = sorted(per)
    per_lang = min(per_lang, MOST_SAMPLED // max(1, len(per)))  # many languages share one bound
    share = {k: per_lang / n for k, n in per.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(DIM, np.int64), 0
        for b in batches:
            out: list[tuple] = []
            for text, lang, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c = counts(text)
                if c is None:
                    continue
                ids = np.flatnonzero(c)
                seen[ids] += 1
                docs += 1
                if u < share[lang]:
                    out.append((lang, u, ids.astype("<u2").tobytes(), np.log1p(c[ids]).astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["lang", "u", "ids", "counts"])
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([float(docs)]), pa.array([None], pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], ["lang", "u", "ids", "counts"])

    u = (F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    got = saved(mapped(train.select("text", "lang", u), gather, "lang string, u double, ids binary, counts binary"), "lang-train")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(DIM, np.int64), 0.0
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.frombuffer(x, "<i8")
                docs += n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total.tobytes()], pa.binary())], ["u", "counts"])

    parts = mapped(got.where("lang is null").select("u", "counts").coalesce(8), added, "u double, counts binary").collect()
    sample = got.where("lang is not null").collect()
    drop(got)
    docs = sum(r["u"] for r in parts)
    df = sum((np.frombuffer(bytes(r["counts"]), "<i8") for r in parts), np.zeros(DIM, np.int64))
    idf = np.log((1 + docs) / (1 + df)) + 1
    sample.sort(key=lambda r: (r["lang"], r["u"], bytes(r["ids"])))
    y = np.array([langs.index(r["lang"]) for r in sample], int)

    def row(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Features of a sampled row, unpacked when they are used: the sample stays small on the driver."""
        ids = np.frombuffer(sample[k]["ids"], "<u2").astype(np.int64)
        x = np.frombuffer(sample[k]["counts"], "<f4") * idf[ids]
        return np.append(ids, DIM), np.append(x / np.sqrt((x * x).sum()), 1.0)

    held = np.arange(len(sample)) % 5 == 4
    learn = np.flatnonzero(~held)
    w = ftrl([lambda k=k: row(k) for k in learn], y[learn], len(langs))
    z = np.array([v @ w[i] for i, v in map(row, np.flatnonzero(held))]).reshape(-1, len(langs))
    model = LanguageModel(langs, idf, w, best_temperature(z, y[held]))
    del sample
    give_back()
    return model


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in keep, then lang_pred and score, under the names given (calibrated probability of lang_pred)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, *names])

    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col))  # the text comes last, whatever its name
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return mapped(taken, score, schema)


def held_out():
    """True where crc32 of doc_id as text leaves remainder 1 by 3; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...), learned from rows not held out.

    Null texts, empty ones and those without letters get 'und' and score 0, as does every row if no row
    teaches a language. Texts are read whole; repeated rows are scored each; an empty table gives no rows;
    other columns are ignored. Ties go to the language first in order.
    """
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
