"""Demixed principal components (A24) from sums over conditions: nothing but neurons x neurons numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGINALS = ("m_t", "m_s", "m_st")


@dataclass
class Demixed:
    """Names of the neurons in the order of all arrays; for each marginal its decoder and encoder (neurons, k), and explained, the share of all variance of
    each component; and projections: marginal, component, stimulus, t, z."""

    neurons: list
    decoders: dict[str, np.ndarray]
    encoders: dict[str, np.ndarray]
    explained: dict[str, np.ndarray]
    projections: DataFrame


def _vectors(marginals: DataFrame, names: list) -> DataFrame:
    """(stimulus, t, x, m_t, m_s, m_st) with an array over the neurons for each condition; what a neuron lacks is 0."""
    place = F.create_map(*[c for k, n in enumerate(names) for c in (F.lit(n), F.lit(k))])
    cells = marginals.select("stimulus", "t", F.element_at(place, F.col("neuron")).alias("k"), (F.col("m_t") + F.col("m_s") + F.col("m_st")).alias("x"), *MARGINALS)
    listed = cells.groupBy("stimulus", "t").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("x", *MARGINALS).alias("v")))).alias("m"))

    def over(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k)[c], F.lit(0.0))).alias(c)

    return listed.select("stimulus", "t", *[over(c) for c in ("x", *MARGINALS)])


def _products(vectors: DataFrame, n: int) -> np.ndarray:
    """Sums over conditions of x x' and, for each marginal, of m x': (4, n, n). A task adds up its own first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, n, n))
        for b in batches:
            x, *ms = (c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in b.columns)
            total += np.stack([x.T @ x, *(m.T @ x for m in ms)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    out = np.zeros(4 * n * n)
    for r in vectors.select("x", *MARGINALS).mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(4, n, n)


def _leading(m: np.ndarray, k: int) -> np.ndarray:
    """Eigenvectors of the k largest eigenvalues; the entry of largest size is positive."""
    w, v = np.linalg.eigh(m)
    v = v[:, np.argsort(-w, kind="stable")[:k]]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign)


def demixed(marginals: DataFrame, k: int = 10, ridge: float = 1e-9) -> Demixed:
    """Components of each marginal by reduced-rank regression of the marginal on the data (Kobak et al., 2016).

    marginals: neuron, stimulus, t, m_t, m_s, m_st, as responses.marginals() gives them, one row for a neuron and condition. The regression is
    a = (m x') (x x' + ridge)^-1; the encoder is the k leading directions of its fit a x, the decoder a' times these, and a projection is the decoder
    applied to the data of a condition. All three come from the sums x x' and m x'. k is at most the number of neurons; an
    empty table gives no components.
    """
    names = [r[0] for r in marginals.select("neuron").where("neuron IS NOT NULL").distinct().orderBy("neuron").collect()]  # a dimension
    n = len(names)
    if not n:
        none = marginals.select(F.lit("").alias("marginal"), F.lit(0).alias("component"), "stimulus", "t", F.lit(0.0).alias("z")).limit(0)
        return Demixed([], *({m: np.zeros((0, 0)) for m in MARGINALS} for _ in range(2)), {m: np.zeros(0) for m in MARGINALS}, none)
    vectors = _vectors(marginals.where("neuron IS NOT NULL"), names)
    gram, *crossed = _products(vectors, n)
    total = np.trace(gram)
    inverse = np.linalg.inv(gram + (ridge * total / n or 1.0) * np.eye(n))
    decoders, encoders, explained, parts = {}, {}, {}, []
    for name, cross in zip(MARGINALS, crossed, strict=True):
        a = cross @ inverse
        u = _leading(a @ gram @ a.T, min(k, n))
        d = a.T @ u
        decoders[name], encoders[name] = d, u
        explained[name] = np.einsum("nk,nm,mk->k", d, gram, d) / total if total else np.zeros(d.shape[1])
        z = [F.aggregate(F.zip_with("x", F.lit(d[:, c].tolist()), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) for c in range(d.shape[1])]
        parts.append(F.struct(F.lit(name).alias("marginal"), F.array(*z).alias("z")))
    rows = vectors.select("stimulus", "t", F.explode(F.array(*parts)).alias("m"))
    projections = rows.select("m.marginal", F.posexplode("m.z").alias("component", "z"), "stimulus", "t").select("marginal", "component", "stimulus", "t", "z")
    return Demixed(names, decoders, encoders, explained, projections)
