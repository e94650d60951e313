"""Soft-membership mixing, with DataFrame functions only.

A naive Bayes classifier, fitted on a bounded sample of the labelled table (normal densities of four document
statistics, presence of the most telling words), gives each document's posterior over the domains. Projected
gradient least squares then fits nonnegative document rates whose expected domain token totals match the targets: a step
moves all rates along the sum over domains of posterior times residual, weighted by the inverse Gram matrix of the documents whose rate is
above 0, and cuts at zero. The moves add up to one number for each domain, so a rate is max(0, 1 - posterior * moves), an expression on its own
row: nothing is written between steps, no join brings rates back, and the plan doesn't grow with the steps.

A step is one sum over a narrow table (tokens, posterior), for several step lengths at once; the one of least value of the least squares' dual,
a convex piecewise quadratic function, is taken. So every step lowers it, and no step is left where it is least: there the residual is
RIDGE times the moves, which is 0 to all purposes where rates can meet the targets, and else shows that none can. Which of the
two it was is part of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, kept, packed, saved, table, unpacked

#: Domains of a labelled document, in this order: toxic, else low quality, else clean.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}
#: Bound of the labelled sample, in labels; and of the telling words.
SAMPLE, VOCABULARY = 4096, 160
#: A telling word stands in so many sampled documents at least, and in this share at most: common words tell length.
LEAST_DOCS, MOST_SHARE = 5, 0.1
#: Greatest distance of a domain's share of all tokens from its target; and of the dual's gradient from zero where they can't be met.
TOLERANCE, STILL = 1e-5, 1e-10
#: Weight of small moves; it decides only where the targets can't be met.
RIDGE = 1e-10
#: Step lengths that are tried at once, and the factor to shorter ones while none helps, down to the least.
LENGTHS, SHORTER, LEAST_LENGTH = (1.0, 0.5, 0.125, 1 / 64), 1 / 512, 1e-8
STATS = 4


@dataclass
class Model:
    domains: list[str] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    mean: list[list[float]] = field(default_factory=list)
    spread: list[list[float]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    present: list[list[float]] = field(default_factory=list)  # by domain, log odds of each word
    absent: list[float] = field(default_factory=list)  # by domain, all words absent


@dataclass
class Fitted:
    """A narrow table (doc_id, tokens, p), the classifier, the moves along the gradient, and whether these met the targets."""

    narrow: DataFrame
    model: Model
    moves: list[float]
    met: bool


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn() whose value is computed once a row: the optimiser can't copy it through a generator into each use."""
    return df.withColumn(name, F.explode(F.array(value)))


def described(df: DataFrame) -> DataFrame:
    """df with words, tokens and x, the statistics, of its column text. A null text has no words."""
    text = F.col("text")
    out = _once(df, "words", F.coalesce(_words(text), F.array().cast("array<string>"))).withColumn("tokens", F.size("words").cast("long"))
    n = F.greatest(F.col("tokens"), F.lit(1))
    size = F.coalesce(F.length(text), F.lit(0))
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#$%&*|<>{}\[\]@=_/^~\\]")), F.lit(0))
    x = [F.log1p("tokens"), F.log1p(size / n), F.sqrt(symbols / F.greatest(size, F.lit(1))), F.size(F.array_distinct("words")) / n]
    return _once(out, "x", F.array(*[c.cast("double") for c in x]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled documents whose labels hash lowest, SAMPLE labels at most."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    chosen = labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(SAMPLE)
    sample = saved(described(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("domain", "words", "x"), "mix-sample")
    x = [F.col("x")[i] for i in range(STATS)]
    rows = {r["domain"]: r for r in sample.groupBy("domain").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(x)]).collect()}
    m = Model([d for d in DOMAINS if d in rows])
    if not m.domains:
        drop(sample)
        return m
    n = {d: rows[d]["n"] for d in m.domains}
    total = sum(n.values())
    words = sample.select("domain", F.explode(F.array_distinct("words")).alias("w"))
    by = words.groupBy("w").agg(F.count("*").alias("c"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c_{d}") for d in m.domains]).where((F.col("c") >= LEAST_DOCS) & (F.col("c") <= MOST_SHARE * total))
    unlike = sum(((F.col(f"c_{d}") - F.col("c") * (n[d] / total)) ** 2) / (F.col("c") * (n[d] / total)) for d in m.domains)
    telling = by.withColumn("unlike", unlike).orderBy(F.desc("unlike"), "w").limit(VOCABULARY).collect()
    drop(sample)
    for d in m.domains:
        r = rows[d]
        m.prior.append(float(np.log(n[d] / total)))
        m.mean.append([r[f"m{i}"] for i in range(STATS)])
        m.spread.append([max(r[f"s{i}"], 0.02) for i in range(STATS)])
        p = [(t[f"c_{d}"] + 0.5) / (n[d] + 1) for t in telling]
        m.present.append([float(np.log(v / (1 - v))) for v in p])
        m.absent.append(float(sum(np.log(1 - v) for v in p)))
    m.words = [t["w"] for t in telling]
    return m


def with_posteriors(df: DataFrame, m: Model) -> DataFrame:
    """df, which has no column of ours but text, with tokens and p, the posterior over m.domains."""
    names = df.columns
    out = described(df)
    known = F.array(*[F.lit(w) for w in m.words]).cast("array<string>")
    out = _once(out, "hits", F.array_intersect("words", known))
    logs = []
    for k in range(len(m.domains)):
        s = F.lit(m.prior[k] + m.absent[k])
        for i in range(STATS):
            s = s - F.lit(float(np.log(m.spread[k][i]))) - 0.5 * ((F.col("x")[i] - m.mean[k][i]) / m.spread[k][i]) ** 2
        if m.words:
            odds = F.create_map(*[v for w, o in zip(m.words, m.present[k], strict=True) for v in (F.lit(w), F.lit(o))])
            s = s + _sum_of(odds)
        logs.append(s)
    out = _once(out, "l", F.array(*logs)).withColumn("top", F.array_max("l"))
    out = _once(out, "e", F.transform("l", _less(F.col("top")))).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    return _once(out, "p", F.transform("e", _share(F.col("sum")))).select(*names, "tokens", "p")


def _sum_of(odds: Column) -> Column:
    return F.aggregate("hits", F.lit(0.0), lambda a, w: a + F.element_at(odds, w))


def _less(top: Column):
    return lambda v: F.exp(v - top)


def _share(total: Column):
    return lambda v: v / total


def rate_of(p: Column, moves: list[float]) -> Column:
    """Rate after the moves, from 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum(p[i] * float(v) for i, v in enumerate(moves))) if len(moves) else F.lit(1.0)


def _sums(narrow: DataFrame, trials: list[np.ndarray], total: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each of the moves tried: the domains' shares, the Gram matrix of the rows whose rate is above 0, and half the squared rates. One job."""
    k = len(trials[0])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p, t = F.col("p"), F.col("tokens")
    rated = narrow.select("tokens", "p", *[rate_of(p, m).alias(f"r{n}") for n, m in enumerate(trials)])
    out = []
    for n in range(len(trials)):
        r = F.col(f"r{n}")
        out += [F.sum(t * r * p[i]) for i in range(k)] + [F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)) for i, j in pairs] + [F.sum(t * r * r) / 2]
    got = np.array(rated.agg(*[c.alias(f"c{n}") for n, c in enumerate(out)]).first(), float).reshape(len(trials), -1) / total
    grams = np.zeros((len(trials), k, k))
    for n, (i, j) in enumerate(pairs):
        grams[:, i, j] = grams[:, j, i] = got[:, k + n]
    return [(got[n, :k], grams[n], float(got[n, -1])) for n in range(len(trials))]


def solve(narrow: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[list[float], bool]:
    """Moves of the projected gradient over narrow(tokens, p), and whether they met the targets: shares of all tokens, scaled to sum to 1."""
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    total = narrow.agg(F.sum("tokens")).first()[0]
    if not total or not want.sum():
        return [], False
    want = want / want.sum()
    moves = np.zeros(len(domains))
    ((share, gram, half),) = _sums(narrow, [moves], float(total))
    ridge = RIDGE * np.maximum(np.diag(gram), 1e-12)  # brings the domains to one scale

    def dual(m: np.ndarray, half: float) -> float:
        return half + want @ m + (ridge * m * m).sum() / 2

    now, scale = dual(moves, half), 1.0
    while scale >= LEAST_LENGTH:
        residual = share - want
        if np.abs(residual).max() < TOLERANCE:
            return moves.tolist(), True
        down = residual - ridge * moves
        if np.abs(down).max() < STILL:
            break
        step = np.linalg.solve(gram + np.diag(ridge), down)
        tried = [moves + scale * f * step for f in LENGTHS]
        found = _sums(narrow, tried, float(total))
        values = [dual(m, half) for m, (_, _, half) in zip(tried, found, strict=True)]
        best = int(np.argmin(values))
        if values[best] < now:
            moves, (share, gram, _), now, scale = tried[best], found[best], values[best], 1.0
        else:
            scale *= SHORTER
    return moves.tolist(), False  # the targets can't be met any closer


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose mean over documents is the rate: the fraction is drawn by a hash of the id."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> Fitted:
    """The rates of docs(doc_id, text)."""
    m = fit(docs, labels)
    own = docs.select("doc_id", "text")
    if not m.domains:
        return Fitted(described(own).select("doc_id", "tokens"), m, [], False)
    narrow = kept(with_posteriors(own, m).select("doc_id", "tokens", "p"), "mix")
    return Fitted(narrow, m, *solve(narrow, m.domains, targets or TARGETS))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies, met) for every row of docs(doc_id, text).

    Tokens are runs of letters and digits. Null and empty texts have none, and a posterior and
    rate like any other. Without labels every rate is 1 and posteriors are null; a domain without labels takes
    part with posterior 0, and its target is shared out among the others. Repeated rows each count; labels repeated
    for a document each teach; an empty table gives no rows; other columns are ignored. met tells whether the expected domain
    totals are within TOLERANCE of the targets; if not, the rates come as close as rates of 0 or more can.
    """
    f = fit_rates(docs, labels, targets)
    rate = rate_of(F.col("p"), f.moves) if f.model.domains else F.lit(1.0)
    ps = [F.col("p")[f.model.domains.index(d)] if d in f.model.domains else F.lit(0.0 if f.model.domains else None).cast("double") for d in DOMAINS]
    out = f.narrow.select("doc_id", "tokens", *[p.alias(f"p_{d}") for p, d in zip(ps, DOMAINS, strict=True)], rate.alias("rate"))
    return out.withColumns({"copies": copies_of(F.col("rate"), F.col("doc_id")), "met": F.lit(f.met)})


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row repeated as often as its copies say; all columns stay, whatever their names.

    Null and empty texts, repeated rows and missing labels as in mixing_rates(); an empty table gives no rows.
    """
    f = fit_rates(docs, labels, targets)
    if not f.model.domains:
        return docs
    rated = with_posteriors(packed(docs, text=F.col("text")), f.model)
    copies = _once(rated, "n", copies_of(rate_of(F.col("p"), f.moves), F.col("row")["doc_id"]))
    return unpacked(copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")), docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
