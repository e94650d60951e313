"""Operators on whole tables against brute force: mixing, sharding, near-duplicates, decontamination, the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.llm import op3_mixing as op3
from axonlake.llm import op4_sharding as op4
from axonlake.llm import op5_embedding_dedup as op5
from axonlake.llm import op9_ngram_join as op9
from axonlake.llm import op10_decontaminate as op10
from axonlake.llm.common import components

SF = "/root/testdata/sf0.001"


def classes(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---------------------------------------------------------------- shared


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, k) for k in range(201, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(300, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 3


def least_squares(p, t, want):
    """The optimum by another way: Newton's method on the dual of the nearest nonnegative rates to 1 that meet the targets."""
    lam = np.zeros(p.shape[1])
    for _ in range(200):
        r = np.maximum(0, 1 - p @ lam)
        gap = (r * t) @ p / t.sum() - want
        on = r > 0
        hess = (p[on] * t[on, None]).T @ p[on] / t.sum()
        lam += np.linalg.lstsq(hess + 1e-12 * np.eye(len(want)), gap, rcond=None)[0]
        if np.abs(gap).max() < 1e-12:
            break
    return np.maximum(0, 1 - p @ lam), gap


@pytest.mark.parametrize("seed", range(3))
def test_rates_meet_targets(spark, seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 500, 400)
    narrow = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(p, t, strict=True)], "p array<double>, tokens long")
    steps, met = op3.solve(narrow, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2})
    r = np.array([x[0] for x in narrow.select(op3.rate_of(F.col("p"), steps)).collect()])
    assert met and (r >= 0).all() and np.allclose((r * t) @ p / t.sum(), [0.5, 0.3, 0.2], atol=op3.TOLERANCE)
    # an optimum of the least squares is one with no residual, as the independent solution has
    _, gap = least_squares(p, t, np.array([0.5, 0.3, 0.2]))
    assert np.abs(gap).max() < 1e-9


@pytest.mark.parametrize("spread", [2, 1, 0.5, 0.3, 0.2, 0.1])
def test_few_steps_however_alike_the_domains(spark, spread, monkeypatch):
    """Targets that are known to be within reach are met, and those known not to be aren't, in few steps."""
    rng = np.random.default_rng(3)
    z = rng.normal(0, spread, (500, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    t = rng.integers(1, 300, 500)
    narrow = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(p, t, strict=True)], "p array<double>, tokens long").cache()
    sums, jobs = op3._sums, []
    monkeypatch.setattr(op3, "_sums", lambda *a: jobs.append(1) or sums(*a))
    rates = rng.gamma(0.3, 1, 500)
    inside = (rates * t) @ p / (rates * t).sum()
    steps, met = op3.solve(narrow, ["a", "b", "c"], dict(zip("abc", inside.tolist(), strict=True)))
    r = np.maximum(0, 1 - p @ np.array(steps))
    assert met and len(jobs) < 50 and np.allclose((r * t) @ p / t.sum(), inside, atol=op3.TOLERANCE)
    jobs.clear()
    steps, met = op3.solve(narrow, ["a", "b", "c"], {"a": 1.0})  # every document has something of b
    r = np.maximum(0, 1 - p @ np.array(steps))
    residual = ((r * t) @ p / t.sum() - [1, 0, 0]) / np.diag((p * t[:, None]).T @ p / t.sum())
    assert not met and len(jobs) < 50
    assert np.abs((p @ residual)[r > 0]).max() < 1e-3 and (p @ residual)[r == 0].min() > -1e-3  # no rate above 0 has a way down, none at 0 has one up
    narrow.unpersist()


def test_targets_that_no_rates_meet(spark):
    """Both domains always stand half and half: 90 to 10 can't be had, and the result says so and comes as close as can be."""
    narrow = spark.createDataFrame([([0.5, 0.5], 10), ([0.4, 0.6], 10)], "p array<double>, tokens long")
    steps, met = op3.solve(narrow, ["a", "b"], {"a": 0.9, "b": 0.1})
    r = np.array([x[0] for x in narrow.select(op3.rate_of(F.col("p"), steps)).collect()])
    assert not met and r[1] == 0

    def loss(x, p=np.array([[0.5, 0.5], [0.4, 0.6]]), want=np.array([0.9, 0.1])):
        w = 1 / np.diag(p.T @ p / 2)
        return (w * ((x @ p) / 2 - want) ** 2).sum()

    assert all(loss(r) <= loss(np.maximum(0, r + d)) + 1e-6 for d in np.random.default_rng(0).normal(0, 0.05, (300, 2)))


def test_posteriors_by_hand(spark):
    m = op3.Model(["clean", "low"], [-0.5, -1.0], [[1.0, 2.0, 0.1, 0.9], [2.0, 1.0, 0.3, 0.5]], [[0.5, 1.0, 0.2, 0.1], [1.0, 0.5, 0.1, 0.4]], ["buy", "now"], [[-2.0, 0.3], [1.5, 0.2]], [-0.1, -0.4])
    texts = ["Buy it, now! now", "plain words", "", None, "# a_b @ 9"]
    got = op3.with_posteriors(spark.createDataFrame([(t,) for t in texts], "text string"), m).collect()
    for r, text in zip(got, texts, strict=True):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if x]
        size, n = len(text or ""), max(1, len(w))
        x = [np.log1p(len(w)), np.log1p(size / n), np.sqrt(sum(c in "#$%&*|<>{}[]@=_/^~\\" for c in text or "") / max(1, size)), len(set(w)) / n]
        logs = [m.prior[k] + m.absent[k] + sum(m.present[k][i] for i, v in enumerate(m.words) if v in w) - sum(np.log(m.spread[k][i]) + 0.5 * ((x[i] - m.mean[k][i]) / m.spread[k][i]) ** 2 for i in range(4)) for k in range(2)]
        e = np.exp(np.array(logs) - max(logs))
        assert r["tokens"] == len(w) and np.allclose(r["p"], e / e.sum(), atol=1e-12)


def test_mixing_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "a b"), (9003, "x y"), (9003, "x y")], "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (9003, None, None)], "doc_id long, quality int, toxic int"))
    clash = ("rate", "_x", "x", "p", "tokens", "n", "l", "copy", "row", "_words", "hits", "e", "top", "sum", "words", "_p")
    both = docs.select("doc_id", "text").unionByName(odd).withColumns({c: F.lit(c) for c in clash})
    got = op3.mixing_rates(both, labels).toPandas()
    assert len(got) == docs.count() + 5 and (got["rate"] >= 0).all() and np.allclose(got[["p_clean", "p_low", "p_toxic"]].sum(axis=1), 1)
    share = {d: (got["rate"] * got["tokens"] * got[f"p_{d}"]).sum() / got["tokens"].sum() for d in op3.DOMAINS}
    assert all(abs(share[d] - w) < 1e-3 for d, w in op3.TARGETS.items())
    assert set(got["copies"] - np.floor(got["rate"])) <= {0, 1}
    assert op3.mixed(both, labels).columns == both.columns
    assert got["met"].all()
    again = op3.mixed(both, labels).collect()
    assert len(again) == got["copies"].sum() and all(r[c] == c for r in again for c in clash)


def test_mixing_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["copies"] for r in op3.mixing_rates(docs, none).collect()] == [1, 1] and op3.mixed(docs, none).count() == 2
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert op3.mixing_rates(docs.limit(0), one).count() == 0


# ---------------------------------------------------------------- 4


def _greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Index of the first item of each shard but the first, or None if capacity doesn't suffice."""
    cuts, used = [], 0
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if used + s > capacity:
            cuts.append(i)
            used = 0
            if len(cuts) >= shards:
                return None
        used += s
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity for which the greedy walk needs at most that many shards (0 for no items)."""
    if not sizes:
        return 0
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if _greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def test_smallest_capacity_by_trial():
    rng = random.Random(4)
    for _ in range(200):
        sizes, k = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 6)
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(sizes)), j) for j in range(min(k, len(sizes))))
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in cuts)
        atoms = [op4.Atom(i, None, 0, s, 1) for i, s in enumerate(sizes)]
        prefix = op4._prefix(atoms)
        assert smallest_capacity(sizes, k) == best == op4._least(prefix, atoms, k, False, max(sizes))
        cuts = op4._balanced(prefix, atoms, best, k)
        assert len(cuts) < k and max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes)), strict=True)) == best


@pytest.mark.parametrize("heavy", [0, 0.05, 0.5])
def test_cuts_bring_few_ranges_to_the_driver(spark, monkeypatch, heavy):
    """50,000 groups, one of which may hold half of all bytes: few rows come to the driver, and the capacity is the least there is."""
    rng = np.random.default_rng(7)
    n, came = 50_000, []
    keys, sizes = rng.choice(1 << 62, n, replace=False), rng.integers(1, 9000, n)
    sizes[123] = max(sizes[123], int(sizes.sum() * heavy / (1 - heavy)))
    groups = spark.createDataFrame(list(zip(keys.tolist(), range(n), sizes.tolist(), strict=True)), "k1 long, k2 long, size long").cache()
    split = op4._split
    monkeypatch.setattr(op4, "_split", lambda *a: (came.append(len(got := split(*a))), got)[1])
    cuts = op4.minimax_cuts(groups, 16)
    order = np.argsort(keys)
    bounds = [0, *np.searchsorted(keys[order], [k for k, _ in cuts]).tolist(), n]
    shards = [int(sizes[order][a:b].sum()) for a, b in itertools.pairwise(bounds)]
    assert max(shards) == smallest_capacity(sizes[order].tolist(), 16)
    assert max(came) <= 2 << op4.LEVEL_BITS and len(came) <= 8
    if heavy < 0.5:
        assert min(shards) > 0.9 * max(shards)
    else:
        others = sorted(shards)[:-1]
        assert len(shards) >= 15 and others[-1] < 1.5 * others[1]
    groups.unpersist()


@pytest.mark.parametrize("bits", [3, 1])
def test_equal_first_keys_are_told_by_the_second(spark, monkeypatch, bits):
    monkeypatch.setattr(op4, "LEVEL_BITS", bits)
    monkeypatch.setattr(op4, "LEAF_GROUPS", 0)
    rows = [(5 + i // 40, i, 1 + i % 7) for i in range(200)]
    cuts = op4.minimax_cuts(spark.createDataFrame(rows, "k1 long, k2 long, size long"), 6)
    shards = [0] * 6
    for k1, k2, s in rows:
        shards[sum(k1 > a or (k1 == a and (b is None or k2 >= b)) for a, b in cuts)] += s
    assert max(shards) == smallest_capacity([s for _, _, s in rows], 6)


@pytest.mark.parametrize("leaf", [50_000, 0])
def test_shards(spark, monkeypatch, leaf):
    monkeypatch.setattr(op4, "LEAF_GROUPS", leaf)
    monkeypatch.setattr(op4, "LEVEL_BITS", 3)
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(300) + str(i % 90)) for i in range(400)] + [(500 + i, "hot text " * 40) for i in range(60)] + [(1, None), (2, ""), (None, "é"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, size int")
    got = op4.shard_by_bytes(docs).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} <= set(range(16))
    order, sizes, shards = {}, {}, {}
    for r, k in zip(got, got, strict=True):
        sizes[r["text_crc32"], r["size"]] = sizes.get((r["text_crc32"], r["size"]), 0) + r["size"]
        shards.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for k, s in shards.items() if k != (0, 1)) and max(len(s) for s in shards.values()) <= 2
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    # minimax over the groups in their order
    keyed = docs.select(op4._unsigned(F.xxhash64(F.lit(17), "text")).alias("k1"), op4._unsigned(F.xxhash64("text", F.lit(71))).alias("k2"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s"))
    order = [r["s"] for r in keyed.groupBy("k1", "k2").agg(F.sum("s").alias("s")).orderBy("k1", "k2").collect()]
    most = max(sum(r["size"] for r in got if r["shard"] == s) for s in range(16))
    assert most == smallest_capacity(order, 16)


@pytest.mark.parametrize("heavy", [(), (20_000,), (9_000, 14_000, 8_000)])
def test_shards_are_near_equal_beside_heavy_texts(spark, heavy):
    """Heavy groups, wherever their keys lie, have a shard each; the others are within a tenth of each other."""
    texts = F.concat(F.repeat(F.lit("ordinary "), (F.col("id") % 11 + 3).cast("int")), F.col("id").cast("string"))
    at = 0
    for k, n in enumerate(heavy):
        texts = F.when((F.col("id") >= at) & (F.col("id") < at + n), F.lit(f"copy {k} of a text " * 5)).otherwise(texts)
        at += n
    got = op4.shard_by_bytes(spark.range(50_000).select(F.col("id").alias("doc_id"), texts.alias("text"))).groupBy("shard").agg(F.sum("size").alias("s"), F.countDistinct("text_crc32").alias("n")).collect()
    alone = [r["shard"] for r in got if r["n"] == 1]
    others = [r["s"] for r in got if r["n"] > 1]
    assert sorted(alone) == list(range(16 - len(heavy), 16)) and len(others) == 16 - len(heavy) and min(others) > 0.9 * max(others)


def test_shards_of_nothing(spark):
    assert op4.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("dim,chunk,few,bits", [(64, 4096, 50_000, 64), (64, 5, 0, 5), (20, 7, 50_000, 64), (3, 4096, 0, 64), (1, 4096, 50_000, 64)])
def test_vectors(spark, monkeypatch, dim, chunk, few, bits):
    monkeypatch.setattr(op5, "CHUNK", chunk)
    monkeypatch.setattr(op5, "FEW_CELLS", few)
    monkeypatch.setattr(op5, "NAME_BITS", bits)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(25, dim))
    x = [(centres[i % 25] + rng.normal(size=dim) * rng.choice([0.02, 0.12, 0.2])).astype("f4").tolist() for i in range(150)]
    rows = [(i, v, int(i % 25 % 3)) for i, v in enumerate(x)]
    rows += [(200, x[3], 0), (201, x[3], 0), (202, x[3], 1), (203, None, 0), (204, [0.0] * dim, 0), (205, [float("nan")] * dim, 0), (206, [None] * dim, 0), (207, x[3], None), (208, [], 0), (209, [float("inf")] * dim, 0), (None, x[3], 0), (210, [v * 1e30 for v in x[3]], 0), (201, x[3], 0)]
    got = op5.similar_vectors(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")).collect()

    def fit(r):
        return r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    def cosine(a, b):
        a, b = np.array(a, "f4").astype(float), np.array(b, "f4").astype(float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)

    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if fit(rows[i]) and fit(rows[j]) and rows[i][2] == rows[j][2] and cosine(rows[i][1], rows[j][1]) >= 0.98]
    root = classes(len(rows), links)
    first = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    want = sorted((str(r[0]), sum(i in p for p in links), str(first[root[i]] if fit(r) else r[0])) for i, r in enumerate(rows))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def close_pairs(x: np.ndarray, y: np.ndarray, share: float) -> set[tuple[int, int]]:
    return set(zip(*np.nonzero(((x[:, None] - y[None]) ** 2).sum(2) <= share), strict=True))


@pytest.mark.parametrize("kind", ["normal", "clusters", "same", "line", "two places"])
def test_range_join_of_a_block(kind):
    """All pairs within the share, each once, whatever the points look like."""
    rng = np.random.default_rng(3)
    x = {
        "normal": rng.normal(size=(900, 8)) / 8,
        "clusters": np.repeat(rng.normal(size=(9, 8)) / 8, 100, axis=0) + rng.normal(size=(900, 8)) / 200,
        "same": np.ones((700, 8)) / 8,
        "line": np.outer(np.linspace(-1, 1, 900), np.eye(8)[2]),
        "two places": np.eye(8)[[0, 1] * 400] / 10,
    }[kind]
    for a, b in ((x, None), (x[:500], x[500:]), (x[:1], x[1:])):
        got = [(p, q) for i, j in op5.near_pairs(a, b, 0.005) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        want = close_pairs(a, a if b is None else b, 0.005)
        pairs = {(min(t), max(t)) for t in want if t[0] != t[1]} if b is None else want
        assert len(got) == len(pairs) and {(min(t), max(t)) for t in got} == pairs if b is None else sorted(got) == sorted(pairs)


@pytest.mark.parametrize("level", [1, 3, 8, 11, 30])
@pytest.mark.parametrize("share", [0.005, 0.08])
def test_close_vectors_meet_once_in_the_cells(level, share):
    """Of two rows within the share, both have one home, or exactly one is a guest of the other's home."""
    r = op5.unit(np.random.default_rng(level).normal(size=(600, 64)))[:, :8]
    r[:50] = r[50:100] + np.random.default_rng(1).normal(size=(50, 8)) / 100
    rows, cells, guest = op5.places(r, 64, share, level)
    home = dict(zip(rows[~guest].tolist(), cells[~guest].tolist(), strict=True))
    assert sorted(home) == list(range(600)) and len(home) == (~guest).sum()
    visits = set(zip(rows[guest].tolist(), cells[guest].tolist(), strict=True))
    assert len(visits) == guest.sum()
    for i, j in close_pairs(r, r, share):
        if i < j:
            assert (home[i] == home[j]) + ((i, home[j]) in visits) + ((j, home[i]) in visits) == 1


def test_few_random_vectors_are_compared(monkeypatch):
    """Of random vectors nearly no pair is verified, and the more there are, the smaller is the part compared in a block."""
    compared = []
    plain = op5.within
    monkeypatch.setattr(op5, "within", lambda x, y, share: compared.append(len(x) * len(y)) or plain(x, y, share))
    part = {}
    for n in (4_000, 24_000):
        u = op5.unit(np.random.default_rng(n).normal(size=(n, 64)))
        compared.clear()
        verified = sum(len(p) for k, (a, b) in enumerate(op5.blocks_of(64)) for p, _ in op5.near_pairs(u[:, a:b], None, op5.shares(64, 0.98)[k]))
        assert verified < 0.0001 * n * n / 2
        part[n] = sum(compared) / len(op5.blocks_of(64)) / (n * n / 2)
    assert part[24_000] < 0.06 and part[24_000] < part[4_000] / 2


@pytest.mark.parametrize("chunk,guests", [(32, 1), (300, 4)])
def test_vectors_in_cells_and_chunks(spark, monkeypatch, chunk, guests):
    """Labels that are cut into cells, some crowded, have the links of brute force."""
    monkeypatch.setattr(op5, "CHUNK", chunk)
    monkeypatch.setattr(op5, "GUESTS", guests)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 64)), np.repeat(rng.normal(size=(60, 64)), 5, axis=0) + rng.normal(size=(300, 64)) * 0.14]).astype("f4")
    label = np.where(rng.random(len(x)) < 0.9, 1, 2)
    got = op5.similar_vectors(spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")).collect()
    u = op5.unit(x.astype(float))
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    root = classes(len(x), list(zip(*np.nonzero(near), strict=True)))
    first = {k: min(i for i in range(len(x)) if root[i] == k) for k in set(root)}
    assert near.sum() > 100
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, int(near[i].sum()), first[root[i]]) for i in range(len(x))]


def test_no_vectors(spark):
    assert op5.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---------------------------------------------------------------- 9


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def ngram_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, common = [], " ".join(words[:12])
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 80, 200]))]
        for _ in range(rng.choice([1, 4, 60])):
            new = list(base)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append(" ".join(new).capitalize() + (" " + common if f % 2 else ""))
    rows += [None, "", " \n ", "One\ttwo", "one two", "one two three four", "a b c d e", "x " * 30_000, rows[0], rows[0]]
    return list(enumerate(rows))


@pytest.mark.parametrize("small,pivots,blocks,bits", [((0, 64, 1024), (1, 16, 64), 8, 64), ((0, 0, 0, 2), (1, 2), 2, 4), ((0, 2, 7), (2, 7), 1, 64)])
def test_ngram_classes(spark, monkeypatch, small, pivots, blocks, bits):
    """Few pivots, columns split small, other blocks, and names so short that most sets share theirs: the classes are the same."""
    monkeypatch.setattr(op9, "SMALL", small)
    monkeypatch.setattr(op9, "PIVOTS", pivots)
    monkeypatch.setattr(op9, "BLOCKS", blocks)
    monkeypatch.setattr(op9, "NAME_BITS", bits)
    rows = ngram_rows()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = classes(len(rows), links)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_ngrams"], r["component_id"]) for r in op9.similar_classes(docs, 4, 85).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(rows))}


def test_ngram_edges(spark):
    kind = "doc_id long, text string"
    assert op9.similar_classes(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in op9.similar_classes(spark.createDataFrame([(4, None)], kind)).collect()] == [(4, 0, 4)]
    got = op9.similar_classes(spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "z y x w")], kind)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


@pytest.mark.parametrize("percent", [50, 85])
def test_overlaps_accumulate_over_blocks(spark, percent):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for i in range(120):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64)]))
        o = len(np.intersect1d(a, b))
        rows.append((i, len(a), len(b), *[[x.tolist() for x in op9.in_blocks(s)] for s in (a, b)]))
        want.append(o if 100 * o >= percent * (len(a) + len(b) - o) else None)
        assert sorted(sum(rows[-1][3], [])) == sorted(a.view(np.int64).tolist())
    got = spark.createDataFrame(rows, "i int, n_a int, n_b int, blocks_a array<array<long>>, blocks_b array<array<long>>").select("i", op9.accumulated(percent).alias("o")).collect()
    assert any(w is None for w in want) and any(r["o"] == -1 for r in got)
    for r in got:
        if want[r["i"]] is not None:
            assert r["o"] == want[r["i"]]
        else:
            a, b = rows[r["i"]][1:3]
            assert r["o"] == -1 or 100 * r["o"] < percent * (a + b - r["o"])


def test_one_of_each_by_row(spark):
    t, u = "one two three four five six seven", "other words that have nothing to do with it"
    rows = [(1, t, "a"), (2, t, "b"), (2, u, "c"), (2, u, "d"), (None, u, "e"), (None, "alone here it is by its own self", "f"), (None, "alone here it is by its own self", "g"), (3, None, "h"), (3, None, "i"), (None, " \n", "j"), (4, "", "k")]
    docs = spark.createDataFrame([(*r, "x", 0, 0, "y") for r in rows], "doc_id long, text string, tag string, node string, h1 int, at int, wordless string")
    got = op9.one_of_each(docs)
    assert got.columns == docs.columns
    tags = sorted(r["tag"] for r in got.collect())
    assert len(tags) == 7 and "a" in tags and "b" not in tags and ("c" in tags) != ("d" in tags) and "e" not in tags and ("f" in tags) != ("g" in tags) and set("hijk") <= set(tags)
    assert op9.one_of_each(docs.limit(0)).count() == 0


def test_scratch_is_deleted(spark):
    import os

    home = spark.conf.get("spark.checkpoint.dir")
    docs = spark.createDataFrame(ngram_rows(), "doc_id long, text string")

    def mine():
        return {f for f in os.listdir(home.removeprefix("file://")) if f.startswith("axonlake")}

    was = mine()
    op9.similar_classes(docs).count()
    op5.similar_vectors(spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [1.0, 2.1], 3)], "vec_id long, embedding array<float>, label int")).count()
    op4.shard_by_bytes(docs).count()
    assert mine() == was and not [t.name for t in spark.catalog.listTables() if t.name.startswith("axonlake")]


@pytest.mark.parametrize("each", [1 << 20, 20])
def test_components_in_parts(spark, monkeypatch, each):
    from axonlake.llm import common

    monkeypatch.setattr(common, "EDGES_EACH", each)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    want = classes(600, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] and None not in e for x in e}}


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(40) :], rng.integers(0, 2**63, rng.integers(1, 40)).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        for w in (4, 8, 64):
            assert sum((x ^ y).bit_count() if x ^ y >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(op9.parity(a, w), op9.parity(b, w), strict=True)) <= d


# ---------------------------------------------------------------- 10


def prose(seed, size):
    """Words by Zipf's law, so that some q-grams stand a thousand times in a megabyte."""
    rng, names = np.random.default_rng(seed), random.Random(0)
    words = ["".join(names.choices("etaoinshrdlu", k=names.randrange(2, 9))) for _ in range(5000)]
    weights = 1 / (np.arange(5000) + 2.7)
    return " ".join(words[k] for k in rng.choice(5000, size // 5, p=weights / weights.sum()))[:size]


def test_much_prose_as_a_benchmark():
    """A megabyte against a megabyte: common q-grams aren't paired with all their places, and copies with edits are found."""
    import time

    bench, docs = prose(1, 1_000_000), prose(2, 1_000_000)
    items = [(k, bench[2000 * k : 2000 * k + 2000]) for k in range(450)]
    seg = op10.build(items)
    texts = [docs[10_000 * k : 10_000 * k + 10_000] for k in range(90)]
    texts[7] = texts[7][:3000] + items[5][1][:700].replace("e", "o", 5) + texts[7][3000:]
    spread, most = op10._spread, []
    op10._spread = lambda *a: (most.append(len((out := spread(*a))[0])), out)[1]
    try:
        at = time.perf_counter()
        rows = op10._group(seg, [(k, op10.fold(t)) for k, t in enumerate(texts)], list(range(90)), texts)
        took = time.perf_counter() - at
    finally:
        op10._spread = spread
    assert (7, 5) in {(r[0], r[1]) for r in rows} and took < 90
    assert max(most) <= op10.SPREAD + 100_000


def test_rare_places_change_nothing(monkeypatch):
    """With and without leaving common places out, and in slices of any size, the same is found."""
    rng = random.Random(3)
    words = ["of", "the", "in", "a", "sun", "moon", "river", "stone", "cloud", "tree"]
    items = [(k, " ".join(rng.choices(words, weights=[9, 9, 6, 6, 1, 1, 1, 1, 1, 1], k=rng.randrange(4, 60)))) for k in range(25)]
    texts = []
    for _ in range(25):
        t = rng.choice(items)[1]
        cut = rng.randrange(len(t))
        texts.append(" ".join(rng.choices(words, k=20)) + " " + t[:cut] + rng.choice(["", "x", " of the "]) + t[cut:] + " " + " ".join(rng.choices(words, k=20)))
    plain = None
    for drop, size in ((lambda b: b * 0, 1 << 20), (op10._dropped, 1 << 20), (op10._dropped, 7), (lambda b: b - 1, 100)):
        monkeypatch.setattr(op10, "_dropped", drop)
        monkeypatch.setattr(op10, "SPREAD", size)
        seg = op10.build(items)
        got = [op10.match_folded(op10.fold(t), seg) for t in texts]
        plain = plain or got
        assert got == plain and any(got)



def best_distance(want, region):
    prev = [0] * (len(region) + 1)
    for i, c in enumerate(want, 1):
        cur = [i]
        for j, e in enumerate(region, 1):
            cur.append(min(prev[j - 1] + (c != e), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_banded_distance_is_exact_within_its_budget():
    rng = random.Random(10)
    for _ in range(80):
        want = bytes(rng.choice(b"abcd") for _ in range(40))
        f = bytearray(want)
        for _ in range(rng.randrange(7)):
            p = rng.randrange(len(f))
            f[p : p + rng.randrange(2)] = bytes([rng.choice(b"xyz")] * rng.randrange(2))
        region = b"q" * rng.randrange(4) + bytes(f) + b"r" * rng.randrange(4)
        got, true = op10.banded_distance(want, region, 4), best_distance(want, region)
        assert (got[0] if got else None) == (true if true <= 4 else None)


def test_leaks(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(500)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    items = [(i, text(rng.randrange(8, 60))) for i in range(30)] + [(100, None), (101, ""), (102, "too short"), (3, None)]
    docs, want = [], set()
    for i in range(120):
        t, k = text(rng.randrange(5, 300)), i % 4
        item = items[i % 30]
        if k == 0:
            t, want = f"{t}\n{item[1]}. {text(20)}", want | {(i, item[0])}
        elif k == 1:  # other case, marks and blanks
            t, want = f"{t} {item[1].upper().replace(' ', ',  ')} {text(9)}", want | {(i, item[0])}
        elif k == 2:  # a few typing errors
            x = list(item[1])
            for _ in range(max(1, len(x) // 60)):
                x[rng.randrange(len(x))] = "q"
            t, want = f"{text(30)} {''.join(x)} {t}", want | {(i, item[0])}
        docs.append((i, t))
    docs += [(500, None), (501, ""), (None, "nothing"), (502, "x" * 200_000), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = op10.find_leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) + 1
    for r in got:
        stretch = dict(docs)[r["doc_id"]][r["start"] : r["end"]]
        assert best_distance(op10.fold(dict(items[:30])[r["item_id"]])[:60], op10.fold(stretch)) <= 12
    kept = op10.without_leaks(d, b)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {a for a, _ in want})
    assert op10.find_leaks(d, b.limit(0)).count() == 0 and op10.find_leaks(d.limit(0), b).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_leaks_by_trial_of_all_pairs(spark, monkeypatch, block):
    """Every document with every item: a segment within its edits anywhere, an excerpt as it is, or a short item between blanks."""
    monkeypatch.setattr(op10, "BLOCK_BYTES", block)
    monkeypatch.setattr(op10, "PASS_BYTES", 5 * block)
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(60)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    items = [(i, text(rng.choice([1, 2, 4, 6, 12, 25, 60]))) for i in range(24)]
    docs = []
    for i in range(50):
        x = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "z", "y"])
        a = rng.randrange(len(x) + 1) if i % 5 == 0 else 0
        docs.append((i, f"{text(rng.randrange(12))} {''.join(x)[a:]} {text(rng.randrange(12))}"))
    want = set()
    for i, t in docs:
        folded = op10.fold(t)
        for j, item in items:
            f = op10.fold(item)
            if len(f) < op10.Q or (f.count(b" ") < 4 and len(f) < 24):
                hit = f" {f.decode()} " in f" {folded.decode()} "
            else:
                hit = any(e in folded for e in op10.cut_excerpts(f))
                hit = hit or any(best_distance(g, folded) <= min(int(op10.EDIT_RATE * len(g)), max(0, (len(g) - op10.Q) // op10.Q)) for g in op10.cut_segments(f))
            want |= {(i, j)} if hit else set()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op10.find_leaks(d, b).collect()}
    assert got == want and len(want) > 40
    assert {r["doc_id"] for r in op10.without_leaks(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_short_items_and_scripts_without_blanks(spark):
    zh = "什么是光合作用以及植物如何利用阳光把二氧化碳和水转化为葡萄糖和氧气请简要说明其过程并举出两个影响它的因素谢谢"
    th = "พืชใช้แสงแดดเพื่อเปลี่ยนคาร์บอนไดออกไซด์อย่างไร"
    items = [(1, zh), (2, th), (3, "Photosynthesis transforms sunlight efficiently"), (4, "Who wrote Ulysses?"), (5, "too bad"), (6, "光合作用"), (7, "42"), (8, "葡萄"), (9, "?!"), (10, "Naïve"), (11, "two words"), (11, "x9"), (12, "a b c d e")]
    docs = [
        (1, f"前文。{zh}后文", {1, 6, 8}),
        (2, f"ก{th}ข", {2}),
        (3, "So PHOTOSYNTHESIS transforms, sunlight efficiently indeed", {3}),
        (4, "asked: who wrote ulysses, and when", {4}),
        (5, "prewho wrote ulysses", set()),
        (6, "who wrote ulyssesx then who wrote ulysses", {4}),
        (7, "Too bad!", {5}),
        (8, "too badly stupid 421 142", set()),
        (9, "is it 42 or “naïve”", {7, 10}),
        (10, "两个葡萄干", {8}),
        (11, "two words and x9", {11}),
        (12, "two wordsy x99 a b c d f", set()),
        (13, "xx a b c d e", {12}),
        (14, zh[:30] + "错" + zh[31:], {1, 6, 8}),
        (15, "", set()),
    ]
    d = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = op10.find_leaks(d, b).collect()
    assert {r: {g["item_id"] for g in got if g["doc_id"] == r} for r, _, _ in docs} == {r: w for r, _, w in docs}
    spans = {(g["doc_id"], g["item_id"]): docs[g["doc_id"] - 1][1][g["start"] : g["end"]] for g in got}
    assert len(spans) == len(got) and spans[6, 4] == "who wrote ulysses" and spans[7, 5] == "Too bad" and spans[9, 7] == "42" and spans[11, 11] == "two words and x9"
    assert [r["doc_id"] for r in op10.without_leaks(d, b).orderBy("doc_id").collect()] == [r for r, _, w in docs if not w]
    only = spark.createDataFrame([(7, "42")], "item_id long, text string")
    assert [r["doc_id"] for r in op10.find_leaks(d, only).collect()] == [9]
    seg = op10.build(items)
    assert all(set(op10.match_folded(op10.fold(t), seg)) == w for _, t, w in docs)


def test_excerpts_of_long_items():
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(500)]
    item = " ".join(rng.choices(words, k=60))
    other = " ".join(rng.choices(words, k=40))
    seg, n = op10.build([(1, item)]), op10.EXCERPT + op10.STRIDE - 1
    for s in range(len(item) - n + 1):
        assert set(op10.match_folded(f"{other} {item[s : s + n]} {other}".encode(), seg)) == {1}
    assert not op10.match_folded(other.encode(), seg) and not op10.match_folded(f"{other} {item[:40]} {other}".encode(), seg)


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(7001, None, None, "s", 0), (7002, "123 456", "en", "s", 7)], docs.schema)
    now = docs.unionByName(extra)
    clash = ("row", "lang_pred", "score", "wordless", "h1", "p", "tokens", "copy", "k1", "size x")
    empty = now.limit(0).withColumns({c: F.lit(c) for c in clash})
    few = now.limit(40).withColumns({c: F.lit(c) for c in clash})
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        some = stage(spark, few, SF)
        assert some.columns == few.columns and all(r[c] == c for r in some.collect() for c in clash), name
    assert cp.shard(spark, empty, SF).count() == 0 and cp.shard(spark, few, SF).count() == 40
    out = cp.language_id(spark, now, SF)
    assert out.columns == docs.columns and sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    ids = [(r["doc_id"], r["text"]) for r in out.collect()]
    out2 = cp.near_duplicates(spark, out, SF)
    sets = [shingles(t) for _, t in ids]
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = classes(len(ids), links)
    best = {k: min(ids[i][0] for i in range(len(ids)) if root[i] == k) for k in set(root)}
    assert out2.columns == docs.columns and sorted(r["doc_id"] for r in out2.collect()) == sorted(best.values())
    out3 = cp.decontaminate(spark, out2, SF)
    items = [op10.fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(r["doc_id"] for r in out2.collect() if not any(i in op10.fold(r["text"]) for i in items))
    assert sorted(r["doc_id"] for r in out3.collect()) == clean
    final = cp.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(final.columns) and set(r[0] for r in final.select("doc_id").collect()) <= set(clean)


def test_near_duplicates_of_five_words_and_four_fifths(spark):
    import corpus_pipeline as cp

    rng = random.Random(12)
    rows = []
    for k, grown in enumerate((16, 18, 20, 22, 24, 27, 30)):  # words appended to 100: similarity 0.86 to 0.76
        base = [f"v{rng.randrange(9999)}" for _ in range(100)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + [f"u{rng.randrange(9999)}" for _ in range(grown)]))]
    for k, every in enumerate((44, 47, 52)):  # one word changed in so many
        base = [f"v{rng.randrange(9999)}" for _ in range(every * 8)]
        rows += [(100 + 10 * k, " ".join(base)), (101 + 10 * k, " ".join("changed" + str(i) if i % every == every // 2 else w for i, w in enumerate(base)))]
    sets = [shingles(t, 5) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = classes(len(rows), links)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert 5 < len(links) < 10 and sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, SF).collect()) == sorted({rows[r][0] for r in root})
