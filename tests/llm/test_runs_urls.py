"""Periodic runs and URL filters against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axonlake.llm import op11_runs as op11
from axonlake.llm import op12_urls as op12

# ---------------------------------------------------------------- 11


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute_runs(x):
    """Every stretch, its smallest period, and whether a neighbour extends it."""
    out, n = [], len(x)
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = smallest_period(x[s:e])
            if e - s >= max(6, 4 * q) and not (s and x[s - 1] == x[s - 1 + q]) and not (e < n and x[e] == x[e - q]):
                out.append((s, e - s, q))
    return sorted(out)


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 6)), min_size=1, max_size=4))
def test_runs_of_random_repetitions(parts):
    x = [v for word, times in parts for v in word * times][:44]
    ids = np.array(x, np.int32)
    got = sorted(op11.runs_at(ids, 1, len(x) + 1))
    assert got == brute_runs(x)
    cuts = [1, 2, 3, 5, 9, len(x) + 1]
    assert sorted(r for a, b in zip(cuts, cuts[1:], strict=False) for r in op11.runs_at(ids, a, b)) == got  # ranges of shifts add up


def test_planted_words():
    words = [f"w{i}".encode() for i in range(50)]
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        want = list(words)
        if h % 10 == 0:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        assert op11.planted(doc_id, words) == want
    assert op11.planted(None, words) == words


def texts():
    rnd = random.Random(5)
    out = [None, "", " \t\n ", "one", "a a a a a", "a a a a a a", "a b a b a b a b a", "x\u00a0y " * 4 + "z", "é\x1cü " * 7, "日本 語 " * 5]
    for _ in range(30):
        part = [rnd.choice("abc") for _ in range(rnd.randint(1, 5))]
        out.append(" ".join([rnd.choice("abc") for _ in range(rnd.randint(0, 6))] + part * rnd.randint(1, 7) + [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]))
    return out


@pytest.mark.parametrize("long_bytes", [op11.LONG_BYTES, 20, 0])
def test_query_equals_brute_force(spark, tmp_path, long_bytes, monkeypatch):
    """With every text dealt out by ranges of shifts, too."""
    monkeypatch.setattr(op11, "RANGE_LAGS", 2)
    monkeypatch.setattr(op11, "RANGE_WORK", 1)
    rows = [(i, t) for i, t in enumerate(texts())] + [(4, "a a a a a"), (None, "b b b b b b b"), (None, "b b b b b b b")]
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, key int, runs string, lo int").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"), change=op11.planted, long_bytes=long_bytes)
    got = sorted(((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found.collect()), key=repr)
    want = []
    for doc_id, text in rows:
        words = op11.planted(doc_id, words) if (words := op11.words_of(text)) else []
        runs = brute_runs(words)
        want.append((doc_id, len(words), tuple(runs), brute_collapsed([w.decode() for w in words], runs)))
    assert got == sorted(want, key=repr)
    if long_bytes == op11.LONG_BYTES:
        digest = {(r["doc_id"], r["collapsed_sha256"]): r for r in op11.op11_runs(spark, str(tmp_path)).collect()}
        for doc_id, _, runs, text in want:
            r = digest[doc_id, hashlib.sha256(text.encode()).hexdigest()]
            best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
            assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
            assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
            assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def test_long_texts_and_empty_table(spark):
    long = "plain words go on and on and never end here " * 12_000  # one run of 120,000 words
    rnd = random.Random(1)
    other = " ".join(rnd.choice(("alpha", "beta", "gamma", "delta", "of", "the")) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, other)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op11.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 120_000, 10)] and got[1]["collapsed"] == "plain words go on and on and never end here"
    assert all(n >= max(6, 4 * q) for _, n, q in map(tuple, got[2]["runs"])) and got[2]["n_words"] == 60_000
    assert op11.periodic_runs(df.limit(0)).collect() == []


# ---------------------------------------------------------------- 12


def brute_url(url):
    low = (url or "").translate({c: c + 32 for c in range(65, 91)})
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in op12.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    hit = set()
    for t in op12.VOCABULARY:
        at = low.find(t)
        while at >= 0:
            before, after = low[at - 1 : at] if at else "", low[at + len(t) : at + len(t) + 1]
            if not (before and before in op12._WORD) and not (after and after in op12._WORD):
                hit.add(t)
            at = low.find(t, at + 1)
    weight = sum(op12.VOCABULARY[t] for t in hit)
    return host, path, rule.text if rule else None, rule.verdict if rule else "block" if weight >= 2 else "allow", weight


URLS = [
    None, "", "no scheme", "http://", "HTTP://ORG/", "http://org", "http://a.ORG/es/x", "https://example.org/es/1", "https://m.example.org/en/17?x#y", "http://notexample.org/es/", "http://example.org/esx",
    "http://x.com/fr/", "http://x.com/de/1", "http://x.com?/fr/", "http://x.com#/de/", "ftp://a://b/c", "http://x.net/a-b\n/c", "http://cheap-pills.example.net/en/1", "http://cheapest.example.net/pills",
    "http://porn.example.net/", "http://pornography.example.net/", "http://x.net/sex?spam=1", "http://x.net/essex", "http://freefree.net/free-free/free", "http://x.net/" + "free/" * 20_000, "http://ünïcode.net/ÄÖ/xxxé", "http://example.org.com/fr/",
]


def test_urls_equal_brute_force_and_sql(spark, tmp_path):
    import duckdb

    from axonlake.llm import queries as llm

    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://cheap.net/pills")]
    spark.createDataFrame([(*r, "h", 1, 2) for r in rows], "page_id long, url string, host string, row int, weight int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, op12.op12_urls(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, *brute_url(u)) for i, u in rows), key=repr)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duck.sql(llm.oracle_sql()["op12_urls"]).fetchall(), key=repr) == got


def test_url_parameters_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/x/cat")], "page_id long, url string")
    rules = (op12.Rule("c", "/x/", "allow"), op12.Rule("b.c", "/", "block"))
    (r,) = op12.judged(df, rules, {"cat": 5}, 6).collect()
    assert (r["rule"], r["verdict"], r["terms"], r["weight"]) == ("c/x/", "allow", ["cat"], 5)
    (r,) = op12.judged(df, (), {}).collect()
    assert (r["rule"], r["verdict"], r["terms"]) == (None, "allow", [])
    assert op12.judged(df.limit(0)).collect() == []
