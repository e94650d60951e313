"""URL filter: host and path rules, and a weighted vocabulary matched by an Aho-Corasick automaton.

Terms are found anywhere in the lower-cased URL where no letter or digit touches them. A strict term weighs LIMIT, a soft one 1; a URL
whose distinct terms weigh LIMIT or more is rejected, that is for one strict or LIMIT soft terms. Where a rule fits the URL, the rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, packed, table

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", ALLOW), Rule("example.org", "/es/", BLOCK), Rule("example.org", "/en/1", BLOCK), Rule("com", "/fr/", ALLOW), Rule("com", "/de/", BLOCK))

#: Distinct soft terms that reject a URL.
LIMIT = 2
STRICT = ("adult", "casino", "cracked", "escort", "hentai", "keygen", "malware", "milf", "phishing", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("bet", "betting", "bonus", "cam", "cheap", "click", "crack", "dating", "deal", "discount", "download", "free", "gamble", "girls", "hot", "jackpot", "live", "loan", "lottery", "nude", "offer", "payday", "pharmacy", "pills", "poker", "prize", "replica", "serial", "slots", "teen", "torrent", "winner")
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, 1)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without one."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, null without one. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # each goes before the shorter ones
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def automaton(vocabulary: dict[str, int]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for term in vocabulary:
        out.add_word(term, term)
    out.make_automaton()
    return out if len(out) else None


def terms_in(found: ahocorasick.Automaton | None, url: str) -> set[str]:
    """Distinct terms that no letter or digit touches; url is lower-cased."""
    if found is None:
        return set()
    return {t for end, t in found.iter(url) if (end + 1 == len(url) or url[end + 1] not in _WORD) and (end < len(t) or url[end - len(t)] not in _WORD)}


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, vocabulary: dict[str, int] | None = None, limit: int = LIMIT, url_col: str = "url") -> DataFrame:
    """(row, host, path, rule, verdict, terms, weight) for every row; row holds the given columns.

    A null url, or one without ://, has an empty host and path; terms are looked for in it all the same, and a null one has none. Repeated rows
    each come back, an empty table gives no rows, no column of the table clashes with ours. rule is its host and path. Of two
    rules of the same text the last one counts.
    """
    known = VOCABULARY if vocabulary is None else vocabulary
    inner = packed(pages, url=F.col(f"`{url_col}`"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton(known)
        for b in batches:
            found = [sorted(terms_in(tree, u)) if u else [] for u in b.column(3).to_pylist()]
            weight = pa.array([sum(known[t] for t in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.string())), weight], ["row", "host", "path", "terms", "weight"])

    parts = inner.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), lowered(F.col("url")).alias("low"))
    kind = inner.schema["row"].dataType.simpleString()
    hits = mapped(parts, look, f"row {kind}, host string, path string, terms array<string>, weight long", rows=4096)
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("weight") >= limit, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(rule_for(host, path, rules, lambda r: r.verdict), own)
    return hits.select("row", "host", "path", rule_for(host, path, rules, lambda r: r.text).alias("rule"), verdict.alias("verdict"), "terms", "weight")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "weight")
