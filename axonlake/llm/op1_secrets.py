"""Secret scan: pattern spans plus dictionary-primed zstandard novelty.

A candidate is a long run of secret-like characters that follows a sensitive word closely. Its novelty is the
number of bytes that it adds to the compressed size of the text around it, before and after, divided by its
length; the compressor is primed with a dictionary of common identifiers and word parts. A name or a
repeated word adds a few bytes, a key adds nearly all of its own. Every candidate is measured, and nothing but its novelty decides.
Pattern hits are measured alike and always reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Words after which a string may be secret, in lower case.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "bearer", "authorization")
_WORDS = {w: re.compile(re.escape(w), re.IGNORECASE | re.ASCII) for w in SENSITIVE}
#: A candidate starts at most so many characters after such a word.
REACH = 48
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Characters before a candidate, and after it, that prime the compressor besides the dictionary.
CONTEXT = 256
#: Least marginal compressed bytes for each character of a candidate.
NOVELTY = 0.75

#: Identifiers and code that the compressor knows beforehand.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id authorization bearer credential "
    "username user_name database connection_string localhost example configuration environment variable parameter argument "
    "function return class import public private static void string boolean integer default null undefined true false "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef xxxxxxxxxxxxxxxx 0000000000000000 "
    'your_api_key_here your-secret-here changeme placeholder = "" : "" \' \' os.environ getenv process.env config.get settings '
    "the of and to in is that for with this from application service account request response header session "
    "characteristically responsibility internationalization communication representation administration implementation transformation "
    "understanding organization experience government particularly individual difference consideration establishment environmental "
    "professional relationship investigation interpretation recommendation unfortunately extraordinary circumstances straightforward "
    "counter-productive self-explanatory well-established time-consuming state-of-the-art hexadecimal certificate fingerprint identifier "
    "/usr/local/share/lib/python/site-packages/include/src/main/resources/ https://www.example.com/index.html ================ ---------------- ________________"
)

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string,marginal:int,novelty:double>>"


class Novelty:
    """Marginal compressed size under the dictionary; one for each Python worker."""

    def __init__(self) -> None:
        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_checksum=False)

    def marginal(self, text: str, start: int, end: int) -> int:
        """Bytes that text[start:end] adds to what stands around it; its own repetition after it doesn't make it known."""
        value = text[start:end]
        around = (text[max(0, start - CONTEXT) : start] + text[end : end + CONTEXT].replace(value, "")).encode("utf-8", "replace")
        return len(self.packer.compress(around + value.encode("utf-8", "replace"))) - len(self.packer.compress(around))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of the pattern hits, ordered."""
    found = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the runs that follow a sensitive word within REACH and start outside of pattern hits, ordered.

    In a run that holds sensitive words itself a candidate may start behind each of them: the first and the last of these starts stand for all,
    as a run of n words would else be measured n times. One scan over the text.
    """
    low = text.lower()  # tells only which words to look for: positions in it may differ from those in the text
    ends = sorted({m.end() for w in SENSITIVE if w in low for m in _WORDS[w].finditer(text)})
    if not ends:
        return []
    starts, found = [s for s, _, _ in base], []
    far = [0]  # the furthest end of the pattern hits up to each
    for _, _, e in base:
        far.append(max(far[-1], e))
    for m in CANDIDATE.finditer(text):
        lo, hi = m.start(), m.end() - LEAST
        k = bisect_right(ends, hi)
        if not k or ends[k - 1] + REACH < lo:
            continue
        first = bisect_left(ends, lo - REACH)
        while first < k and (past := far[bisect_right(starts, at := max(lo, ends[first]))]) > at:
            first = max(first + 1, bisect_left(ends, past))
        if first < k:
            last = max(lo, ends[k - 1])
            found.append((at, m.end()))
            if last > at and far[bisect_right(starts, last)] <= last:
                found.append((last, m.end()))
    return found


def scan_text(text: str, novelty: Novelty) -> list[dict]:
    base = base_spans(text)
    out = []
    for s, k, e in sorted([*base, *((s, 3, e) for s, e in candidates(text, base))]):
        more = novelty.marginal(text, s, e)
        if k < 3 or more >= NOVELTY * (e - s):
            out.append({"kind": KINDS[k], "start": s, "end": e, "value": text[s:e], "marginal": more, "novelty": more / (e - s)})
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: kind, start and end in code points, value, marginal bytes, novelty.

    A null or empty text has no spans; whole texts are read, however long; repeated rows are scanned each; an
    empty table gives no rows; other columns are ignored. Spans are ordered by start, then kind. A candidate
    inside a pattern hit is not reported twice.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("marginal", pa.int32()), ("novelty", pa.float64())]))
        for b in batches:
            spans = [scan_text(t, novelty) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scan, SCHEMA)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
