"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded to lower-case words joined by one space. Each benchmark item gives segments of at most
SEGMENT bytes, overlapping by half. A segment of length L within k edits of a stretch of a document shares
at least L - q + 1 - k q of its q-grams with it, on diagonals that differ by k at most. So shared q-grams are
counted by segment and diagonal band (bands overlap by half their width, so that one holds all of a stretch's
diagonals), first those of a segment's rarer places, of which half the bound must be shared too, then for the segments that these leave, all; bands that reach the bound are retained and verified by an edit distance restricted to the band.
Short items are looked for as they are, between word boundaries; those of less than a q-gram by windows of their length. Verbatim excerpts of long items are
found by their first q-gram and compared at once.

A q-gram is 8 bytes, so it is one machine word: documents are looked up in a bitmap of the benchmark's q-grams,
and the few that pass in the sorted table. The benchmark goes to the workers in blocks of BLOCK_BYTES, broadcast one by one and kept on
disk there; a worker holds one block's tables at a time and runs it against the documents that it has read, so their text is read once.
A benchmark of more than PASS_BYTES takes a further reading of the documents for each such part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

Q = 8
SEGMENT = 128
#: Edits allowed for each byte of a segment.
EDIT_RATE = 0.08
#: Excerpts of items over SEGMENT bytes are told by so many bytes as they are, from every STRIDE-th byte of the item on.
EXCERPT, STRIDE = 8 * Q, 16
#: Bytes of benchmark text in a block, whose tables take some 50 times as much, and in all blocks of a reading of the documents.
BLOCK_BYTES, PASS_BYTES = 1 << 20, 256 << 20
#: Items with fewer words and fewer characters than these are found only as they are, between word boundaries.
LEAST_WORDS, LEAST_CHARS = 5, 24
MAP_BITS = 22
#: Pairs of a position and a place of its q-gram that are looked at at once.
SPREAD = 1 << 20
#: Documents are looked up in batches of about so many bytes; with several blocks, so many bytes wait for a block's tables.
BATCH_BYTES, WAITING_BYTES = 1 << 20, 32 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split())


@dataclass
class Segments:
    items: list[int]  # item of each segment
    texts: list[bytes]
    edits: list[int]
    grams: np.ndarray  # sorted distinct q-grams
    starts: np.ndarray  # of each gram's occurrences
    firsts: np.ndarray  # of each segment's q-grams in
    gram_of: np.ndarray  # the q-gram of each place of each segment
    rare: tuple[np.ndarray, np.ndarray]  # as starts and owner, without the most common places of each segment
    bitmap: np.ndarray
    bound: np.ndarray  # least shared q-grams of each segment
    whole: list[bool]  # segments that are found only as they are, between word boundaries
    excerpts: tuple[np.ndarray, np.ndarray, list[int]]  # starts by first q-gram, the q-grams end to end of each, item of each
    tiny: dict[int, tuple[np.ndarray, list[list[int]]]]  # by length under Q: sorted texts as words, items of each


def _dropped(bound: np.ndarray) -> np.ndarray:
    """Most common places of a segment that are left out at first: a stretch that shares `bound` places shares the other half of them without any of these."""
    return bound // 2


def _rare(owner: np.ndarray, starts: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences, by q-gram, that aren't among the drop[segment] most common ones of their segment."""
    common = np.repeat(np.diff(starts), np.diff(starts))
    order = np.lexsort((-common, owner))
    first = np.searchsorted(owner[order], np.arange(len(drop)))
    keep = np.zeros(len(owner), bool)
    keep[order] = np.arange(len(owner)) - first[owner[order]] >= drop[owner[order]]
    return np.concatenate(([0], np.cumsum(keep)))[starts], owner[keep]


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MIX) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _windows(data: bytes) -> np.ndarray:
    """The q-gram that starts at each byte."""
    n = len(data) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for o in range(min(Q, max(n, 0))):
        out[o::Q] = np.frombuffer(data, "<u8", count=(len(data) - o) // Q, offset=o)
    return out


def cut_segments(text: bytes) -> list[bytes]:
    if len(text) <= SEGMENT:
        return [text]
    starts = list(range(0, len(text) - SEGMENT, SEGMENT // 2)) + [len(text) - SEGMENT]
    return [text[s : s + SEGMENT] for s in starts]


def cut_excerpts(text: bytes) -> list[bytes]:
    if len(text) <= SEGMENT:
        return []
    starts = list(range(0, len(text) - EXCERPT, STRIDE)) + [len(text) - EXCERPT]
    return [text[s : s + EXCERPT] for s in starts]


def build(items: list[tuple[int, str | None]]) -> Segments:
    """Null items, and items without words, give no segments."""
    owner_items, texts, edits, whole, parts = [], [], [], [], []
    short: dict[int, dict[int, list[int]]] = {}
    for item, text in items:
        folded = fold(text) if text else b""
        if 0 < len(folded) < Q:
            short.setdefault(len(folded), {}).setdefault(int.from_bytes(folded, "little"), []).append(item)
        if len(folded) < Q:
            continue
        exact = folded.count(b" ") + 1 < LEAST_WORDS and len(folded.decode()) < LEAST_CHARS
        for s in cut_segments(folded):
            owner_items.append(item)
            texts.append(s)
            edits.append(0 if exact else min(int(EDIT_RATE * len(s)), max(0, (len(s) - Q) // Q)))
            whole.append(exact)
        parts += [(item, s) for s in cut_excerpts(folded)]
    tiny = {n: (np.array(sorted(found), np.uint64), [found[k] for k in sorted(found)]) for n, found in short.items()}
    grams = [_windows(t) for t in texts]
    every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    order = np.argsort(every, kind="stable")
    distinct, starts = np.unique(every[order], return_index=True)
    bitmap = np.zeros(1 << MAP_BITS, bool)
    bitmap[_slots(distinct)] = True
    bound = np.array([max(1, len(t) - Q + 1 - k * Q) for t, k in zip(texts, edits, strict=True)], np.int64)
    firsts = np.searchsorted(distinct, np.array([np.frombuffer(s, "<u8", 1)[0] for _, s in parts], np.uint64))
    by = np.argsort(firsts, kind="stable")
    ends_on = np.array([np.frombuffer(parts[j][1], "<u8") for j in by], np.uint64).reshape(-1, EXCERPT // Q)
    excerpts = np.searchsorted(firsts[by], np.arange(len(distinct) + 1)), ends_on, [parts[j][0] for j in by]
    starts = np.append(starts, len(every))
    firsts_of, gram_of = np.cumsum([0, *map(len, grams)]), np.searchsorted(distinct, every)
    return Segments(owner_items, texts, edits, distinct, starts, firsts_of, gram_of, _rare(owner[order], starts, _dropped(bound)), bitmap, bound, whole, excerpts, tiny)


#: Characters that stand beside a word without being of it: marks, and letters of scripts without blanks.
_FREE = re.compile("[\0\x20\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u0e00-\u109f\u1780-\u17ff\u2000-\u206f\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")


def boundaries(text: bytes) -> np.ndarray:
    """For each byte of folded text, and its end: whether a word, or a character of a script without blanks, may start or end there."""
    s = text.decode()
    c = np.frombuffer(s.encode("utf-32-le"), "<u4")
    starts = np.concatenate(([0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
    free = np.zeros(len(c) + 2, bool)
    free[[0, -1]] = True
    free[[m.start() + 1 for m in _FREE.finditer(s)]] = True
    out = np.zeros(len(text) + 1, bool)
    out[starts[free[:-1] | free[1:]]] = True
    return out


def banded_distance(segment: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of region nearest to segment, if within k edits; free ends in region.

    The alignment stays within len(region) - len(segment) + k of the main diagonal; each row of the table is
    one numpy step, with insertions resolved by a running minimum.
    """
    m, n = len(segment), len(region)
    r = np.frombuffer(region, np.uint8)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    origin = ramp.copy()
    width = n - m + k
    for i in range(1, m + 1):
        lo, hi = max(0, i - k), min(n, i + width)
        cost = (r != segment[i - 1]).astype(np.int64)
        diag, up = row[:-1] + cost, row[1:] + 1
        take = diag <= up
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.where(take, diag, up)
        src = np.empty(n + 1, np.int64)
        src[0] = 0
        src[1:] = np.where(take, origin[:-1], origin[1:])
        new[:lo] = k + 1 + m
        new[hi + 1 :] = k + 1 + m
        run = np.minimum.accumulate(new - ramp)
        best = run + ramp  # insertions from the left
        at = np.maximum.accumulate(np.where(new - ramp == run, ramp, 0))
        row, origin = np.minimum(best, k + 1 + m), src[at]
        if row.min() > k:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(origin[end]), end) if row[end] <= k else None


def _regions(seg: Segments, s: int, pos: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches whose diagonal band reaches the bound of the q-gram lemma."""
    k, length = seg.edits[s], len(seg.texts[s])
    bound, width = int(seg.bound[s]), 2 * (k + 1)
    diagonal = pos - offset
    found = set()
    for shift in (0, k + 1):
        band = (diagonal + shift) // width
        for b, count in zip(*np.unique(band, return_counts=True), strict=True):
            if count >= bound:
                found.add(int(b) * width - shift)
    spans: list[list[int]] = []
    for d in sorted(found):
        lo, hi = max(0, d - k), d + width + length + k
        if spans and lo <= spans[-1][0] + width:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    yield from map(tuple, spans)


def match_folded(text: bytes, seg: Segments, windows: np.ndarray | None = None) -> dict[int, tuple[int, int, int, int]]:
    """item: (fewest edits of a segment, segments found, first start, last end) in bytes of the folded text."""
    grams = _windows(text + b"\0" * (Q - 1)) if windows is None else windows
    hits = _hits(grams, seg)
    out: dict[int, tuple[int, int, int, int]] = {}
    for _, shared in _shared(*hits, np.zeros(len(hits[0]), np.int64), seg):
        out = _verify(text, seg, shared)
    _add_excerpts(out, [e[1:] for e in _excerpts(*hits, grams, seg, np.array([0]))])
    for _, item, a, b in _tiny(text, grams, seg, np.array([0])):
        _add(out, item, 0, a, b)
    return out


def _add(out: dict[int, tuple[int, int, int, int]], item: int, edits: int, a: int, b: int) -> None:
    was = out.get(item, (edits, 0, a, b))
    out[item] = (min(edits, was[0]), was[1] + 1, min(a, was[2]), max(b, was[3]))


def _tiny(text: bytes, grams: np.ndarray, seg: Segments, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, start, end) of items shorter than a q-gram, from first to last place; grams has a window for each byte of text."""
    edge = boundaries(text) if seg.tiny else None
    for n, (keys, items) in seg.tiny.items():
        w = grams & np.uint64((1 << 8 * n) - 1)
        k = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
        pos = np.flatnonzero(keys[k] == w)
        pos = pos[edge[pos] & edge[pos + n]]
        which = np.searchsorted(starts, pos, side="right") - 1
        group = which * len(keys) + k[pos]
        order = np.argsort(group, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else ():
            g, first, last = int(which[at[0]]), int(pos[at[0]]), int(pos[at[-1]])
            for item in items[int(k[first])]:
                yield g, item, first - int(starts[g]), last + n - int(starts[g])


def _hits(grams: np.ndarray, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Positions that hold a q-gram of an item, and which."""
    pos = np.flatnonzero(seg.bitmap[_slots(grams)]) if len(seg.grams) else np.empty(0, np.int64)
    if not len(pos):
        return pos, pos
    i = np.minimum(np.searchsorted(seg.grams, grams[pos]), len(seg.grams) - 1)
    real = seg.grams[i] == grams[pos]
    return pos[real], i[real]


def _spread(pos: np.ndarray, i: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position with each occurrence of its q-gram."""
    n = starts[i + 1] - starts[i]
    return np.repeat(pos, n), np.repeat(starts[i] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Slices whose numbers add up to SPREAD at most, or hold a single one."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPREAD, side="right")))
        yield slice(at, to)
        at = to


def _likely(i: np.ndarray, which: np.ndarray, seg: Segments) -> list[tuple[int, int]]:
    """(document, segment) pairs in which enough of the segment's rarer places hold a q-gram of the document.

    A document's q-grams count once, and are spread over their places SPREAD pairs at a time.
    """
    starts, owner = seg.rare
    which, i = np.divmod(np.unique(which * len(seg.grams) + i), len(seg.grams))
    pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in _slices(starts[i + 1] - starts[i]):
        w, occ = _spread(which[part], i[part], starts)
        key, count = np.unique(w * len(seg.texts) + owner[occ], return_counts=True)
        pairs, back = np.unique(np.concatenate([pairs, key]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, count]), len(pairs)).astype(np.int64)
    g, s = pairs // max(1, len(seg.texts)), pairs % max(1, len(seg.texts))
    enough = counts >= (seg.bound - _dropped(seg.bound))[s]
    return list(zip(g[enough].tolist(), s[enough].tolist(), strict=True))


def _shared(pos: np.ndarray, i: np.ndarray, which: np.ndarray, seg: Segments) -> Iterator[tuple[int, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
    """(document, its segments), each of these (segment, positions, places in the segment) of the q-grams that both share, where they reach the segment's bound.

    Rare places choose the pairs; only these are counted in full, one after another, so a common q-gram isn't paired with all its places.
    """
    if not len(pos):
        return
    order = np.lexsort((pos, i, which))
    pos, i, which = pos[order], i[order], which[order]

    def of(g: int, likely: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lo, hi = np.searchsorted(which, [g, g + 1])
        for _, s in likely:
            grams = seg.gram_of[seg.firsts[s] : seg.firsts[s + 1]]
            a = np.searchsorted(i[lo:hi], grams)
            n = np.searchsorted(i[lo:hi], grams, side="right") - a
            if np.count_nonzero(n) >= seg.bound[s]:
                total = int(n.sum())
                yield s, pos[lo + np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)], np.repeat(np.arange(len(grams)), n)

    for g, likely in groupby(_likely(i, which, seg), key=lambda pair: pair[0]):
        yield g, of(g, list(likely))


def _excerpts(pos: np.ndarray, i: np.ndarray, grams: np.ndarray, seg: Segments, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, start, end) of each place that holds an excerpt as it is."""
    first, grams_of, items = seg.excerpts
    if not len(pos) or not items:
        return
    for part in _slices(first[i + 1] - first[i]):
        p, e = _spread(pos[part], i[part], first)
        inside = p + EXCERPT - Q < len(grams)
        p, e = p[inside], e[inside]
        for k in range(1, EXCERPT // Q):
            same = grams[p + k * Q] == grams_of[e, k]
            p, e = p[same], e[same]
        which = np.searchsorted(starts, p, side="right") - 1
        for g, a, k in zip(which.tolist(), (p - starts[which]).tolist(), e.tolist(), strict=True):
            yield g, items[k], a, a + EXCERPT


def _add_excerpts(out: dict[int, tuple[int, int, int, int]], excerpts: list[tuple[int, int, int]]) -> None:
    """Excerpts count only where nothing longer of their item is found."""
    found = set(out)
    for item, a, b in excerpts:
        if item not in found:
            _add(out, item, 0, a, b)


def _verify(text: bytes, seg: Segments, shared: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, int, int, int]]:
    out: dict[int, tuple[int, int, int, int]] = {}
    edge = None
    for s, lo, hi in ((s, lo, hi) for s, pos, offset in shared for lo, hi in _regions(seg, s, pos, offset)):
        want, region = seg.texts[s], text[lo:hi]
        at = region.find(want)
        if seg.whole[s]:
            edge = boundaries(text) if edge is None else edge
            places = []
            while at >= 0:
                if edge[lo + at] and edge[lo + at + len(want)]:
                    places.append(lo + at)
                at = region.find(want, at + 1)
            if places:
                _add(out, seg.items[s], 0, places[0], places[-1] + len(want))
            continue
        got = (0, at, at + len(want)) if at >= 0 else banded_distance(want, region, seg.edits[s])
        if got is not None:
            e, a, b = got
            _add(out, seg.items[s], e, lo + a, lo + b)
    return out


def _code_points(text: str, folded: bytes, start: int, end: int) -> tuple[int, int]:
    """Span in the text of the words that [start, end) of the folded text touches; a word of a script without blanks goes up to the next blank or ASCII mark."""
    first, last = folded.count(b" ", 0, start + 1) if start < len(folded) else 0, folded.count(b" ", 0, max(start, end - 1))
    a = b = 0
    for i, m in enumerate(WORD.finditer(text)):
        if i == first:
            a = m.start()
        if i <= last:
            b = m.end()
        else:
            break
    return a, b


SCHEMA = "doc_id long, item_id long, start int, end int, edits int, n_segments int"


class Blocks:
    """The blocks of one reading, on a worker: the tables of the last one used stay, so those of a single block are built once."""

    def __init__(self, sent: list) -> None:
        self.sent, self.last, self.seg = sent, -1, None

    def __iter__(self) -> Iterator[Segments]:
        for i, block in enumerate(self.sent):
            if i != self.last:
                self.seg = None  # one at a time
                self.seg, self.last = build(block.value), i
            yield self.seg


def _found(blocks: Blocks, ids: list, texts: list) -> list[tuple]:
    """Rows of all blocks for these documents."""
    rows = []
    folded = [(k, fold(t)) for k, t in enumerate(texts) if t]
    for seg in blocks:
        group, size = [], 0
        for i, (k, f) in enumerate(folded):
            group.append((k, f))
            size += len(f)
            if size >= BATCH_BYTES or i + 1 == len(folded):
                rows += _group(seg, group, ids, texts)
                group, size = [], 0
    return rows


def _waiting(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.Table]:
    """Batches as they come, or with several blocks many together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if not several or size >= WAITING_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scan(sent: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(sent)
        for t in _waiting(batches, len(sent) > 1):
            rows = _found(blocks, t.column(0).to_pylist(), t.column(1).to_pylist())
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "n_segments"])

    return run


def _group(seg: Segments, group: list[tuple[int, bytes]], ids: list, texts: list) -> list[tuple]:
    gap = b"\0" * Q  # no q-gram of an item holds this byte
    joined = gap.join(f for _, f in group)
    starts = np.cumsum([0, *(len(f) + Q for _, f in group)])
    grams = _windows(joined + b"\0" * (Q - 1))
    hits = _hits(grams, seg)
    out = []
    near: dict[int, dict[int, tuple[int, int, int, int]]] = {}
    for g, shared in _shared(*hits, np.searchsorted(starts, hits[0], side="right") - 1, seg):
        near[g] = _verify(group[g][1], seg, ((s, pos - starts[g], offset) for s, pos, offset in shared))
    tiny: dict[int, list[tuple[int, int, int]]] = {}
    for g, *hit in _tiny(joined, grams, seg, starts):
        tiny.setdefault(g, []).append(hit)
    excerpts: dict[int, list[tuple[int, int, int]]] = {}
    for g, *hit in _excerpts(*hits, grams, seg, starts):
        excerpts.setdefault(g, []).append(hit)
    for g in sorted({*near, *tiny, *excerpts}):
        k, folded = group[g]
        found = near.get(g, {})
        _add_excerpts(found, excerpts.get(g, []))
        for item, a, b in tiny.get(g, ()):
            _add(found, item, 0, a, b)
        for item, (e, n, a, b) in sorted(found.items()):
            s, t = _code_points(texts[k], folded, a, b)
            out.append((ids[k], item, s, t, e, n))
    return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The broadcast blocks of each reading of the documents. Items are streamed through the driver; one that is larger than a block is one by itself."""
    send = benchmark.sparkSession.sparkContext.broadcast
    sent, block, size = [], [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_BYTES:
            sent.append(send(block))
            block, size = [], 0
            if len(sent) * BLOCK_BYTES >= PASS_BYTES:
                yield sent
                sent = []
    if block:
        sent.append(send(block))
    if sent:
        yield sent


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits, n_segments): one row for each document and item found in it.

    start and end are code points of the stretch from the first to the last segment found; edits are those of
    the best segment. Null or empty texts and items find nothing; items of fewer than LEAST_WORDS words and LEAST_CHARS
    characters are found only as they are, between word boundaries, so one of a common word is found wherever that stands; whole texts are read; repeated documents give a row each, repeated items one; empty tables give no rows; other
    columns are ignored. Rows with a null doc_id are looked at too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for sent in _passes(benchmark, item_col, item_text):
        found = mapped(docs, _scan(sent), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs in which find_leaks() finds nothing, with all their columns: a filter in one reading, without a join.

    Rows of null or empty text stay; repeated rows stay or go alike; an empty table gives none; other columns, whatever their names, stay.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    for sent in _passes(benchmark, "item_id", "text"):
        docs = mapped(docs, _drop_hits(sent, at), docs.schema)
    return docs.select(*[F.col(f"`{n}`") for n in names])


def _drop_hits(sent: list, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(sent)
        for t in _waiting(batches, len(sent) > 1):
            hit = {row[0] for row in _found(blocks, range(t.num_rows), t.column(at).to_pylist())}
            yield from t.filter(pa.array([i not in hit for i in range(t.num_rows)], pa.bool_())).to_batches()

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
