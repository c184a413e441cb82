"""Substring dedup by recompression.

Words get names of two 64-bit lanes. Recompression replaces, level by level, maximal runs of one
symbol by one symbol, then splits the symbols by a hash bit into left and right ones and names
every left-right pair. Names are hashes of what they stand for, so all executors name equal
runs and pairs alike, without a dictionary, and equal substrings get equal interior symbols.

1. Long repeats. Symbols grow until they hold ``LEVEL`` words. Each one with its right neighbour
   is a high-level symbol; a Spark round groups them by name over the corpus (128 bits). One
   whose name a smaller doc_id also has verifies its whole stretch: all windows in it repeat.
2. The rest, which is the edges of long repeats, short repeats, and the first document of each:
   a symbol of the first levels carries its context, the word range that fixes that it appears
   there. A symbol whose context lies inside a window of ``WINDOW`` words appears in every copy
   of that window, so each window takes the best such symbol as its anchor and can repeat in
   another document only if its anchor does. (A window with none anchors itself.) Only windows
   whose anchors two documents share are named (128 bits) and meet by name.

A window that step 1 settles needs no part in step 2: the smaller document still offers it there,
or was itself settled by one smaller yet. Spark steps are linear in the words; shared tables are
written out before they join back, so skewed keys can be split.

Defined results: null text has no words; a null doc_id is smaller than none and larger than
none, so nothing is removed for or by it; rows of one doc_id do not remove from each other, and
repeated rows are judged alike; texts under 13 words stay whole; a text of any length is one
row's arrays (about 100 bytes a word); ties do not arise, as the least doc_id decides; further
columns of any name are ignored; empty tables give empty results. Rows of one doc_id are told
apart by a 64-bit hash of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.arrow import map_batches
from millrace.plans.durable import materialize, release

WINDOW = 13
#: Levels that give anchors.
ROUNDS = 3
#: Words at which a symbol of the long repeats stops to grow, and levels after which all stop.
LEVEL, LEVELS = 24, 48
#: Bytes named at once; bytes from which a word is named by its digest.
SEGMENT, LONG = 1 << 21, 1 << 12
FAR = 1 << 40
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the largest n so far."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _powers


# --- words ----------------------------------------------------------------------------

_GAPS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Keeps the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _segment_names(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, twin) of each word of bytes that begin and end at a gap or an edge.

    Each lane is a chain over the word's eight-byte blocks, one invertible step for each block.
    """
    gap = np.r_[True, _GAPS[np.frombuffer(raw, np.uint8)], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    s, size = edge[::2], edge[1::2] - edge[::2]
    padded = raw + bytes(8)
    blocks = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    one, two = size.astype(np.uint64) * _C, size.astype(np.uint64) * _B + _A
    live, k = np.flatnonzero(size < LONG), 0
    while len(live):
        x = blocks[s[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]
        one[live] = mix((one[live] ^ x) * _A)
        two[live] = mix(two[live] ^ (x * _C))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size >= LONG):
        one[i], two[i] = np.frombuffer(hashlib.blake2b(raw[s[i] : s[i] + size[i]], digest_size=16).digest(), np.uint64)
    return s, one, two


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of the names of all words of the texts, and where each text starts among them."""
    each = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(each)
    parts, at = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and not _GAPS[raw[end]]:
            end += 1
        s, one, two = _segment_names(raw[at:end])
        parts.append((s + at, one, two))
        at = end
    starts, one, two = map(np.concatenate, zip(*parts))
    begin = np.cumsum([0, *(len(r) + 1 for r in each)], dtype=np.int64)
    return one, two, np.searchsorted(starts, begin)


def split_words(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes.split() cuts at exactly the six gap characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


# --- recompression: long repeats ------------------------------------------------------


def high_symbols(one: np.ndarray, two: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, twin, document, first word, words) of each high-level symbol.

    Two neighbours may pair while one of them holds fewer than ``LEVEL`` words. The symbols that
    are left cover each document; each is returned together with its right neighbour.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = np.arange(len(one))
    e = s + 1
    for level in range(LEVELS):
        same = doc[1:] == doc[:-1]
        again = same & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        if again.any():  # runs
            at = np.flatnonzero(np.r_[True, ~again])
            end = np.r_[at[1:], len(one)]
            many, e = end - at > 1, e[end - 1]
            k = (end - at).astype(np.uint64)
            one, two = np.where(many, mix(one[at] + k * _A), one[at]), np.where(many, mix(two[at] ^ k * _C), two[at])
            s, doc = s[at], doc[at]
            same = doc[1:] == doc[:-1]
        small = e - s < LEVEL
        open_ = same & (small[1:] | small[:-1])
        if not open_.any():
            break
        left = (mix(one ^ np.array([level + 1], np.uint64) * _A) & np.uint64(1)).astype(bool)
        f = np.flatnonzero(open_ & left[:-1] & ~left[1:])
        one, two, e = one.copy(), two.copy(), e.copy()
        one[f] = mix(one[f] * _C + one[f + 1] + np.uint64(level))
        two[f] = mix(two[f] * _A + two[f + 1] * _B + np.uint64(level))
        e[f] = e[f + 1]
        keep = np.ones(len(one), bool)
        keep[f + 1] = False
        one, two, s, e, doc = (x[keep] for x in (one, two, s, e, doc))
    if not len(one):
        return one, two, doc, s, s
    nxt = np.r_[doc[1:] == doc[:-1], False]
    j = np.minimum(np.arange(len(one)) + 1, len(one) - 1)
    a = np.where(nxt, mix(one * _A + one[j]), one)
    b = np.where(nxt, mix(two * _C + two[j]), two)
    size = np.where(nxt, e[j], e) - s
    keep = (nxt | np.r_[True, doc[1:] != doc[:-1]]) & (size >= WINDOW)  # a last symbol alone is in the pair before
    return a[keep], b[keep], doc[keep], (s - first[doc])[keep], size[keep]


# --- recompression: anchors -----------------------------------------------------------


class _Symbols:
    """One level of all documents of a batch: name, words [s, e), context [cs, ce), document."""

    def __init__(self, name, s, e, cs, ce, doc):
        self.name, self.s, self.e, self.cs, self.ce, self.doc = name, s, e, cs, ce, doc


def runs(names: np.ndarray, doc: np.ndarray) -> _Symbols:
    """Block compression: maximal runs of one word; a run needs both neighbours as context."""
    edge = doc[1:] != doc[:-1]
    new = np.r_[True, (names[1:] != names[:-1]) | edge]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(names)]
    k = (e - s).astype(np.uint64)
    name = np.where(k > 1, mix(names[s] + k * _A), names[s])
    opens = np.r_[True, edge][s]
    closes = np.r_[edge, True][e - 1]
    return _Symbols(name, s, e, np.where(opens, -FAR, s - 1), np.where(closes, FAR, e + 1), doc[s])


def pairs(x: _Symbols, seed: int) -> tuple[_Symbols, np.ndarray]:
    """One round of pair compression and the mask of the symbols that are new pairs."""
    left = (mix(x.name ^ mix(np.array([seed], np.uint64) * _A)) & np.uint64(1)).astype(bool)
    same = np.r_[x.doc[1:] == x.doc[:-1], False]  # has a next symbol in its document
    before = np.r_[False, same[:-1]]
    nxt = np.minimum(np.arange(len(left)) + 1, len(left) - 1)
    prv = np.maximum(np.arange(len(left)) - 1, 0)
    first = left & same & ~left[nxt]
    second = np.r_[False, first[:-1]]
    other = np.where(left, nxt, prv)
    known = np.where(left, same, before)
    cs = np.where(known, np.minimum(x.cs, x.cs[other]), np.where(left, x.cs, -FAR))
    ce = np.where(known, np.maximum(x.ce, x.ce[other]), np.where(left, FAR, x.ce))
    name = np.where(first, mix(x.name * _C + x.name[nxt] + np.uint64(seed)), x.name)
    e = np.where(first, x.e[nxt], x.e)
    keep = ~second
    return _Symbols(name[keep], x.s[keep], e[keep], cs[keep], ce[keep], x.doc[keep]), first[keep]


def _offer(best: np.ndarray, total: np.ndarray, x: _Symbols, which: np.ndarray) -> None:
    """Offer symbols to every window that holds their whole context; longer symbols win.

    The anchor is named after all words of the context, which the window holds anyway: that
    makes it far rarer than the symbol and as consistent. ``total`` are running sums of names.
    """
    which = which & (x.ce - x.cs <= WINDOW)
    cs, ce, span = x.cs[which], x.ce[which], (x.e - x.s)[which]
    name = mix((total[ce] - total[cs]) * _powers_to(len(total))[1][cs] + (ce - cs).astype(np.uint64) * _C)
    rank = np.minimum(span, 4).astype(np.uint64) << np.uint64(60) | name >> np.uint64(4)
    for back in range(WINDOW):
        p = cs - back
        ok = (p >= 0) & (p >= ce - WINDOW)
        if not ok.any():
            break
        np.maximum.at(best, p[ok], rank[ok])


def window_names(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each window that starts at ``at``: one lane from each lane of its words."""
    h, g = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        h = (h ^ one[at + k]) * _A
        h ^= h >> np.uint64(29)
        g = (g + two[at + k]) * _B
        g ^= g >> np.uint64(32)
    return mix(h), mix(g)


def anchors(names: np.ndarray, first: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, windows) of each run of windows with one anchor.

    ``first`` has the start of each document in ``names`` and, last, their number; ``skip`` marks
    the starts of windows that need none.
    """
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    best = np.zeros(len(names), np.uint64)
    if len(names):
        total = np.r_[np.uint64(0), np.cumsum(names * _powers_to(len(names) + 1)[0][: len(names)])]
        x = runs(names, doc)
        _offer(best, total, x, x.e - x.s > 1)
        _offer(best, total, *pairs(x, ROUNDS + 1))  # a second division, for windows the first gives no pair
        for r in range(ROUNDS):
            x, new = pairs(x, r + 1)
            _offer(best, total, x, new)
    wanted = np.arange(len(names)) + WINDOW <= np.repeat(first[1:], size)
    at = np.flatnonzero(wanted if skip is None else wanted & ~skip)
    a = best[at]
    bare = np.flatnonzero(a == 0)
    if len(bare):
        a[bare] = window_names(names, names, at[bare])[0] >> np.uint64(4)
    new = np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)] if len(a) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    return a[s], doc[at[s]], at[s] - first[doc[at[s]]], np.diff(np.r_[s, len(a)])


# --- on Spark -------------------------------------------------------------------------

RANGES = "array<struct<p:int,n:int>>"


def _named(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_names(batch.column("text").to_pylist())


def _ranges(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, p, n) of a column of ranges; null has none."""
    lists = batch.column(column)
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    p, n = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
    return row, p, n


def _covered(size: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mask of the positions that a range [at, at + n) holds."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0


def _out(batch: pa.RecordBatch, row: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """``columns`` with the doc_id and key of the row that each entry belongs to."""
    keys = {n: batch.column(n).take(pa.array(row)) for n in ("doc_id", "key")}
    return pa.RecordBatch.from_pydict(columns | keys)


def _symbol_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b, doc, p, n = high_symbols(*_named(batch))
    return _out(batch, doc, a=pa.array(a.view(np.int64)), b=pa.array(b.view(np.int64)), p=pa.array(p, pa.int32()), n=pa.array(n, pa.int32()))


def _anchor_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    one, _, first = _named(batch)
    row, p, n = _ranges(batch, "spans")
    a, doc, p, n = anchors(one, first, _covered(len(one), first[row] + p, n - WINDOW + 1) if len(row) else None)
    return _out(batch, doc, anchor=pa.array(a.view(np.int64)), p=pa.array(p, pa.int32()), n=pa.array(n, pa.int32()))


def _window_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    one, two, first = _named(batch)
    row, p, n = _ranges(batch, "ranges")
    each = np.repeat(np.arange(len(row)), n)
    p = p[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    row = row[each]
    h, g = window_names(one, two, first[row] + p)
    return _out(batch, row, h=pa.array(h.view(np.int64)), g=pa.array(g.view(np.int64)), p=pa.array(p, pa.int32()))


def _cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts and digest of the words that no repeated stretch or window holds."""
    n, removed, digest = [], [], []
    columns = (batch.column(x).to_pylist() for x in ("text", "spans", "starts"))
    for text, spans, starts in zip(*columns):
        w = split_words(text)
        kept = w
        if spans or starts:
            gone = [(r["p"], r["n"]) for r in spans or []] + [(p, WINDOW) for p in starts or []]
            at, size = np.array(gone, np.int64).T
            kept = [x for x, cut in zip(w, _covered(len(w), at, size)) if not cut]
        n.append(len(w))
        removed.append(len(w) - len(kept))
        digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    cols = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _least(df: DataFrame, by: list[str]) -> DataFrame:
    """The names of at least two doc_ids and the least of those."""
    return df.groupBy(*by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")


def repeated_spans(known: DataFrame, keep_for: str = "call") -> DataFrame:
    """(doc_id, key, spans): stretches of high-level symbols that a smaller doc_id also has."""
    spark, step = known.sparkSession, f"{keep_for}.spans"
    symbols = map_batches(known, _symbol_batch, "a long, b long, p int, n int, doc_id long, key long")
    symbols = materialize(symbols, "symbols", step)
    least = materialize(_least(symbols, ["a", "b"]), "shared", step)
    hit = symbols.join(least, ["a", "b"]).where("lo < doc_id")
    spans = hit.groupBy("doc_id", "key").agg(F.collect_set(F.struct("p", "n")).alias("spans"))  # bounded by a text
    spans = materialize(spans, "spans", keep_for)
    release(spark, step)
    return spans


def repeated_windows(known: DataFrame, spans: DataFrame, keep_for: str = "call") -> DataFrame:
    """(doc_id, key, starts): windows outside ``spans`` that also start in a smaller doc_id."""
    spark, step, at = known.sparkSession, f"{keep_for}.windows", ["doc_id", "key"]
    found = map_batches(known.join(spans, at, "left").select("text", "spans", *at), _anchor_batch, "anchor long, p int, n int, doc_id long, key long")
    found = materialize(found, "anchors", step)
    shared = materialize(_least(found, ["anchor"]).select("anchor"), "shared", step)
    ranges = found.join(shared, "anchor", "left_semi").groupBy(*at).agg(F.collect_set(F.struct("p", "n")).alias("ranges"))  # bounded by a text
    ranges = materialize(ranges, "ranges", f"{step}.ranges")
    release(spark, step)
    windows = map_batches(known.join(ranges, at).select("text", "ranges", *at), _window_batch, "h long, g long, p int, doc_id long, key long")
    windows = materialize(windows, "windows", step)
    release(spark, f"{step}.ranges")
    least = materialize(_least(windows, ["h", "g"]), "least", step)
    hit = windows.join(least, ["h", "g"]).where("lo < doc_id")
    starts = materialize(hit.groupBy(*at).agg(F.collect_set("p").alias("starts")), "starts", keep_for)
    release(spark, step)
    return starts


def dedup(docs: DataFrame, keep_for: str = "call") -> DataFrame:
    """Counts and digest of what stays of each text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    known = docs.where("doc_id is not null")
    spans = repeated_spans(known, keep_for)
    starts = repeated_windows(known, spans, keep_for)
    at = ["doc_id", "key"]
    cut = docs.join(spans, at, "left").join(starts, at, "left").select("doc_id", "text", "spans", "starts")
    return map_batches(cut, _cut_batch, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(W.documents(spark, sf_dir, "doc_id", "text"))
