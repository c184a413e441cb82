"""Packing by cutting-stock column generation.

One pass tokenises every text; a document of n ids gives n // 2048 full pieces, one piece
of the whole ``CUT``s that remain and one of what is then left, with the crc of each piece's
ids, so texts are read once. Pieces fall into length classes of ``GRAIN`` ids (rounded up). The histogram over classes is a cutting-stock
problem: a linear program over patterns (how many pieces of each class share a sequence)
starts from one-class patterns, and a knapsack dynamic program over the LP's prices finds
the next column until none prices above one or the bound is met. Pattern counts are rounded
down, what is left is packed first-fit-decreasing into further patterns. Pieces are ranked
inside their class (two-level ranks over hashed sub-groups, so a class with a third of all
pieces is split) and rank maps to pattern, copy and slot by interval.

The program sees a histogram of at most 136 classes at every corpus size; the pattern
table that all tasks get has at most a few thousand rows for the same reason.

Ids are those of the tokenizer's own file. Its pattern never goes from other characters on to
white space, so texts are encoded in chunks cut there, and a worker remembers short chunks.

Defined results: null text is the single id 1; repeated rows are packed each; ties are broken by
a hash of the row number; a text of any length is encoded chunk by chunk; empty documents and
empty tables work; further columns of any name are ignored.
"""

from __future__ import annotations

import array
import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm import words as W
from millrace.llm.arrow import map_batches
from millrace.plans.durable import materialize

LENGTH = 2048
GRAIN = 2
#: A remainder is cut once, after its last whole multiple of this; short pieces fill gaps.
CUT = 256
#: Stop when the program is within this ratio of the volume bound.
GAP = 1.0005
COLUMNS = 4000
END = 1
#: Pieces of a ranking group.
RUN = 256
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Words that a worker remembers, and characters of the longest.
MEMO, LONG = 600_000, 64
#: The last letter of the Latin blocks whose classes all libraries agree on.
LATIN = "\u024f"


# --- tokens ---------------------------------------------------------------------------

#: What the tokenizer's own pattern takes for white space (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No pre-token goes from other characters on to white space, so texts are cut there.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space before a blank: such texts are cut by ``CHUNKS``, all others at their blanks.
ODD = re.compile(r"\s ").search


class _Words(dict):
    """Ids (as bytes) of a blank and a word; long ones are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def _quick(whole):
    """An encoder of short Latin chunks, which costs a third of ``whole`` for each; it must be the same BPE.

    Both are byte-level BPE over one pattern. They give the same ids if a token's id is its rank and
    the merges, in their order, make the tokens of growing rank; that is checked here.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    byte = {t: r for r, t in ranks.items()}
    model = json.loads(whole.to_str())["model"]
    shown = {c: i for c, i in model["vocab"].items() if len(c) == 1}  # how the file shows each byte
    raw = {c: byte[i] for c, i in shown.items() if i in byte and len(byte[i]) == 1}
    spell = lambda token: b"".join(raw[c] for c in token)
    made = [ranks.get(spell(a + b)) for a, b in map(_pair, model["merges"])]
    same = len(raw) == 256 and None not in made and all(a < b for a, b in pairwise(made)) and len(made) + 256 == len(ranks)
    same = same and all(model["vocab"].get("".join(p)) == r for p, r in zip(map(_pair, model["merges"]), made))
    return quick.encode_ordinary if same else None


def _pair(merge) -> tuple[str, str]:
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


@cache
def _load():
    """(finder of added tokens, encoder of any text, memo of words) of the byte-level BPE, once per worker."""
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    quick = _quick(tokenizer)

    def whole(text: str) -> bytes:
        return array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(text: str) -> bytes:
        if quick and len(text) <= LONG and (text.isascii() or max(text) <= LATIN):
            return array.array("I", quick(text)).tobytes()
        return whole(text)

    return re.compile("|".join(map(re.escape, added)) or r"(?!)").search, whole, chunk, _Words(chunk)


def token_bytes(text: str | None) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text, then id 1.

    A text that holds an added token is encoded at once, since such a token may lie over a cut.
    """
    added, whole, chunk, words = _load()
    text, end = text or "", array.array("I", [END]).tobytes()
    if added(text):
        return whole(text) + end
    if ODD(text):
        return b"".join(map(chunk, CHUNKS.findall(text))) + end
    head, *rest = text.split(" ")
    return (chunk(head) if head else b"") + b"".join(map(words.__getitem__, rest)) + end


def _piece_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    at, start, length, crc, total = [], [], [], [], []
    for i, text in enumerate(batch.column("text").to_pylist()):
        ids = token_bytes(text)
        n = len(ids) // 4
        cuts = [*range(0, n, LENGTH), n // CUT * CUT, n]
        for a, b in pairwise(sorted(set(cuts))):
            at.append(i)
            start.append(a)
            length.append(b - a)
            crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            total.append(n)
    rest = [n for n in batch.schema.names if n != "text"]
    kept = batch.select(rest).take(pa.array(at, pa.int64()))
    cols = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
    return pa.RecordBatch.from_arrays([*kept.columns, *cols], [*rest, "start", "length", "ids_crc32", "doc_tokens"])


# --- cutting stock --------------------------------------------------------------------


def _knapsack(price: np.ndarray, size: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Best-priced pattern (unbounded knapsack): value and count of each item."""
    best = np.zeros(cap + 1)
    pick = np.full(cap + 1, -1)
    order = np.argsort(size)
    s, p = size[order], price[order]
    for c in range(1, cap + 1):
        m = int(np.searchsorted(s, c, "right"))
        best[c] = best[c - 1]
        if m:
            v = best[c - s[:m]] + p[:m]
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], pick[c] = v[k], k
    count, c = np.zeros(len(size), np.int64), cap
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[cap]), count


def solve(demand: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {size: count}, copies)] that covers ``demand`` {size: pieces} exactly.

    Revised simplex on the covering program: the basis holds one pattern per size, a
    priced column enters, the ratio test picks the leaving one, and the inverse is updated.
    """
    if not demand:
        return []
    size = np.array(sorted(demand), np.int64)
    need = np.array([demand[s] for s in size], float)
    per = cap // size
    basis = np.diag(per).astype(np.int64)  # columns are patterns
    inverse = np.diag(1.0 / per)
    x = need / per
    bound = float(need @ size) / cap
    for _ in range(COLUMNS):
        price = inverse.sum(axis=0)
        value, column = _knapsack(np.maximum(price, 0), size, cap)
        if value <= 1 + 1e-9 or x.sum() <= max(bound, x.sum() / value) * GAP:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        theta = ratio[leave]
        x = np.maximum(x - theta * step, 0)
        x[leave] = theta
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        basis[:, leave] = column
    copies = np.floor(x + 1e-9).astype(np.int64)
    left = need.astype(np.int64) - basis @ copies
    while (left < 0).any():  # a floor that rounds up by its epsilon
        over = int(np.flatnonzero(basis[int(np.argmin(left))] * copies)[0])
        copies[over] -= 1
        left += basis[:, over]
    plan = [({int(s): int(n) for s, n in zip(size, basis[:, j]) if n}, int(c)) for j, c in enumerate(copies) if c]
    return plan + [(p, 1) for p in _first_fit(size, left, cap)]


def _first_fit(size: np.ndarray, left: np.ndarray, cap: int) -> list[dict[int, int]]:
    """Best fit, longest first, for the pieces that rounding left over."""
    room: list[int] = []
    bins: list[dict[int, int]] = []
    for s, n in sorted(zip(size.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            fit = [i for i, r in enumerate(room) if r >= s]
            i = min(fit, key=room.__getitem__) if fit else len(room)
            if not fit:
                room.append(cap)
                bins.append({})
            room[i] -= s
            bins[i][s] = bins[i].get(s, 0) + 1
    return bins


def intervals(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """class -> rows (first rank, first sequence, pieces per copy, slot) in rank order."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, copies in plan:
        for slot, s in enumerate(sorted(pattern, reverse=True)):
            at = rank.get(s, 0)
            rows.setdefault(s, []).append((at, sequence, pattern[s], slot))
            rank[s] = at + pattern[s] * copies
        sequence += copies
    return {s: np.array(r, np.int64) for s, r in rows.items()}


# --- on Spark -------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to a materialised piece table (length at most 2048)."""
    cls = F.expr(f"(length + {GRAIN - 1}) div {GRAIN}").cast("int")
    pieces = pieces.withColumn("cls", cls)
    hist = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    table = intervals(solve(hist, LENGTH // GRAIN))
    groups = max(1, -(-sum(hist.values()) // RUN))
    # the row number spreads the rows of one doc_id as well; the table is written, so it stays
    row = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())
    sub = pieces.withColumn("key", row).withColumn("sub", F.pmod("key", F.lit(groups)))
    base = sub.groupBy("cls", "sub").agg(F.count("*").alias("n"))
    base = base.select("cls", "sub", (F.sum("n").over(Window.partitionBy("cls").orderBy("sub")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("cls", "sub").orderBy("key")) - 1 + F.col("base")
    ranked = sub.join(base, ["cls", "sub"]).withColumn("rank", rank).drop("base", "sub", "key")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, r = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("cls", "rank"))
            seq, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                t, hit = table[int(k)], c == k
                i = np.searchsorted(t[:, 0], r[hit], "right") - 1
                seq[hit] = t[i, 1] + (r[hit] - t[i, 0]) // t[i, 2]
                slot[hit] = t[i, 3] * LENGTH + (r[hit] - t[i, 0]) % t[i, 2]
            rest = [n for n in b.schema.names if n not in ("cls", "rank")]
            yield pa.RecordBatch.from_arrays([*b.select(rest).columns, pa.array(seq), pa.array(slot)], [*rest, "sequence_id", "slot"])

    kept = [f for f in ranked.schema.fields if f.name not in ("cls", "rank")]
    placed = ranked.mapInArrow(assign, StructType([*kept, StructField("sequence_id", LongType()), StructField("slot", LongType())]))
    run = Window.partitionBy("sequence_id").orderBy("slot")
    return placed.withColumn("offset", F.sum("length").over(run) - F.col("length")).drop("slot")


def tokenized(docs: DataFrame) -> DataFrame:
    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), _piece_batch, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, keep_for: str = "call") -> DataFrame:
    out = pack_pieces(materialize(tokenized(docs), "pieces", keep_for))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(W.documents(spark, sf_dir, "doc_id", "text"))
