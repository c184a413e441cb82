"""SimHash near-duplicates by bit-sliced comparison.

A text's 64-bit fingerprint has a bit set where over half its 3-word shingle hashes have
it. Equal fingerprints are merged first (pre-aggregated, so copies cost nothing). Two
fingerprints that differ in at most two bits agree on two of their four 16-bit blocks,
so each goes to six cells keyed by a pair of blocks: no link is lost. A cell of more than
``CELL`` fingerprints is divided again by two of the four bytes of its free half, which
bounds a cell at 65,536 fingerprints. Inside a cell the fingerprints lie as vertical bit
planes; a query updates 64 distances at once with carry-save counters, plane by plane,
and a block is abandoned once all its distances exceed the radius. A cell returns a
spanning forest of its links, never all pairs.

The pipeline's stage (``keep_one``) takes 5-word shingles and has its own measure, exact Jaccard
similarity. At 0.8 fingerprints differ in about ten bits, too many for blocks of 64 bits to find,
so pairs are proposed by the cells above and by buckets of minimum hashes. What lies in one bucket
but in different classes after the first proposals meets by prefix filtering, which is exact.

Defined results: a null or wordless text has fingerprint zero; null doc_id takes part but
is never the smallest id; repeated rows return repeated rows, and the stage keeps one of them;
ties between rows of one doc_id go to the first row; a text of any length is counted ``CHUNK``
shingles at a time; further columns of any name are kept by the stage, ignored by the query;
empty input gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm import words as W
from millrace.llm.arrow import map_batches
from millrace.llm.components import connected
from millrace.plans.durable import materialize

RADIUS = 2
CELL = 1024
SHINGLE = 3
#: The pipeline's stage: words of a shingle, least Jaccard similarity as a fraction, and bands of
#: minimum hashes (a pair at 0.8 shares no bucket in 1 of 12,000 cases, at 0.85 in 1 of 5 million).
STAGE_SHINGLE, SIMILAR = 5, (4, 5)
BANDS, BAND_ROWS = 40, 7
#: Ratio of neighbouring size classes of the prefix filter.
STEP = 1.05
#: Shingles whose bits are counted at once, and (query, word) entries compared at once.
CHUNK, ENTRIES = 65_536, 262_144
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_FLIP, _MULTIPLY = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_MULTIPLY |= np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of one whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    return _majority(np.fromiter(map(_hash, grams), np.uint64))


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
    rest = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(fp)], [*rest, "fp"])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the signed 64-bit ``fp`` of each text."""
    part = docs.select("text", *keep)
    return map_batches(part, _fingerprint_batch, StructType([*part.schema.fields[1:], StructField("fp", LongType())]))


def links_in_cells(cell: np.ndarray, fp: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, least fp) inside each run of equal ``cell``; input sorted by cell."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    group = np.repeat(np.arange(len(first)), size)
    keep = size[group] > 1
    if not keep.any():
        return fp[:0], fp[:0]
    cell, fp, group = cell[keep], fp[keep], group[keep]
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    start = np.r_[0, np.cumsum(size)[:-1]]
    words = (size + 63) // 64
    word0 = np.r_[0, np.cumsum(words)[:-1]]
    lane = word0[group] * 64 + np.arange(len(fp)) - start[group]
    grid = np.zeros((int(words.sum()) * 64, 64), np.uint8)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    grid[lane] = bits
    planes = np.packbits(grid, axis=0, bitorder="little").T.copy().view("<u8")  # 64 x words
    held = np.zeros(len(grid), np.uint8)
    held[lane] = 1
    valid = np.packbits(held, bitorder="little").view("<u8")
    at_lane = np.full(len(grid), -1)
    at_lane[lane] = np.arange(len(fp))
    label = np.arange(len(fp))
    per = words[group]  # words that each query is compared with
    ends = np.cumsum(per)
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENTRIES, "right")))
        q = np.repeat(np.arange(lo, hi), per[lo:hi])
        w = word0[group[q]] + np.arange(len(q)) - np.repeat(np.cumsum(per[lo:hi]) - per[lo:hi], per[lo:hi])
        a, b = _within(planes, valid, bits, q, w)
        label = _merge(label, a, at_lane[b])
        lo = hi
    hit = label != np.arange(len(fp))
    return fp[hit], fp[label[hit]]


def _within(planes, valid, bits, q, w):
    """(query, lane) pairs within the radius: carry-save counters of two bits and an overflow."""
    one = np.zeros(len(q), np.uint64)
    two, over = one.copy(), one.copy()
    for p in range(64):
        d = planes[p][w] ^ (bits[q, p] * ALL)
        carry = one & d
        one ^= d
        over |= two & carry
        two ^= carry
        if p % 8 == 7:  # three or more differences: beyond the radius
            near = ~(over | (one & two)) & valid[w]
            live = near != 0
            if not live.all():
                q, w, one, two, over, near = (x[live] for x in (q, w, one, two, over, near))
    lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    entry, bit = np.nonzero(lanes)
    return q[entry], w[entry] * 64 + bit


def _merge(label, a, b):
    """Least label over the links added; stable when no link joins two labels."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label = up


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells arrive sorted; the last cell of a batch waits for its remainder."""
    cell, fp = [], []
    for batch in batches:
        c, f = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "fp"))
        if not len(c):
            continue
        cell.append(c)
        fp.append(f)
        if c[0] == c[-1] and cell[0][0] == c[0]:
            continue
        c, f = np.concatenate(cell), np.concatenate(fp)
        cut = int(np.searchsorted(c, c[-1]))
        yield _links(c[:cut], f[:cut])
        cell, fp = [c[cut:]], [f[cut:]]
    if cell:
        yield _links(np.concatenate(cell), np.concatenate(fp))


def _links(c, f):
    a, b = links_in_cells(c, f) if len(c) else (f, f)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _block(x, k: int, width: int):
    return F.shiftright(x, k * width).bitwiseAND(F.lit((1 << width) - 1))


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp) for every cell that holds at least two fingerprints."""
    pairs = list(combinations(range(4), 2))
    key = lambda i, j, k: F.lit(k << 32) + F.shiftleft(_block("fp", i, 16), 16) + _block("fp", j, 16)
    rows = fps.select("fp", F.explode(F.array(*(key(i, j, k) for k, (i, j) in enumerate(pairs)))).alias("key"))
    busy = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(busy, "key")
    free = [[x for x in range(4) if x not in p] for p in pairs]
    half = lambda f: F.shiftleft(_block("fp", f[0], 16), 16) + _block("fp", f[1], 16)
    rest = F.element_at(F.array(*(half(f) for f in free)), (F.shiftright("key", 32) + 1).cast("int"))
    rows = rows.withColumn("rest", rest)
    sub = lambda i, j, k: F.shiftleft("key", 19) + F.lit(k << 16) + F.shiftleft(_block("rest", i, 8), 8) + _block("rest", j, 8)
    split = F.array(*(sub(i, j, k + 1) for k, (i, j) in enumerate(pairs)))
    return rows.select("fp", F.explode(F.when(F.col("n") > CELL, split).otherwise(F.array(F.shiftleft("key", 19)))).alias("cell"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): distinct fingerprints ``fp`` that differ in at most ``RADIUS`` bits, a spanning forest of each cell."""
    cells = _cells(fps).repartition("cell").sortWithinPartitions("cell", "fp")
    return cells.mapInArrow(_link_batches, "a long, b long")


def components(prints: DataFrame, id_col: str, keep_for: str = "call") -> DataFrame:
    """(fp, component_id) for every distinct fp of ``prints`` (a materialised table)."""
    reps = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "reps", keep_for)
    star = connected(links(reps.select("fp")), "a", "b", keep_for)
    member = star.union(star.select("root", "root").distinct()).join(reps.withColumnRenamed("fp", "node"), "node")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = member.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    out = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return materialize(out, "classes", keep_for)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(W.documents(spark, sf_dir, "doc_id", "text"), "doc_id"), "prints")
    out = prints.join(components(prints, "doc_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the pipeline's stage -----------------------------------------------------------------


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's ``STAGE_SHINGLE``-word shingles, repeats included (of all of a shorter text)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(w)] if len(w) < STAGE_SHINGLE else map(b" ".join, zip(*(w[i:] for i in range(STAGE_SHINGLE))))
    return np.fromiter(map(_hash, grams), np.uint64)


def buckets(grams: np.ndarray) -> np.ndarray:
    """One 64-bit name of each band of ``BAND_ROWS`` minimum hashes."""
    least = np.full(len(_MULTIPLY), ALL)
    for at in range(0, len(grams), 512):
        np.minimum(least, ((grams[at : at + 512, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))), np.uint64, BANDS)


def _sign_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Two hashes of each text's words, which exact copies share, its fingerprint and its buckets."""
    key, fp, bands = [], [], []
    for t in batch.column("text").to_pylist():
        key.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())))
        grams = shingles(t)
        fp.append(_majority(grams))
        bands.append(buckets(np.unique(grams)).view(np.int64))
    names = ["__rid", "doc_id"]
    cols = [pa.array(key, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], [*names, "key", "fp", "bands"])


def _set_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    grams = [np.unique(shingles(t)).view(np.int64) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose shingle sets have a Jaccard similarity of ``SIMILAR`` or more, exactly."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    num, den = SIMILAR
    return both.where((num + den) * F.size(F.array_intersect("x", "y")) >= num * (F.size("x") + F.size("y"))).select("a", "b")


def _size_class(size):
    return F.floor(F.log(size) / F.log(F.lit(STEP)) + F.lit(1e-9)).cast("int")


def prefix_pairs(part: DataFrame, sets: DataFrame, keep_for: str) -> DataFrame:
    """All (a, b) of different ``part`` that can be similar; ``part`` has node and part, one row a node.

    Shingles are put in one order for all nodes, rare ones first. Let the first common one be at
    place p of m in a node: the overlap is m - p at most, which a similarity of ``SIMILAR`` bounds
    below by the sizes of both. So a shingle needs to meet only partners of the sizes that its place
    allows on either side; shingles that one node alone has come first and meet nobody.
    """
    num, den = SIMILAR
    rows = part.join(sets, "node").select("node", "part", F.size("grams").alias("m"), F.explode("grams").alias("g"))
    rows = materialize(rows, "grams", keep_for)
    common = rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(common, "g")
    first = Window.partitionBy("node").orderBy("df", "g")  # bounded by a text
    place = F.col("m") - F.count("*").over(Window.partitionBy("node")) + F.row_number().over(first) - 1
    rows = rows.withColumn("left", F.col("m") - place).where(den * F.col("left") >= num * F.col("m"))
    most = F.expr(f"({num + den} * left - {num} * m) div {num}")  # the largest partner
    least = F.greatest(F.lit(1), F.expr(f"({num} * m) div {den}"))
    classes = F.sequence(_size_class(least), _size_class(F.greatest(least, most)))
    rows = rows.withColumn("own", _size_class(F.col("m"))).withColumn("other", F.explode(classes))
    rows = materialize(rows.select("g", "node", "part", "m", "left", "own", "other"), "prefixes", keep_for)
    x = rows.toDF("g", "a", "pa", "ma", "la", "ca", "cb")
    y = rows.toDF("g", "b", "pb", "mb", "lb", "cb", "ca")
    fits = (num + den) * F.least("la", "lb") >= num * (F.col("ma") + F.col("mb"))
    return x.join(y, ["g", "ca", "cb"]).where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & fits).select("a", "b").distinct()


def similar_links(member: DataFrame, sets: DataFrame, keep_for: str, more: DataFrame | None = None) -> DataFrame:
    """(node, root) over the similar pairs that share a bucket; ``member`` has bucket, node, least.

    First each member meets the least of its bucket, and the pairs (a, b) of ``more`` meet; then
    members of buckets that still hold several classes meet by ``prefix_pairs``, so neither a
    cluster of near copies nor the copies that fall short of it cost a square of their number.
    """
    star = member.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    star = star.unionByName(more) if more is not None else star
    links = materialize(_similar(star.distinct(), sets), "links", keep_for)
    roots = materialize(connected(links, "a", "b", keep_for), "roots", keep_for)
    part = member.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    apart = part.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("bucket")
    part = materialize(part.join(apart, "bucket", "left_semi").select("node", "part").distinct(), "apart", keep_for)
    rest = materialize(_similar(prefix_pairs(part, sets, keep_for), sets), "links", keep_for)
    return connected(links.union(rest), "a", "b", keep_for)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies: the least (doc_id, row), columns as they came.

    Near copies share at least ``SIMILAR`` of their distinct ``STAGE_SHINGLE``-word shingles; a
    class is a connected component. Cells and buckets only propose pairs.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("__rid"), W.packed(docs.columns).alias("__row")), "rows", "pipeline")
    part = rows.select("__rid", F.col("__row.doc_id").cast("long").alias("doc_id"), F.col("__row.text").alias("text"))
    signed = materialize(map_batches(part, _sign_batch, "__rid long, doc_id long, key binary, fp long, bands array<long>"), "signed", "pipeline")
    at = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "__rid", "fp", "bands")
    reps = materialize(signed.groupBy("key").agg(F.min(at).alias("at")).select(F.col("at.__rid").alias("node"), "at.id", "at.fp", "at.bands"), "reps", "pipeline")
    prints = materialize(reps.groupBy("fp").agg(F.min("node").alias("node")), "prints", "pipeline")
    near = links(prints.select("fp")).join(prints.toDF("a", "na"), "a").join(prints.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = reps.select("node", "fp").join(prints.toDF("fp", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    near = materialize(near.union(equal), "near", "pipeline")
    member = reps.select("node", F.explode("bands").alias("bucket"))
    busy = member.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = materialize(member.join(busy, "bucket").select("bucket", "node", "least"), "members", "pipeline")
    wanted = member.select("node").union(near.select("a")).union(near.select("b")).distinct()
    texts = part.select(F.col("__rid").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = materialize(map_batches(texts, _set_batch, "node long, grams array<long>"), "sets", "pipeline")
    roots = similar_links(member, sets, "pipeline", near)
    classes = reps.select("node", "id").join(roots, "node", "left")
    stay = classes.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("id", "node")).alias("at")).select(F.col("at.node").alias("__rid"))
    return rows.join(stay, "__rid", "left_semi").select("__row.*")
