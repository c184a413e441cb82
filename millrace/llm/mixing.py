"""Mixing sources to target weights over fixed-length blocks.

The words of a source form one line (documents in hashed order) that is cut into blocks
of ``BLOCK`` words. Sources in code point order (null last) weigh 1, 2, 3, 1, ...; their
targets share all words of the corpus, stop at ``REPEATS`` times a source's size, and the
excess is shared again. Output shards hold ``SHARD`` slots (more where the corpus would need
over ``SHARDS`` shards); each shard draws its source counts from a multinomial over the
slots still owed, so the totals meet the targets. Slot k of a source maps to a block by a
keyed swap-or-not permutation of its block indexes, a fresh one for each pass over the
source: no block is taken more than one time above another. Slots and documents meet by
(source, block), which is a join on unique keys.

The driver holds one number per source and per (shard, source) at most; every row of the
corpus stays distributed, and prefix sums run over hashed sub-groups, so a source with a
third of all rows is split. All draws are seeded: reruns agree.

Defined results: null text has size 0 and is taken 0 times; null source is a source of
its own; repeated rows are placed each, next to one another; ties of the hashed order go by row
number, which tells only rows of one doc_id and text apart; a text of any length is a run of
blocks; further columns of any name are kept by the stage, ignored by the query; empty input
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.arrow import map_batches
from millrace.plans.durable import materialize

BLOCK = 128
SHARD = 4096
SHARDS = 65_536
REPEATS = 3
SEED = 7
ROUNDS = 12
#: Documents of a prefix-sum group.
RUN = 256


def targets(sizes: list[int]) -> list[float]:
    """Target words of each source, sizes in source order."""
    total, weight = float(sum(sizes)), [1 + i % 3 for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), total
    while free:
        share = rest / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * share > REPEATS * sizes[i]]
        if not full:
            for i in free:
                out[i] = weight[i] * share
            break
        for i in full:
            out[i] = float(REPEATS * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def shard_counts(owed: list[int], seed: int = SEED) -> np.ndarray:
    """(shards, sources) slot counts: a multinomial for each shard over what is still owed."""
    left = np.array(owed, np.int64)
    slots = max(SHARD, -(-int(left.sum()) // SHARDS))
    rng, rows = np.random.default_rng(seed), []
    while (rest := int(left.sum())) > 0:
        want = min(slots, rest)
        take = np.minimum(rng.multinomial(want, left / rest), left)
        while (short := want - int(take.sum())) > 0:
            open_ = left - take
            take += np.minimum(rng.multinomial(short, open_ / open_.sum()), open_)
        rows.append(take)
        left = left - take
    return np.array(rows, np.int64).reshape(len(rows), len(owed))


def permuted(index: Column, n: Column, key: Column) -> Column:
    """Swap-or-not: a keyed permutation of [0, n), evaluated per row."""

    def round_(x: Column, r: Column) -> Column:
        pivot = F.pmod(F.xxhash64(key, r), n)
        partner = F.pmod(pivot - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, round_)


def place(docs: DataFrame, keep_for: str = "call") -> tuple[DataFrame, DataFrame, dict]:
    """(documents with skey and start, slots, plan). ``docs`` has source, size, a unique ``rid`` and ``h``,
    a hash of what a document says: documents lie in its order, whatever their layout in files is."""
    spark = docs.sparkSession
    skey = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    sized = docs.withColumn("skey", skey)
    per = {r["skey"]: (r["n"], r["docs"]) for r in sized.groupBy("skey").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()}
    keys = sorted(per)
    size = [per[k][0] for k in keys]
    goal = targets(size)
    blocks = [-(-s // BLOCK) for s in size]
    owed = [min(REPEATS * b, round(g / s * b)) if s else 0 for g, s, b in zip(goal, size, blocks)]
    plan = pd.DataFrame({"skey": keys, "source_size": size, "target": goal, "blocks": blocks, "owed": owed})
    counts = shard_counts(owed)
    first = np.cumsum(counts, axis=0) - counts
    shard, src = np.nonzero(counts)
    table = pd.DataFrame({"shard": shard, "skey": np.array(keys, object)[src], "n": counts[shard, src], "first": first[shard, src], "blocks": np.array(blocks, np.int64)[src]})
    draws = spark.createDataFrame(table, "shard long, skey string, n long, first long, blocks long")
    slots = draws.select("shard", "skey", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("k"))
    epoch = F.expr("k div blocks")
    slots = slots.select("shard", "skey", "k", epoch.alias("epoch"), permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64("skey", epoch, F.lit(SEED))).alias("block"))
    groups = max(1, -(-sum(n for _, n in per.values()) // RUN))
    sub = sized.where("size > 0").withColumn("sub", F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(groups)))
    base = sub.groupBy("skey", "sub").agg(F.sum("size").alias("n"))
    base = base.select("skey", "sub", (F.sum("n").over(Window.partitionBy("skey").orderBy("sub")) - F.col("n")).alias("base"))
    at = Window.partitionBy("skey", "sub").orderBy("h", "rid")
    start = F.col("base") + F.sum("size").over(at) - F.col("size")
    placed = sub.join(base, ["skey", "sub"]).withColumn("start", start).drop("sub", "base")
    return placed, slots, {"table": plan, "draws": draws}


def pieces(placed: DataFrame) -> DataFrame:
    """(rid, skey, block, lo, len): a document's words inside each block it touches."""
    b = F.lit(BLOCK)
    p = placed.select("rid", "skey", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
    return p.select("rid", "skey", "block", lo.alias("lo"), (F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start")) - lo).alias("len"))


def sizes(docs: DataFrame, *keep: str | Column) -> DataFrame:
    return docs.select(*keep, F.size(W.words(F.col("text"))).cast("long").alias("size"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sizes(W.documents(spark, sf_dir, "doc_id", "source", "text"), "doc_id", "source", F.xxhash64("doc_id", "text").alias("h"))
    docs = materialize(docs.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    placed, slots, plan = place(docs)
    times = slots.groupBy("skey", "block").agg(F.count("*").alias("times"))
    got = pieces(placed).join(times, ["skey", "block"]).groupBy("rid").agg(F.sum(F.col("len") * F.col("times")).alias("taken"))
    per = spark.createDataFrame(plan["table"][["skey", "source_size", "target"]], "skey string, source_size long, target double")
    skey = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    return docs.join(got, "rid", "left").withColumn("skey", skey).join(per, "skey", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole text where all words are taken; else the word ranges taken, one line each."""
    out = []
    for text, size, parts in zip(*(batch.column(n).to_pylist() for n in ("text", "size", "parts"))):
        if sum(p["len"] for p in parts) < size:
            at = [m.span() for m in W.FIND.finditer(text)]
            runs: list[list[int]] = []
            for p in parts:
                if runs and runs[-1][1] == p["lo"]:
                    runs[-1][1] += p["len"]
                else:
                    runs.append([p["lo"], p["lo"] + p["len"]])
            text = "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)
        out.append(text)
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and pass over its source, texts cut to the words taken."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", "text").alias("h"), "text", W.packed(rest).alias("row"))
    rows = materialize(rows.withColumn("size", F.size(W.words(F.col("text"))).cast("long")), "rows", "pipeline")
    placed, slots, _ = place(rows.select("rid", "h", F.col("row.source").alias("source"), "size"))
    taken = pieces(placed).join(slots.select("skey", "block", "epoch"), ["skey", "block"])
    parts = taken.groupBy("rid", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "len"))).alias("parts"))
    mixed = rows.join(parts, "rid").select("row", "text", "size", "parts")
    return W.unpacked(map_batches(mixed, _cut, mixed.select("row", "text").schema), docs)
