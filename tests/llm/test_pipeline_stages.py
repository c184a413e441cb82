"""The stages against what each alone should keep or change."""

import random
import re

import corpus_pipeline
from millrace.llm import pii, quality, simhash
from millrace.plans.durable import materialize
from tests.llm.test_queries import SCHEMA, texts

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def documents(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, True, 2, 3, 4, "r", "b", "c") for r in texts()], SCHEMA)


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii_redaction", "source_mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name, "test")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == NAMES
    kept = {r["doc_id"] for r in quality.query(spark, str(tmp_path)).where("kept").collect()}
    assert {r["doc_id"] for r in seen["quality_rules"]} == kept
    prints = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in seen["quality_rules"]]
    left = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in seen["simhash_near_dedup"]]
    assert len(left) == len(set(left)) and all(any((f ^ g).bit_count() <= 2 for _, g in left) for _, f in prints)
    assert {4, 5} <= {d for d, _ in left} and not {200, 201} & {d for d, _ in left}
    assert len(seen["pii_redaction"]) == len(left)
    for r in seen["pii_redaction"]:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(words(seen["source_mixing"]) - words(seen["pii_redaction"])) <= 128 * 4
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["source_mixing"]}


def test_empty_stages(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name, "test")
    assert docs.count() == 0


def test_near_copies_by_five_word_shingles(spark):
    """Copies with replaced words go while their 5-word shingles have Jaccard 0.8 or more, and stay below it."""
    rng = random.Random(8)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, gone, stay = [], set(), set()
    for i in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        rows.append((10 * i, " ".join(words)))
        stay.add(10 * i)
        for j, n in ((1, 1), (2, 2), (3, 4), (4, 12)):
            copy = list(words)
            for at in rng.sample(range(5, 195), n):
                copy[at] = f"x{rng.randint(0, 10**6)}"
            near = len(grams(words) & grams(copy)) / len(grams(words) | grams(copy)) >= 0.8
            (gone if near else stay).add(10 * i + j)
            rows.append((10 * i + j, " ".join(copy)))
    assert len(gone) > 100
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == stay


def test_near_copies_chain(spark):
    """Two documents of a bucket that are each unlike its least row still meet."""
    sets = spark.createDataFrame([(1, [1, 2]), (2, list(range(10, 30))), (3, list(range(11, 30)))], "node long, grams array<long>")
    member = spark.createDataFrame([(7, n, 1) for n in (1, 2, 3)], "bucket long, node long, least long")
    assert [tuple(r) for r in simhash.similar_links(member, sets, "test").collect()] == [(3, 2)]


def test_prefix_pairs_lose_none(spark):
    """Every similar pair of different parts is proposed; texts of many sizes, and rare and common shingles."""
    rng = random.Random(12)
    sets = []
    for _ in range(12):
        base = [rng.randint(1, 400) for _ in range(rng.randint(1, 60))]
        for _ in range(8):
            sets.append(sorted({x if rng.random() > 0.04 else rng.randint(1, 10**6) for x in base}))
    df = spark.createDataFrame(list(enumerate(sets)), "node long, grams array<long>")
    part = spark.createDataFrame([(i, i % 90) for i in range(len(sets))], "node long, part long")
    got = simhash.prefix_pairs(part, df, "test")
    near = {(i, j) for j in range(len(sets)) for i in range(j) if i % 90 != j % 90 and 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}
    proposed = {tuple(r) for r in got.collect()}
    assert near <= proposed and len(near) > 50
    assert {tuple(r) for r in simhash._similar(got, df).collect()} == near


def test_stages_keep_odd_column_names(spark, tmp_path):
    """Names with blanks, dots and quotes, and names that the stages use themselves, come through every stage."""
    from pyspark.sql import functions as F

    odd = ["a b", "a.b", "a`b", "row x", "__row", "__rid", "rid", "h", "skey", "start", "sub", "epoch", "parts", "extra", "base", "node", "bands", "fp", "key", "__c", "word_len"]
    docs = spark.createDataFrame([r[:4] for r in texts()], "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() > 20
        assert got.select(*(F.col("`" + c.replace("`", "``") + "`") for c in odd)).distinct().collect() == [tuple(range(len(odd)))]


def test_mix_follows_content(spark):
    """The mix does not depend on how rows lie in files."""
    from millrace.llm import mixing

    docs = spark.createDataFrame([r[:4] for r in texts()], "doc_id long, text string, lang string, source string")
    a, b = (sorted(map(str, mixing.mix_documents(d).collect())) for d in (docs.repartition(1), docs.orderBy("text").repartition(3)))
    assert a == b
