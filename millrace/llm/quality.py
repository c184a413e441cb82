"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Every document gets four metrics as integers (ten-thousandths of a ratio). Per
language and source, and per metric, a mergeable quantile sketch holds how many
documents fall into each log-linear bucket (five leading bits, so a quantile is
within 1/32 of the true value). Sketches merge by adding counts: a group with fewer
than ``MIN_GROUP`` documents borrows the merged sketch of its language, and that in
turn the one of the corpus. Fences are ``median +- REACH * max(IQR, floor)``; a
document outside a fence is rejected. Thresholds join back on (language, source).

Defined results: null text counts as empty and fails the base rule; null language and
source form their own group; repeated rows are judged each, alike; an empty table gives
an empty result; further columns are ignored by the query and passed on by ``filter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hof import let
from millrace.llm import words as W
from millrace.plans.durable import materialize

MIN_WORDS = 50
MIN_GROUP = 100
REACH = 4
SCALE = 10_000
#: metric -> (least spread in ten-thousandths, checks the lower side too)
METRICS = {"word_len": (6000, True), "symbols": (800, False), "dup_lines": (1200, False), "repeats": (1000, False)}
#: A threshold table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Window fingerprints are sorted with their positions; equal neighbours mark the
    repeated windows, and the union of [p, p + 3) is summed in one pass.
    """

    def covered(tagged: Column) -> Column:
        def union(at: Column) -> Column:
            return F.aggregate(
                at,
                F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, p: F.struct(
                    p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")
                ),
                lambda acc: acc["n"],
            )

        def same(a: Column, b: Column) -> Column:
            return F.coalesce(F.get(tagged, a)["h"] == F.get(tagged, b)["h"], F.lit(False))

        hit = F.filter(tagged, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return union(F.array_sort(F.transform(hit, lambda x: x["p"])))

    def tag(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, tag))


def base_counts(text: Column) -> Column:
    """Struct of the contract's base counts for one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(W.WORD))
    return let(
        W.words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, W.GAP, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        ),
    )


def with_metrics(docs: DataFrame) -> DataFrame:
    """Columns lang, source, then counts, base verdict and the four metrics (one pass over texts)."""
    c = lambda n: F.col("__c")[n]
    per = lambda a, b: F.expr(f"cast({a} * {SCALE} div greatest({b}, 1) as bigint)")
    keep = [x for x in docs.columns if x != "__c"]
    out = docs.withColumn("__c", base_counts(F.col("text"))).select(
        *keep, *(c(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    )
    return out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "word_len": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
    })


def _bucket(v: Column) -> Column:
    """Lower edge of the log-linear bucket: the five leading bits of a value."""
    drop = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(metrics: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch per group and metric."""
    long = metrics.select(
        "lang", "source",
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _bucket(F.col(m)).alias("bucket")) for m in METRICS))).alias("x"),
    )
    return long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles by running counts inside each (bounded) sketch, then the two fences."""
    from pyspark.sql import Window

    by = [*keys, "metric"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*by).orderBy("bucket")
    total = Window.partitionBy(*by)
    t = merged.select(*by, "bucket", F.sum("n").over(run).alias("upto"), F.sum("n").over(total).alias("docs"))
    q = t.groupBy(*by).agg(
        F.max("docs").alias("docs"),
        *(F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)),
    )
    floor = F.element_at(F.create_map(*(F.lit(v) for m, (f, _) in METRICS.items() for v in (m, f))), F.col("metric"))
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), floor)
    return q.groupBy(*keys).agg(
        F.max("docs").alias("docs"),
        *(F.max(F.when(F.col("metric") == m, F.col("q2") + spread)).alias(f"{m}_hi") for m in METRICS),
        *(F.max(F.when(F.col("metric") == m, F.col("q2") - spread)).alias(f"{m}_lo") for m, (_, low) in METRICS.items() if low),
    )


def thresholds(metrics: DataFrame) -> DataFrame:
    """One row per (lang, source); small groups take the fences of their language, then of all."""
    sketch = materialize(sketches(metrics), "sketch")
    cols = [f"{m}_hi" for m in METRICS] + [f"{m}_lo" for m, (_, low) in METRICS.items() if low]
    ren = lambda df, p: df.select(*[c for c in df.columns if c not in cols and c != "docs"], *(F.col(c).alias(f"{p}{c}") for c in ["docs", *cols]))
    own, lang, all_ = (ren(_fences(sketch, k), p) for k, p in ((["lang", "source"], "s_"), (["lang"], "l_"), ([], "a_")))
    lang = lang.withColumnRenamed("lang", "__lang")
    t = own.join(lang, own["lang"].eqNullSafe(lang["__lang"]), "left").drop("__lang")
    corpus = (all_.first() or Row(**dict.fromkeys(all_.columns))).asDict()  # one row
    t = t.withColumns({c: F.lit(v).cast("long") for c, v in corpus.items()})
    pick = lambda c: F.when(F.col("s_docs") >= MIN_GROUP, F.col(f"s_{c}")).when(F.col("l_docs") >= MIN_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return t.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(pick(c).alias(f"__{c}") for c in cols))


def judge(metrics: DataFrame) -> DataFrame:
    """``metrics`` (a materialised ``with_metrics`` table) with the boolean ``kept``."""
    t = materialize(thresholds(metrics), "fences")
    if t.count() <= BROADCAST_ROWS:
        t = F.broadcast(t)
    inside = F.lit(True)
    for m, (_, low) in METRICS.items():
        inside &= F.col(m) <= F.col(f"__{m}_hi")
        if low:
            inside &= F.col(m) >= F.col(f"__{m}_lo")
    joined = metrics.join(t, metrics["lang"].eqNullSafe(t["__lang"]) & metrics["source"].eqNullSafe(t["__source"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(*t.columns)


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(with_metrics(W.documents(spark, sf_dir, "doc_id", "text", "lang", "source")).drop("text"), "metrics")
    return judge(m).select(*COUNTS, "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they came."""
    packed = docs.select(F.col("text"), F.col("lang"), F.col("source"), W.packed(docs.columns).alias("__row"))
    m = materialize(with_metrics(packed).drop("text"), "metrics", "pipeline")
    return judge(m).where("kept").select("__row.*")


def _oracle() -> str:
    hi = " AND ".join(f"{m} <= hi_{m}" for m in METRICS) + " AND word_len >= lo_word_len"
    bucket = lambda m: f"(({m} >> greatest(length(bin({m})) - 5, 0)) << greatest(length(bin({m})) - 5, 0))"
    floor = "CASE metric " + " ".join(f"WHEN '{m}' THEN {f}" for m, (f, _) in METRICS.items()) + " END"
    fence = lambda name, keys: (
        f"{name}_t AS (SELECT {keys}metric, bucket, sum(sum(n)) OVER (PARTITION BY {keys}metric ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY {keys}metric) AS docs FROM sketch GROUP BY {keys}metric, bucket), "
        f"{name}_q AS (SELECT {keys}metric, max(docs) AS docs, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 2) AS q2, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM {name}_t GROUP BY {keys}metric), "
        f"{name} AS (SELECT {keys}max(docs) AS docs, "
        + ", ".join(f"max(q2 + {REACH} * greatest(q3 - q1, {floor})) FILTER (metric = '{m}') AS hi_{m}" for m in METRICS)
        + f", max(q2 - {REACH} * greatest(q3 - q1, {floor})) FILTER (metric = 'word_len') AS lo_word_len FROM {name}_q"
        + (f" GROUP BY {keys.rstrip(', ')}" if keys else "") + ")"
    )
    cols = [f"hi_{m}" for m in METRICS] + ["lo_word_len"]
    pick = ", ".join(f"CASE WHEN s.docs >= {MIN_GROUP} THEN s.{c} WHEN l.docs >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}" for c in cols)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) > 2)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars * {SCALE} // greatest(n_words, 1) AS word_len,
  n_symbols * {SCALE} // greatest(n_words, 1) AS symbols, n_dup_lines * {SCALE} // greatest(n_lines, 1) AS dup_lines, n_repeat_words * {SCALE} // greatest(n_words, 1) AS repeats FROM c),
sketch AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {bucket(m)} AS bucket, count(*) AS n FROM m GROUP BY ALL" for m in METRICS)}),
{fence("s", "lang, source, ")}, {fence("l", "lang, ")}, {fence("a", "")},
f AS (SELECT s.lang, s.source, {pick} FROM s LEFT JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({hi}) AS kept
FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""


ORACLE = _oracle()
