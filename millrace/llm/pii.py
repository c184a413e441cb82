"""PII spans: fixed patterns, and contextual patterns bootstrapped from them.

Base kinds follow fixed expressions; whatever fails its check is dropped. Every other
token that looks like an identifier is a candidate instance. It has two patterns: its lexical
context (the three words or marks before it), which instances of any shape share, and the same
context with its shape. Seed entities are the tokens of ``SEEDS`` and the base matches, which
enter the graph with their lexical contexts as known instances. Spark scores the
pattern-instance graph for ``ROUNDS`` rounds: a pattern's confidence is the share of its
distinct instances that are known, shrunk by ``PRIOR``; instances of patterns with at least
``SUPPORT`` known instances and ``CONFIDENCE`` become known, and so on. Candidates in the
final high-confidence patterns are returned as kind ``ctx``; base spans stay as they are,
and a candidate that overlaps one is never added.

Defined results: null text is empty; repeated rows return repeated rows; ties do not arise
(a pattern is trusted or not); texts of any length are scanned once, in time linear in their
length, and their spans are one row; further columns of any name are kept by the stage, ignored
by the query; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.arrow import map_batches
from millrace.plans.durable import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.8
PRIOR = 1.0

# The contract's expressions, and the shapes that seed the bootstrap.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Groups are possessive and begin a run of digits: no other start or end can match, and long runs cost no square.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every numeric match lies inside one of these runs, which start where a match can start.
NUMERIC = re.compile(r"[0-9+][0-9\x20().+-]{6,}")
#: Candidate identifiers: a token of letters and digits with at least three digits.
TOKEN = re.compile(r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,80}(?![A-Za-z0-9_@])")
SEEDS = re.compile(r"[0-9a-f]{32,64}\Z|[0-9]{3}-[0-9]{2}-[0-9]{4}\Z|(?:sk|pk|ghp|AKIA)[_-]?[A-Za-z0-9]{16,}\Z")
CONTEXT = re.compile(r"[^\W\d_]+|[^\w\s]")
#: Characters before a candidate in which its context lies.
REACH = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: the local part is the run before an @ with a domain."""
    out: list[tuple[int, int]] = []
    if "@" not in text:
        return out
    for m in DOMAIN.finditer(text):
        floor, a = (out[-1][1] if out else 0), m.start()
        while a > floor and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    ip, card, phone = [], [], []
    for run in NUMERIC.finditer(text):
        a, b = run.span()
        for m in IP.finditer(text, a, b):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                ip.append(("ip", *m.span()))
        for m in CARD.finditer(text, a, b):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                card.append(("card", *m.span()))
        for m in PHONE.finditer(text, a, b):
            if 8 <= len(_digits(m[0])) <= 15:
                phone.append(("phone", *m.span()))
    return [*(("email", a, b) for a, b in emails(text)), *ip, *card, *phone]


def shape(token: str) -> str:
    """The token's character classes in order, runs merged."""
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in token))[:12]


def _context(text: str, a: int) -> str:
    return " ".join(CONTEXT.findall(text[max(0, a - REACH) : a].lower())[-3:])


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int | None, int | None, str, str, bool]]:
    """(start, end, pattern, instance, seed) of identifier-like tokens outside base spans, each under
    both its patterns; base matches come without a place, as seeds of their contexts alone."""
    out = []
    taken: list[list[int]] = []  # unions of overlapping base spans, in order
    for _, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
            continue
        taken.append([a, b])
        if before := _context(text, a):
            out.append((None, None, before, text[a:b], True))
    at = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if sum(c.isdigit() for c in m[0]) < 3 or (at < len(taken) and taken[at][0] < b):
            continue
        before = _context(text, a)
        if not before:
            continue
        seed = bool(SEEDS.match(m[0]))
        kind = "hex" if re.fullmatch(r"[0-9a-f]+", m[0]) and len(m[0]) >= 16 else shape(m[0])
        out += [(a, b, pattern, m[0], seed) for pattern in (before, f"{before} <{kind}>")]
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))
_CAND = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())]))


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans, cands = [], []
    for text in batch.column("text").to_pylist():
        base = base_spans(text or "")
        spans.append([{"kind": k, "a": a, "b": b} for k, a, b in base])
        cands.append([dict(zip(("a", "b", "pattern", "instance", "seed"), c)) for c in candidates(text or "", base)])
    return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(spans, _SPAN), pa.array(cands, _CAND)], ["rid", "doc_id", "base", "cand"])


SCAN = "rid long, doc_id long, base array<struct<kind:string,a:long,b:long>>, cand array<struct<a:long,b:long,pattern:string,instance:string,seed:boolean>>"


def accepted_patterns(cands: DataFrame, keep_for: str = "call") -> DataFrame:
    """Patterns that the pattern-instance graph trusts after ``ROUNDS`` rounds.

    ``cands`` has pattern, instance, seed. Both sides of the graph are pre-aggregated before
    they meet, so a frequent pattern costs one row for each of its distinct instances.
    """
    graph = materialize(cands.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph", keep_for)
    known = graph.where("seed").select("instance").distinct()
    trusted = None
    for _ in range(ROUNDS):
        marked = graph.join(known.withColumn("known", F.lit(1)), "instance", "left")
        score = marked.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("known", F.lit(0))).alias("hit"))
        trusted = materialize(score.where((F.col("hit") >= SUPPORT) & (F.col("hit") / (F.col("n") + PRIOR) >= CONFIDENCE)).select("pattern"), "trusted", keep_for)
        reached = graph.join(trusted, "pattern", "left_semi").select("instance")
        known = materialize(graph.where("seed").select("instance").union(reached).distinct(), "known", keep_for)
    return trusted


def find(docs: DataFrame, keep_for: str = "call") -> DataFrame:
    """(rid, doc_id, base, extra): the spans of each (rid, doc_id, text) row; rid is unique."""
    scanned = materialize(map_batches(docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, SCAN), "scan", keep_for)
    cands = scanned.where("size(cand) > 0").select("rid", F.explode("cand").alias("c")).select("rid", "c.*")
    hits = cands.where("a is not null").join(accepted_patterns(cands.select("pattern", "instance", "seed"), keep_for), "pattern", "left_semi")
    extra = hits.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("extra"))  # bounded by one text
    return scanned.drop("cand").join(extra, "rid", "left")


def _with_rid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.monotonically_increasing_id())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(_with_rid(W.documents(spark, sf_dir, "doc_id", "text")))
    text = lambda spans: F.array_join(spans, ",")
    base = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string")))
    more = F.transform(F.coalesce("extra", F.array().cast("array<struct<a:bigint,b:bigint>>")), lambda s: F.concat_ws(":", F.lit("ctx"), s["a"].cast("string"), s["b"].cast("string")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.concat(base, more)).alias("spans"))


def _redact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each union of overlapping spans becomes one tag of its first kind."""
    out = []
    for text, base, extra in zip(*(batch.column(n).to_pylist() for n in ("text", "base", "extra"))):
        spans = sorted([(s["a"], s["b"], s["kind"].upper()) for s in base or []] + [(s["a"], s["b"], "ID") for s in extra or []])
        parts, at = [], 0
        for a, b, tag in spans:
            if a >= at:
                parts += [text[at:a], f"[{tag}]"]
            at = max(at, b)
        out.append(text if text is None else "".join([*parts, text[at:]]))
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows, columns as they came, with every span found replaced by its tag."""
    rest = [c for c in docs.columns if c != "text"]
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), "text", W.packed(rest).alias("row")), "rows", "pipeline")
    found = find(rows.select("rid", "doc_id", "text"), "pipeline").where("size(base) > 0 or extra is not null").drop("doc_id")
    joined = rows.join(found, "rid", "left").select("row", "text", "base", "extra")
    return W.unpacked(map_batches(joined, _redact, joined.select("row", "text").schema), docs)
