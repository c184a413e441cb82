"""Language identification with bit-sliced Bloom filters of character n-grams.

Training: at most about ``SAMPLE`` labelled documents of each language (chosen by a hash of
the doc_id; the bound is a parameter) give counts of hashed n-grams, summed in Spark. An
n-gram belongs to a language where it makes up at least ``RATE`` of that language's n-grams.
All filters lie in one table: slot i holds a bitmask with one bit for each language, so the
AND of a gram's ``HASHES`` slots gives at once all languages that contain it.

Prediction: every n-gram of the whole text is looked up; each language's hits are counted
by population counts over its bit, corrected for its filter's false-positive rate
(its fill to the power ``HASHES``), and the largest corrected count decides; its share of
all corrected counts is the score. Only the text is an input of a prediction.

Defined results: null text or a text without letters is ``und`` with score 0; ties go to the
first language in code point order; a text whose n-grams no language has gets the language of
most training documents with score 0; with no labelled training rows all is ``und``; a text of
any length is looked up ``CHUNK`` n-grams at a time; repeated rows repeat; empty tables give
none; the query ignores further columns of any name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from millrace.llm import words as W
from millrace.llm.arrow import map_batches

SAMPLE = 2000
SIZES = (2, 3, 4)
RATE = 2e-5
SLOTS = 1 << 20
HASHES = 3
#: Text characters looked up at once.
CHUNK = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case code point where it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def grams(text: str) -> np.ndarray:
    """64-bit names of all n-grams of letters, word boundaries as one space."""
    code = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    letter = code > 0
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter | np.r_[False, letter[:-1]]  # the first gap after a word stays
    code = np.r_[0, code[keep], 0].astype(np.uint64)
    out, name = [], code
    for n in range(2, max(SIZES) + 1):
        name = name[:-1] * _MIX[0] + code[n - 1 :] + np.uint64(1)
        if n in SIZES and len(name):
            inner = np.ones(len(name), bool)
            for k in range(1, n - 1):  # no gap inside, only at an end
                inner &= code[k : k + len(name)] > 0
            out.append(_mix(name[inner] ^ np.uint64(n)))
        if not len(name):
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots_of(names: np.ndarray) -> list[np.ndarray]:
    """Slot of each hash function, by double hashing."""
    step = (names >> np.uint64(40)) | np.uint64(1)
    return [((names + np.uint64(i) * step) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The bit-sliced filters: ``masks[slot]`` has bit l set where language l has the slot."""

    def __init__(self, langs: list[str], words: np.ndarray, common: int = 0):
        self.langs, self.masks, self.common = langs, words, common  # (slots, ceil(langs / 64)) of uint64
        fill = [float(((words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    @classmethod
    def build(cls, langs: list[str], rows: list[tuple[int, np.ndarray]], common: int = 0) -> Filters:
        masks = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
        for i, names in rows:
            for s in slots_of(names):
                masks[s, i // 64] |= np.uint64(1 << (i % 64))
        return cls(langs, masks, common)

    def hits(self, names: np.ndarray) -> np.ndarray:
        """n-grams found in each language, corrected for false positives."""
        count = np.zeros(len(self.langs))
        for at in range(0, len(names), CHUNK):
            a, *rest = slots_of(names[at : at + CHUNK])
            found = self.masks[a]
            for s in rest:
                found &= self.masks[s]
            for i in range(len(self.langs)):
                count[i] += np.count_nonzero(found[:, i // 64] & np.uint64(1 << (i % 64)))
        return np.maximum((count - len(names) * self.false) / np.maximum(1 - self.false, 1e-9), 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        names = grams(text or "")
        if not self.langs or not has_letter(text):
            return "und", 0.0
        c = self.hits(names)
        total = c.sum()
        if total <= 0:
            return self.langs[self.common], 0.0
        i = int(np.argmax(c))
        return self.langs[i], float(min(1.0, c[i] / total))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _gram_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        by.setdefault(lang, []).append(grams(text or ""))
    lang, gram, n = [], [], []
    for k, parts in by.items():
        u, c = np.unique(np.concatenate(parts), return_counts=True)
        lang += [k] * len(u)
        gram.append(u.view(np.int64))
        n.append(c)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(cat(gram)), pa.array(cat(n))], ["lang", "gram", "n"])


def fit(labelled: DataFrame) -> Filters:
    """Filters from (doc_id, lang, text) rows with a language."""
    labelled = labelled.where("lang is not null")
    docs = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(docs)
    if not langs:
        return Filters([], np.zeros((1, 1), np.uint64))
    common = max(range(len(langs)), key=lambda i: (docs[langs[i]], -i))
    share = F.element_at(F.create_map(*(F.lit(v) for k in langs for v in (k, min(1.0, SAMPLE / docs[k])))), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    counts = map_batches(chosen.select("lang", "text"), _gram_batch, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return Filters(langs, np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64), common)
    least = F.element_at(F.create_map(*(F.lit(v) for k, t in total.items() for v in (k, max(2.0, RATE * t)))), F.col("lang"))
    kept = counts.where(F.col("n") >= least).select("lang", "gram").toPandas()  # at most 1 / RATE rows a language
    rows = [(langs.index(k), g["gram"].to_numpy().view(np.uint64)) for k, g in kept.groupby("lang")]
    return Filters.build(langs, rows, common)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns but text, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = shared.value
        got = [f.predict(t) for t in batch.column("text").to_pylist()]
        rest = [n for n in batch.schema.names if n != "text"]
        return pa.RecordBatch.from_arrays(
            [*batch.select(rest).columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
            [*rest, "lang_pred", "score"],
        )

    rest = [f for f in docs.schema.fields if f.name != "text"]
    return map_batches(docs, run, StructType([*rest, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.documents(spark, sf_dir, "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    filters = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
