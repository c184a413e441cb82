"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule fits its host and all subdomains where the path starts with the rule's path; the
longest fitting rule decides. Every other url is searched once by an automaton over strict
and soft terms; a hit counts where no ASCII letter or digit touches it. One strict hit or
``SOFT_HITS`` distinct soft terms reject.

The vocabulary is a parameter: ``vocabulary`` reads one from a table of terms, and the terms
below are the query's own.

Defined results: a null url, or one without ``://``, has empty host and path and fits no
rule; a null url has no terms and is allowed; of rules of one length the first listed decides;
a url of any length is searched once; further columns of any name are ignored; repeated rows and
empty tables work.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.arrow import map_batches

# The rules of the contract (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# The query's vocabulary, lower case.
STRICT = (
    "porn", "porno", "pornstar", "xxx", "hentai", "escort", "escorts", "camgirl", "camgirls", "camsex", "milf", "nsfw", "sexcam", "xvideos", "bdsm",
    "warez", "keygen", "cracked", "serialz", "viagra", "cialis", "levitra", "xanax", "oxycontin", "steroids",
)
SOFT = (
    "adult", "sex", "sexy", "nude", "naked", "erotic", "fetish", "lingerie", "webcam", "hookup", "dating", "singles", "casino", "poker", "betting", "bet", "slots", "roulette", "blackjack",
    "jackpot", "lottery", "gambling", "loan", "loans", "payday", "credit", "refinance", "forex", "binary", "bitcoin", "torrent", "crack", "serial", "nulled", "proxy", "pills", "pharmacy",
    "weightloss", "diet", "replica", "cheap", "discount", "free", "win", "prize", "download", "clickbait", "gossip",
)
SOFT_HITS = 2
#: Terms that every worker gets at most.
MOST = 1_000_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the contract cuts them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[cut:]
    end = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return rest[:cut].translate(_LOWER), tail[:end]


class Rules:
    """Rules by host; a lookup walks the host's suffixes, so its cost is the number of labels."""

    def __init__(self, rules=RULES):
        self.by: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        best = None
        at = host
        while at:
            for p, verdict in self.by.get(at, ()):
                if path.startswith(p) and (best is None or len(at) + len(p) > len(best[0])):
                    best = (at + p, verdict)
            at = at.partition(".")[2]
        return best


def vocabulary(table: DataFrame, most: int = MOST) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a table with term and strict (null: soft); A-Z are lower-cased.

    A table of over ``most`` terms is refused, since each worker gets all of them.
    """
    rows = table.where("term <> ''").select("term", "strict").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has over {most} terms")
    return tuple(tuple(sorted({r["term"].translate(_LOWER) for r in rows if bool(r["strict"]) == strict})) for strict in (True, False))


@cache
def automaton(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((True, strict), (False, soft)):
        for t in terms:
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(url: str | None, strict=STRICT, soft=SOFT) -> tuple[int, int]:
    """(strict hits, distinct soft terms) with boundary checks."""
    low = (url or "").translate(_LOWER)
    n, seen = 0, set()
    for end, (term, weight) in automaton(strict, soft).iter(low):
        start = end - len(term)
        if (start >= 0 and _word(low[start])) or (end + 1 < len(low) and _word(low[end + 1])):
            continue
        if weight:
            n += 1
        else:
            seen.add(term)
    return n, len(seen)


def judge(pages: DataFrame, rules=RULES, vocabulary: tuple[tuple[str, ...], tuple[str, ...]] = (STRICT, SOFT)) -> DataFrame:
    """page_id, host, path, rule, verdict and the hit counts of every url."""
    table, words = Rules(rules), pages.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            strict, soft = term_hits(url, *words.value)
            rule, verdict = table.find(host, path) or (None, "block" if strict or soft >= SOFT_HITS else "allow")
            rows.append((host, path, rule, verdict, strict, soft))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms"],
        )

    schema = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_terms long"
    return map_batches(pages.selectExpr("cast(page_id as bigint) page_id", "url"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    hit = lambda t: rf"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " + ".join(rf"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t in STRICT)
    soft = " + ".join(f"{hit(t)}::INT" for t in SOFT)
    fits = "(h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path)"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT *, translate(url, '{upper}', '{lower}') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM s),
r(verdict, host, path) AS (VALUES {rules}),
best AS (SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM h JOIN r ON {fits} GROUP BY rid),
t AS (SELECT *, ({strict})::BIGINT AS strict_hits, ({soft})::BIGINT AS soft_terms FROM h)
SELECT page_id, t.host, t.path, rule, coalesce(verdict, CASE WHEN strict_hits > 0 OR soft_terms >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_terms
FROM t LEFT JOIN best USING (rid)
"""


ORACLE = _oracle()
