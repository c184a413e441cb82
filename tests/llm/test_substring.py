import hashlib
import random

import numpy as np

from millrace.llm import substring


def brute(docs):
    """(doc_id, n_words, n_removed, sha) of each (doc_id, text) row."""
    words = [(d, (t or "").encode().split()) for d, t in docs]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    bits = [[rng.choice("abcde") for _ in range(rng.randint(5, 60))] for _ in range(8)]
    docs = [(None, None), (1, None), (2, ""), (3, "a " * 40), (4, "a " * 30 + "b"), (5, "b " + "a\t" * 25), (5, "a " * 14), (None, "a " * 40)]
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(bits) if rng.random() < 0.6 else [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))]
        docs.append((10 + i, " ".join(parts)))
    return docs + [docs[-1]]


def test_matches_brute_force(spark):
    for seed in range(2):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = [tuple(r) for r in substring.dedup(df).collect()]
        key = lambda r: tuple(map(str, r))
        assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_anchor_depends_on_the_window_alone():
    """Every window gets the same anchor wherever it lies."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        window = rng.integers(0, 4, 13).astype(np.uint64)
        seen = set()
        for _ in range(4):
            a, b = rng.integers(0, 4, rng.integers(0, 20)), rng.integers(0, 4, rng.integers(0, 20))
            names = substring.mix(np.r_[a, window, b].astype(np.uint64) + np.uint64(1))
            anchor, _, p, n = substring.anchors(names, np.array([0, len(names)]))
            seen.add(int(anchor[np.searchsorted(p, len(a), "right") - 1]))
        assert len(seen) == 1


def test_long_run_of_one_word(spark):
    """A run of more windows than one packed range counts is removed whole."""
    n = 1_200_012
    df = spark.createDataFrame([(1, "a " * n), (2, "a " * n)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.dedup(df).collect()}
    assert got == {1: (n, 0), 2: (n, n)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup(df).count() == 0


def test_words_that_differ_inside(spark):
    """Two long words of the same letters, one the other's complement, are two words."""
    rest = " ".join(f"w{i}" for i in range(12))
    for k in (3, 10, 12):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
        b = a.translate(str.maketrans("ab", "ba"))
        docs = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}"), (4, f"x {rest} {b}")]
        got = sorted(tuple(r) for r in substring.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
        assert got == sorted(brute(docs))


def test_names_are_of_whole_words():
    rng = random.Random(6)
    words = list({"".join(rng.choice("abé") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 4095, 4096, 5000]))) for _ in range(300)})
    text = "\t ".join(words)
    one, two, first = substring.word_names([None, text, "", text])
    n = len(words)
    assert first.tolist() == [0, 0, n, n, 2 * n]
    assert len(set(one.tolist())) == len(set(two.tolist())) == n and (one[:n] == one[n:]).all()


def test_long_repeats(spark):
    """Passages of hundreds of words, copies, periodic texts and clashing column names."""
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4)
    passages = [[word() for _ in range(rng.randint(13, 400))] for _ in range(6)] + [["a", "b"] * 90, ["a", "b", "c"] * 70]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += p[a:] if rng.random() < 0.5 else [*p, *(word() for _ in range(rng.randint(0, 30)))]
        docs.append((i // 2, "\n".join(parts)))
    docs += docs[10:20]
    df = spark.createDataFrame([(d, t, 1, "k", 2, "a b") for d, t in docs], "doc_id long, text string, p int, key string, n int, `a b.c` string")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in substring.dedup(df).collect()), key=key) == sorted(brute(docs), key=key)
