"""Every query on a small table of hard cases, against brute force; and on empty tables."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from millrace.llm import chat, langid, media, mixing, packing, pii, quality, simhash, substring, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names clash with what operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fp long, rid long, size long, row string, base string, c string"


def texts():
    rng = random.Random(5)
    vocab = {"en": "the of and river stone house water light morning with under".split(), "fr": "le la de et rivière pierre maison eau lumière matin avec".split()}
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        words = [rng.choice(vocab[lang]) + (str(rng.randint(0, 99)) if rng.random() < 0.1 else "") for _ in range(rng.randint(55, 120))]
        rows.append((i, " ".join(words), lang, f"s{i % 3}" if i % 7 else "s0"))
    rows += [(200, rows[4][1], "en", "s0"), (201, rows[4][1] + " end", "en", "s0"), (202, None, None, None), (203, "", "en", None), (204, " \n\t", "en", "s1")]
    rows += [(205, "one two", "en", "s1"), (206, "x" * 5000 + " " + "word " * 6000, "en", "s2"), (207, "\n".join(["same line again"] * 40), "en", "s0"), (208, "12345 !!!", None, "s0")]
    rows += [(209, "mail a@b.co or +1 (555) 123-4567 at 10.0.0.1 card 4111 1111 1111 1111 <|endoftext|>  two\u0085spaces", "en", "s0"), (None, "no id here " * 30, "en", "s1"), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


def save(spark, folder, rows, schema=SCHEMA):
    full = [(*r, len(r[1] or ""), 1, True, 2, 3, 4, "r", "b", "c") for r in rows]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "http://a.COM/en/x", None), (1, "http://a.COM/en/x", None), (2, None, None), (3, "no scheme", None), (4, "http://casino.example.io/poker", None), (5, "http://x.org/porn", None)], "page_id long, url string, verdict string").write.parquet(f"{folder}/pages.parquet")
    talk = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|x <|y"), (1, 1, "assistant", None), (None, 0, None, "z"), (2, None, "a\nb\\", ""), (2, 3, "assistant", "ok" * 9000)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows):
    return save(spark, tmp_path_factory.mktemp("sf"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return con.execute(sql).fetchall()


def test_quality_matches_sql(spark, sf):
    got = quality.query(spark, sf)
    assert got.columns == [*quality.COUNTS, "kept"]
    same(got.collect(), duck(sf, quality.ORACLE))


def test_urls_match_sql(spark, sf):
    got = urls.query(spark, sf)
    same(got.collect(), duck(sf, urls.ORACLE))
    verdict = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    assert verdict == {1: ("com/en/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "block"), 5: (None, "block")}


def test_chat_matches_sql(spark, sf):
    same(chat.query(spark, sf).collect(), duck(sf, chat.ORACLE))


def test_chat_layouts_and_escapes():
    for record in ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"prompt": "a", "response": "b"}, {"instruction": "a", "output": "b"}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}):
        assert chat.turns(record) == [("user", "a"), ("assistant", "b")]
    with pytest.raises(chat.UnknownLayout):
        chat.turns({"foo": 1})
    rng = random.Random(0)
    for _ in range(3000):
        said = [("".join(rng.choice("a<|\\>\n") for _ in range(rng.randint(0, 6))), "".join(rng.choice(["<", "|", "\\", ">", "\n", chat.START, chat.END, "x"]) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        assert chat.parse(chat.render(said)[0]) == said


def test_media(spark, sf, rows):
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    got = media.query(spark, sf)
    same(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect(), want)
    by = got.groupBy("payload_sha256").agg({"media_sha256": "collect_set", "feature": "collect_set"}).collect()
    assert all(len(r[1]) == len(r[2]) == 1 for r in by)


def test_packing(spark, sf, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(d, []).append(ids)
    got = packing.query(spark, sf).collect()
    for d, docs in want.items():
        for r in (r for r in got if r["doc_id"] == d):
            crc = {zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in docs}
            assert r["ids_crc32"] in crc
        assert sum(r["length"] for r in got if r["doc_id"] == d) == sum(map(len, docs))
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(seq) <= -(-total // 2048) * 1.02 + 1


def test_added_tokens_keep_their_id():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: np.frombuffer(packing.token_bytes(t), "<u4").tolist()
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275, 1]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>  y z", "<|endoftext|", "one two  three <|endoftext|>\n"):
        assert ids(text) == [*tok.encode(text, add_special_tokens=False).ids, 1]


def test_ids_are_the_tokenizers():
    """Whole texts by the library itself: every kind of white space, long runs, contractions, odd characters."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u3000", "\ufeff", "'s", "'ll", "don't", "word", "Ünï", "99", "!?", "日本", "😀", "\x00"]
    long = [" " * 1_000_000 + "a", "x" * 200_000, "1" * 50_000 + " ", "\n" * 5000, "ab " * 50_000]
    for text in ["", *long, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(4000))]:
        assert np.frombuffer(packing.token_bytes(text), "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]


def test_cutting_stock_covers_demand():
    rng = random.Random(1)
    for _ in range(5):
        demand = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(20)}
        plan = packing.solve(demand, 100)
        have = {}
        for pattern, copies in plan:
            assert sum(s * n for s, n in pattern.items()) <= 100
            for s, n in pattern.items():
                have[s] = have.get(s, 0) + n * copies
        assert have == demand


def brute_simhash(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = WORD.findall(t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, ids):
    n = len(fps)
    label = list(range(n))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def test_simhash(spark, sf, rows):
    fps = [brute_simhash(t) for _, t, *_ in rows]
    comp = components(fps, [r[0] for r in rows])
    same(simhash.query(spark, sf).collect(), [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)])


def test_cells_lose_no_link(spark, monkeypatch):
    """Dense near copies, with cells so small that all are divided again."""
    rng = random.Random(2)
    monkeypatch.setattr(simhash, "CELL", 4)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(df, "doc_id").collect()}
    assert [got[s] for s in signed] == components(fps, list(range(len(fps))))


def test_mixing(spark, sf, rows):
    got = mixing.query(spark, sf).collect()
    sizes = {}
    for d, t, _, s in rows:
        sizes.setdefault((d, s), []).append(len(WORD.findall(t or "")))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), n) for (d, _), ns in sizes.items() for n in ns)
    total = sum(r["size"] for r in got)
    assert sum({r["source_size"]: r["target"] for r in got}.values()) == pytest.approx(total)
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source_size"]] = per.get(r["source_size"], 0) + r["taken"]
    for size, target in {r["source_size"]: r["target"] for r in got}.items():
        assert abs(per[size] - target) <= mixing.BLOCK
    same(mixing.query(spark, sf).collect(), got)


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 100]) == pytest.approx([50, 100, 150])
    out = mixing.targets([1000, 10, 20])
    assert out[1] == 30 and out[2] == 60 and sum(out) == pytest.approx(1030)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def brute_pii(t):
    t = t or ""
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m[0])) <= 15]


def test_pii(spark, sf, rows):
    want = [(r[0], hashlib.sha256(",".join("%s:%d:%d" % s for s in brute_pii(r[1])).encode()).hexdigest()) for r in rows]
    got = pii.query(spark, sf)
    same(got.select("doc_id", "base_sha256").collect(), want)
    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice("0019 .-+()@a.b%1 2") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(s) == brute_pii(s)


def test_pii_long_texts():
    """Long runs of digits, dots, signs and letters end, with the contract's spans."""
    for t in ("1" * 5000 + ".1.1.1", "0" * 5000 + "1.2.3.4", "1." * 20_000, "+1" * 20_000, "a@b" * 20_000, "1 " * 20_000, "x1-" * 20_000):
        small = t[:3000]
        assert pii.base_spans(small) == brute_pii_padded(small)
        pii.candidates(t, pii.base_spans(t))
    t = "call +1 555 010 1234 or " * 20_000 + "id EMP-20394"
    assert len(pii.candidates(t, pii.base_spans(t))) == 20_000 + 2


def brute_pii_padded(t):
    out = []
    for kind, a, b in brute_pii_all(t):
        if kind != "ip" or all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in t[a:b].split(".")):
            out.append((kind, a, b))
    return out


def brute_pii_all(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m[0])) <= 15]


def test_pii_graph_against_brute_force(spark):
    """Trusted patterns of random graphs, by the definition."""
    found = 0
    for seed in range(3):
        rng = random.Random(seed)
        near = lambda p: 2 * (p // 3) + rng.randint(0, 14)  # noqa: E731  patterns overlap in a chain
        edges = [(f"p{p}", f"i{i}", i < 15) for p in (rng.randint(0, 17) for _ in range(2500)) for i in [near(p)]]
        seeds = {i for _, i, s in edges if s}
        graph: dict[str, set[str]] = {}
        for p, i, _ in edges:
            graph.setdefault(p, set()).add(i)
        known, trusted = set(seeds), set()
        for _ in range(pii.ROUNDS):
            trusted = {p for p, x in graph.items() if len(x & known) >= pii.SUPPORT and len(x & known) / (len(x) + pii.PRIOR) >= pii.CONFIDENCE}
            known = seeds.union(*(graph[p] for p in trusted))
        df = spark.createDataFrame(edges, "pattern string, instance string, seed boolean")
        assert {r["pattern"] for r in pii.accepted_patterns(df).collect()} == trusted
        found += len(trusted)
    assert found > 3


def test_pii_bootstraps_contexts(spark):
    """Tokens that only share a context with seeds are found; a mixed context is not trusted."""
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'note api key = "{secret()}" end') for i in range(30)] + [(100, 'note api key = "00aa11bb22cc33dd44ee" end')]
    rows += [(200 + i, f"part number {rng.randint(10**6, 10**7)}") for i in range(30)] + [(i, f"part number {secret()}") for i in range(300, 303)]
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "rid long, doc_id long, text string")
    extra = {r["doc_id"] for r in pii.find(df).where("extra is not null").collect()}
    assert 100 in extra and set(range(30)) <= extra and not extra & set(range(200, 303))


def test_pii_contexts_reach_other_shapes(spark):
    """Base matches seed contexts, and instances found there lead to further shapes."""
    rows = [(i, f"employee badge: +1 555 010 {1000 + i}") for i in range(60)]
    rows += [(100 + i, f"employee badge: EMP-{20390 + i}") for i in range(12)] + [(200 + i, f"holder of pass EMP-{20390 + i}") for i in range(12)]
    rows += [(300, "holder of pass X1234567")] + [(400 + i, f"part number is {10**6 + i}") for i in range(20)]
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "rid long, doc_id long, text string")
    extra = {r["doc_id"]: [(s["a"], s["b"]) for s in r["extra"]] for r in pii.find(df).where("extra is not null").collect()}
    assert set(extra) == {*range(100, 112), *range(200, 212), 300}
    assert extra[100] == [(16, 25)] and extra[300] == [(15, 23)]


def test_language(spark, sf, rows):
    got = langid.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, *_ in rows if d == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100]
    assert sum(r["lang_pred"] == ("en" if r["doc_id"] % 3 else "fr") for r in held) / len(held) > 0.95


def test_filters_estimate():
    langs = ["a", "b"]
    rng = np.random.default_rng(0)
    a, b = (langid._mix(rng.integers(0, 1 << 62, 50_000).astype(np.uint64)) for _ in langs)
    f = langid.Filters.build(langs, [(0, a), (1, b)])
    assert f.hits(a)[0] == pytest.approx(50_000, rel=0.01) and abs(f.hits(a)[1]) < 200


def test_filters_against_exact_sets():
    """Corrected counts of over 64 languages against the sets themselves."""
    rng = np.random.default_rng(1)
    langs = [f"l{i:02}" for i in range(70)]
    sets = [langid._mix(rng.integers(0, 1 << 62, 3000).astype(np.uint64)) for _ in langs]
    f = langid.Filters.build(langs, list(enumerate(sets)))
    text = np.concatenate([sets[3][:500], sets[66][:900], langid._mix(rng.integers(0, 1 << 62, 4000).astype(np.uint64))])
    exact = [np.isin(text, s).sum() for s in sets]
    assert np.abs(f.hits(text) - exact).max() < 5


def test_language_ties_and_no_evidence(spark):
    rows = [(i, "b" if i % 2 else "a", "stone house river") for i in range(40)] + [(100 + i, "c", "zzz yyy") for i in range(60)]
    f = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert f.predict("river house")[0] == "a"  # a and b tie: the first in code point order
    assert f.predict("\U00031350\U000323af") == ("c", 0.0)  # letters that no language has: the most frequent one
    assert f.predict("12 !?") == ("und", 0.0) and f.predict(None) == ("und", 0.0)


def test_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Foo", True), ("bar", False), ("baz", False), ("bar", False), (None, True), ("", True)], "term string, strict boolean")
    words = urls.vocabulary(table)
    assert words == (("foo",), ("bar", "baz"))
    pages = spark.createDataFrame([(1, "http://x.io/FOO"), (2, "http://x.io/bar"), (3, "http://bar.io/baz/bar"), (4, "http://x.io/foobar"), (5, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, vocabulary=words).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    with pytest.raises(ValueError):
        urls.vocabulary(table, most=3)


def test_records_of_many_layouts(spark):
    """Records of different layouts in one table become the same conversation."""
    said = [("user", "a <|im_end|>"), ("assistant", "b\\n")]
    records = [{"messages": [{"role": r, "content": t} for r, t in said]}, {"prompt": said[0][1], "response": said[1][1]}, {"instruction": said[0][1], "output": said[1][1]}, {"conversations": [{"from": f, "value": t} for f, (_, t) in zip(("human", "gpt"), said)]}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, json.dumps({"odd": 1})), (10, None), (11, "{")]
    got = {r["id"]: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert len({got[i]["schema"] for i in range(4)}) == 4
    for i in range(4):
        r = got[i]
        assert chat.parse(r["formatted"]) == said and [chat.unescape(r["formatted"][m["a"] : m["b"]]) for m in r["mask"]] == [said[1][1]]
    assert all(got[i]["formatted"] is None and got[i]["mask"] is None for i in (9, 10, 11)) and got[9]["schema"] is not None and got[10]["schema"] is None


def test_reader_finds_turns_in_any_pieces():
    """The reader gets the output in pieces that ignore turns."""
    rng = random.Random(3)
    for _ in range(300):
        said = [(rng.choice(["user", "a\nb", "", "<|x"]), "".join(rng.choice(["<", "|", "\\", chat.START, chat.END, "\n", "x"]) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        whole, at, reader, got = chat.render(said)[0], 0, chat.Reader(), []
        while at < len(whole):
            n = rng.randint(1, 40)
            got += reader.feed(whole[at : at + n])
            at += n
        assert got == said and reader.rest == ""


@pytest.mark.parametrize("op", [quality, media, substring, packing, simhash, chat, mixing, urls, pii, langid])
def test_empty_tables(spark, empty, op):
    assert op.query(spark, empty).count() == (1 if op is chat else 0)
