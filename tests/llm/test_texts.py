"""Token encoding, packing and look-alike classes against public encoders and brute force."""

import random
import string
import unicodedata
from itertools import combinations

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from veloquent.llm import lexicon, lookalike, packing, tokens

NASTY = ["", None, " ", "\n\n  \t", "a", "the the the", "naïve café 日本語 ありがとう 🙂👩‍🏫", "x" * 5000, "<|endoftext|> text", "don't we'll I'M 123 4.5", " " * 3000 + "end", "\u0000​﻿", "é" * 999, "ab" * 4000 + " " + "!?" * 2000]


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=tokens.pattern(), mergeable_ranks=tokens.read_ranks("byte_bpe_50k"), special_tokens={})


def test_encoding_is_exact(spark, public):
    r = random.Random(2)
    texts = NASTY + ["".join(r.choice(string.printable + "äß日€🙂 ") for _ in range(r.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {x["doc_id"]: x["ids"] for x in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {x["doc_id"]: x["n_tokens"] for x in tokens.encode(df, "doc_id", "text", lengths_only=True).collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert public.decode(got[6]) == texts[6]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_other_vocabulary(spark):
    other = tiktoken.Encoding("other", pat_str=tokens.pattern(), mergeable_ranks=tokens.read_ranks("byte_bpe_multi_50k"), special_tokens={})
    df = spark.createDataFrame([(1, "Guten Tag, 世界! Привет")], "doc_id long, text string")
    assert tokens.encode(df, "doc_id", "text", "byte_bpe_multi_50k").first()["ids"] == other.encode_ordinary("Guten Tag, 世界! Привет")


def test_merging_breaks_ties_from_the_left():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300, b"aab": 301, b"ab": 302}
    assert tokens.merge(b"aaab", ranks) == [300, 302]
    assert tokens.merge(b"aab", ranks) == [301] and tokens.merge(b"aaaa", ranks) == [300, 300]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_automaton_holds_exactly_its_words(tmp_path_factory, words, others):
    path = str(tmp_path_factory.mktemp("lex") / "l.bin")
    words = list(words)
    out = [[i, i + 1] for i in range(len(words))]
    lexicon.write(path, words, out, {})
    lex = lexicon.Lexicon(path)
    assert [lex.output(p) for p in lex.places(words).tolist()] == out
    assert [p >= 0 for p in lex.places(others).tolist()] == [o in set(words) for o in others]


def test_automaton_is_minimal():
    b = lexicon.Builder()
    for w in sorted(s + e for s in (b"walk", b"talk", b"bak") for e in (b"ed", b"ing", b"s")):
        b.add(w)
    states = len(b.finish()["final"])
    right = set()
    words = {s + e for s in (b"walk", b"talk", b"bak") for e in (b"ed", b"ing", b"s")}
    for w in words:
        for i in range(len(w) + 1):
            right.add(frozenset(x[i:] for x in words if x.startswith(w[:i])))
    assert states == len(right)
    with pytest.raises(ValueError):
        b.add(b"a")


SIZES = "item_id long, size int, container string"
CAPS = "name string, capacity int"


def pack(spark, sizes, caps, **kw):
    items = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], SIZES)
    return packing.pack(items, spark.createDataFrame(caps, CAPS), **kw).collect()


@pytest.mark.parametrize("shard", [10_000, 60])
def test_packing_keeps_everything(spark, shard):
    r = random.Random(6)
    sizes = [r.choice([None, 0, 1, 64, 100, 128, 129, 1000, r.randint(1, 300), r.randint(1, 40)]) for _ in range(400)]
    got = pack(spark, sizes, [("s", 128), ("m", 512), ("none", None), ("bad", 0)], shard_rows=shard)
    for name, cap in (("s", 128), ("m", 512)):
        mine = [g for g in got if g["name"] == name]
        load = {}
        for g in mine:
            load[g["container"]] = load.get(g["container"], 0) + g["tokens"]
        assert max(load.values()) <= cap and load["empty"] == 0
        for i, s in enumerate(sizes):
            parts = sorted((g["piece"], g["start"], g["tokens"]) for g in mine if g["item_id"] == i)
            assert sum(p[2] for p in parts) == (s or 0) and [p[0] for p in parts] == list(range(len(parts)))
            assert len(parts) == max(1, -(-(s or 0) // cap)) and all(p[1] == p[0] * cap for p in parts)
        used = len([c for c in load if c != "empty"])
        assert used <= 1.1 * sum(s or 0 for s in sizes) / cap + (1 if shard > 400 else 8)
    assert {g["name"] for g in got} == {"s", "m"}


def test_sum_of_squares_rule():
    b = packing.SumOfSquares(10)
    r = random.Random(1)
    counts = {}
    for _ in range(300):
        s = r.randint(1, 10)
        before = {g: int(n) for g, n in enumerate(b.count) if n}

        def after(g):
            c = dict(before)
            if g < 10:
                c[g] -= 1
            if g - s:
                c[g - s] = c.get(g - s, 0) + 1
            return sum(v * v for v in c.values())

        least = min(after(g) for g in [*(g for g in before if g >= s), 10])
        bin_ = b.place(s)
        counts[bin_] = counts.get(bin_, 0) + s
        assert sum(int(v) ** 2 for v in b.count) == least
    assert max(counts.values()) <= 10
    assert pytest.approx(sum(counts.values())) == sum(10 - g for g, n in enumerate(b.count) for _ in range(n)) + 10 * (b.made - int(b.count.sum()))


def test_many_items_leave_little_unused():
    r = random.Random(9)
    shard, full, total = packing.Shard(128), 0, 0
    for i in range(20_000):
        size = min(128, 1 + int(r.expovariate(1 / 30)))
        total += size
        full += len({x[0] for x in shard.add((i, 0, 0, size))})
    rest = shard.rest()
    assert full + len({x[0] for x in rest}) <= 1.003 * total / 128 + 1
    loads = {}
    for name, *_, size in rest:
        loads[name] = loads.get(name, 0) + size
    assert max(loads.values()) <= 128


def test_packing_nothing(spark):
    assert pack(spark, [], [("s", 128)]) == [] and pack(spark, [5], []) == []


LOOK = [
    ["Full moon", "Ｆull　moon", "Ful​l moon", "Full moon", "Fu­ll mооn", "F⁠ull mοon"],
    ["café", "café", "cаfe​́", "ｃａｆé"],
    ["ế", "ế", "ế", "е̂́"],
    ["ẹ́x", "ẹ́x", "ẹ́x"],
    ["ё", "ё", "ë"],
    ["ガ", "ガ", "ｶﾞ"],
    ["office fin flat", "oﬃce ﬁn ﬂat"],
    ["Kelvin", "Kelvin", "Кelvin"],
    ["bridge", "briԁɡe"],
    ["👩‍🏫 hi", "👩‍🏫 hі"],
    ["Mix VII", "Ⅿix Ⅶ", "Ⅿⅰⅹ ⅤⅡ", "𝐌ix 𝖵II", "Ꮇiх VII"],
    ["Zebra", "Ꮓebra", "ꓜebra"],
    ["noun", "ոoսո", "nⲟun"],
]
DIFFER = ["full moon", "Full  moon", "Full\nmoon", "cafe", "l1I", "lII", "O0", "OO", "2", "²", "①", "1", "'", "’", '"', "”", "-", "–", "...", "…", "👩🏫 hi", "x", "×", "𝟐", "ß", "B", "в", "θ"]


def test_classes_and_rewriting(spark):
    texts = [t for g in LOOK for t in g] + DIFFER
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = {x["text"]: x["canonical"] for x in lookalike.canonical(df, "doc_id", "text").collect()}
    forms = [{c[t] for t in g} for g in LOOK] + [{c[t]} for t in DIFFER]
    assert all(len(f) == 1 for f in forms), [f for f in forms if len(f) > 1]
    assert len({next(iter(f)) for f in forms}) == len(forms)
    again = lookalike.Rewriter(lookalike.rules(df, "text"))
    assert all(again(again(t)) == again(t) for t in texts)


def test_representative_is_the_most_frequent(spark):
    df = spark.createDataFrame([(1, "о" * 9 + "o")], "doc_id long, text string")
    assert lookalike.canonical(df, "doc_id", "text").first()["canonical"] == "о" * 10


def test_pairs(spark):
    docs = [(i, t) for i, t in enumerate([t for g in LOOK for t in g] + DIFFER)]
    docs += [(1000 + i, "Full moon") for i in range(60)]  # a class held by copies of one text
    docs += [(2000, None), (2001, ""), (2002, "​"), (2003, " "), (2004, " ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, c int")
    got = sorted(map(tuple, lookalike.pairs(df, "doc_id", "text").collect()))
    group = {t: n for n, g in enumerate(LOOK) for t in g}
    want = sorted((a[0], b[0]) for a, b in combinations(sorted(d for d in docs if d[1] in group), 2) if a[1] != b[1] and group[a[1]] == group[b[1]])
    assert got == want
    assert sorted(map(tuple, lookalike.pairs(df, "doc_id", "text", chunk=7).collect())) == want  # texts in several chunks
    members = {m["doc_id"]: m for m in lookalike.members(df, "doc_id", "text").collect()}
    assert {x for p in want for x in p} == set(members)
    assert all(members[a]["class_id"] == members[b]["class_id"] <= a for a, b in want)
    moon = members[0]
    assert (moon["class_id"], moon["n_texts"], moon["n_documents"]) == (0, len(set(LOOK[0])), len(LOOK[0]) + 60)
    assert lookalike.pairs(df.limit(0), "doc_id", "text").count() == lookalike.members(df.limit(0), "doc_id", "text").count() == 0


def test_a_class_of_two_much_copied_texts_is_spread(spark):
    n = 2_000
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Full moon").otherwise("Ｆull moon").alias("text"))
    found = lookalike.pairs(df, "doc_id", "text", chunk=100)
    assert found.count() == n * n
    placed = lookalike.forms(df, "doc_id", "text").groupBy("c", "t", F.pmod(F.xxhash64("id"), F.lit(20)).alias("i")).count().agg(F.max("count")).first()[0]
    assert placed < 200


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeoаео̣́̂̈​‍fiﬁ éёế ａ", max_size=12))
def test_rewriting_settles_whatever_the_order(text):
    rules = lookalike.representatives(lookalike.classes(set("aeoаео̣́̂̈​‍fiﬁ éёế ａ")), {})
    r = lookalike.Rewriter(rules)
    assert r(text) == r(unicodedata.normalize("NFD", text)) == r(r(text))
