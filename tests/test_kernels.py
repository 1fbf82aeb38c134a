"""Sequence kernels: worked cases, and properties by hypothesis."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veloquent.functions import phonemes as P
from veloquent.functions import lexicon, scoring, sequence, signal, text

SYMBOLS = ["i", "ɪ", "ə", "ʌ", "h", "t", "d", "s", "ʃ", "tʃ", "ʧ", "g", "ɡ", "?", "oʊ"]
seqs = st.lists(st.sampled_from(SYMBOLS), max_size=9)


def test_distance_values():
    assert P.distance("t", "t") == 0.0 and P.distance("t", "d") == 0.05
    assert P.distance("g", "ɡ") == pytest.approx(0.85) and P.distance("ʧ", "tʃ") == pytest.approx(0.85)
    assert P.distance("s", "i") == pytest.approx(0.85)
    assert P.distance("s", "z") == pytest.approx(1 - 0.9)
    assert P.distance("ɝ", "ɚ") == 0.05


def test_alignment_cases():
    assert P.align([], ["t"]) == {"scores": [], "pairs": []}
    assert P.align(["h", "t"], []) == {"scores": [60.0, 0.0], "pairs": [{"expected": "h", "recognized": "∅", "score": 60.0}, {"expected": "t", "recognized": "∅", "score": 0.0}]}
    lead = P.align(["t"], ["s", "i", "t"])  # what is heard before the first expected sound is not in the pairs
    assert lead["pairs"] == [{"expected": "t", "recognized": "t", "score": 100.0}]
    tail = P.align(["t"], ["t", "i"])
    assert tail["pairs"][-1] == {"expected": "∅", "recognized": "i", "score": None} and tail["scores"] == [100.0]
    assert P.align(["t"], ["d"])["scores"] == [95.0]
    assert P.shown(tail["pairs"]) == [{"ipa_label": "t", "phoneme_score": 100.0}, {"ipa_label": "i", "phoneme_score": 0.0}]


def best_cost(e, r):
    from functools import lru_cache

    @lru_cache(None)
    def f(i, j):
        if i == 0 or j == 0:
            return 0.9 * (i + j)
        return min(f(i - 1, j - 1) + P.distance(e[i - 1], r[j - 1]), f(i - 1, j) + 0.9, f(i, j - 1) + 0.9)

    return f(len(e), len(r))


@settings(max_examples=300, deadline=None)
@given(seqs, seqs)
def test_alignment_is_optimal_and_in_order(e, r):
    a = P.align(e, r)
    if not e:
        return
    assert [p["expected"] for p in a["pairs"] if p["expected"] != "∅"] == e
    said = [p["recognized"] for p in a["pairs"] if p["recognized"] != "∅"]
    assert said == r[len(r) - len(said) :] and len(a["scores"]) == len(e)
    cost = 0.9 * (len(r) - len(said))
    for p in a["pairs"]:
        cost += 0.9 if "∅" in (p["expected"], p["recognized"]) else P.distance(p["expected"], p["recognized"])
    assert cost == pytest.approx(best_cost(tuple(e), tuple(r)))


def in_spark(spark, f, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, seq array<string>")
    return [r["x"] for r in df.select("i", f(F.col("seq")).alias("x")).orderBy("i").collect()]


def merged(seq, pairs):
    out, i = [], 0
    while i < len(seq):
        hit = pairs.get(tuple(seq[i : i + 2]))
        out.append(hit or seq[i])
        i += 2 if hit else 1
    return out


def plain_rebuilt(seq):
    out, i = [], 0
    while i < len(seq):
        following = seq[i + 1] if i + 1 < len(seq) else None
        pair = P.MERGES_OVERSPLIT.get((seq[i], following))
        if pair:
            out.append(pair)
            i += 2
        elif seq[i] in P.MERGES_OVERSPLIT.values() and seq[i] != "aɪ":
            out.append(seq[i])
            i += 1 + (following == seq[i][-1])
        else:
            out.append(P.LONE_VOWELS.get(seq[i], seq[i]))
            i += 1
    return out


def test_merges_by_brute_force(spark):
    assert in_spark(spark, P.joined, [["a", "a", "ɪ", "t", "t"], [], None]) == [["aɪ", "t"], [], []]
    assert in_spark(spark, P.rebuilt, [["eɪ", "ɪ", "a", "aɪ", "ɪ", "o"], []]) == [["eɪ", "æ", "aɪ", "ɪ", "ɒ"], []]
    assert in_spark(spark, P.cleaned, [["", "e", "ɪ", " ", "t", "t"]]) == [["eɪ", "t"]]
    r = random.Random(11)
    lists = [[r.choice(["a", "ɪ", "e", "ʊ", "o", "ə", "eɪ", "aʊ", "aɪ", "ɛ", "ɔ", "t", "", " "]) for _ in range(r.randint(0, 12))] for _ in range(400)]
    single = lambda xs: [x for i, x in enumerate(xs) if i == 0 or x != xs[i - 1]]
    assert in_spark(spark, P.joined, lists) == [merged(single(x), P.MERGES_OVERSPLIT) for x in lists]
    assert in_spark(spark, P.rebuilt, lists) == [plain_rebuilt(x) for x in lists]
    assert in_spark(spark, P.cleaned, lists) == [single([y for y in merged(x, P.MERGES_CLEAN) if y.strip()]) for x in lists]


def test_espeak_symbols(spark):
    cases = {"i:": "iː", "u:": "uː", "i": "i", "u": "u", "A:": "ɑ", "3:": "ɜ", "tS": "ʧ", "dZ": "ʤ", "@": "ə", "aI": "æɪ", "oU": "ɒʊ", "uu": "u", "ii": "i", "oo": "ɒɒ", "r=": "ər", "'t": "t", "n=": "n", "ɚ": "ər", "ɐ": "æ", "?": "ʔ", "p": "p", "": ""}
    assert in_spark(spark, P.from_espeak, [list(cases)]) == [list(cases.values())]


def test_normal_forms():
    assert P.normal_ipa(["eɪ", "ɹ", "ãː", "tɕ"]) == ["e", "ɪ", "r", "a", "tʃ"]
    assert P.normal_ipa(["eɪ"], split=False) == ["eɪ"] and P.normal_ipa(None) == []
    assert [f["text"] for f in P.filler_sounds(["ʌ", "m", "t", "h", "ə", "m"])] == ["um", "hmm"]
    assert P.dictionary_line("cat") == "cat\tK AE0 T" and P.dictionary_line("123") is None


def test_numbers():
    cases = {"0": "zero", "10": "ten", "21": "twenty one", "100": "one hundred", "1005": "one thousand five", "999999": "nine hundred ninety nine thousand nine hundred ninety nine", "1000000": "1000000", "x": "x"}
    assert {k: sequence.number_words(k) for k in cases} == cases
    assert sequence.spoken("21st 2th 20TH 0th 112th at 7 in 1000000") == "twenty first second twentieth zeroth one hundred twelfth at seven in 1000000"
    assert sequence.spoken(None) is None


def test_fillers():
    t = lambda s: [f["text"] for f in sequence.fillers(s)]
    assert t("I was like okay and I like pizza") == ["like"]
    assert t("like um, that") == ["like", "um,"]
    assert t("um uh later um") == ["um", "um"]
    assert t("do you know the answer") == [] and t("you know the answer") == ["you know"] and t("well you know like so") == ["you know"]
    assert t(None) == [] and t("   ") == []
    heard = [{"text": "um", "start_index": 3, "end_index": 5, "phonemes": "ʌ/m"}]
    assert [f["start_index"] for f in sequence.fillers("so um yes", heard)] == [3]


def test_repetitions_and_offsets():
    assert sequence._repetitions(pa.array(["the the, THE cat cat."])).to_pylist()[0] == [
        {"text": "the", "start_index": 0, "end_index": 12, "repeat_count": 3},
        {"text": "cat", "start_index": 13, "end_index": 21, "repeat_count": 2},
    ]
    assert sequence.word_offsets(" a  b ") == [{"word": "a", "start": 0}, {"word": "b", "start": 2}]


words = st.lists(st.sampled_from("a b c A dd".split()), max_size=7)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_word_diff_rebuilds_the_other_text(x, y):
    edits = sequence.word_diff(" ".join(x), " ".join(y))
    changed = {(e["position"], e["type"]) for e in edits}
    assert all(0 <= p <= len(x) for p, _ in changed)
    gone = sum(e["type"] == "deletion" for e in edits)
    new = sum(e["type"] == "addition" for e in edits)
    assert len(x) - gone + new == len(y)
    if not edits:
        assert [w.lower() for w in x] == [w.lower() for w in y]
    marked = sequence.tagged(" ".join(x), edits)
    assert marked.count("<grammar-mistake") <= len(edits)


def test_tagged():
    edits = sequence.word_diff("I has cat", "I have a cat")
    assert sequence.tagged("I has cat", edits) == 'I <grammar-mistake correction="have">has</grammar-mistake> <grammar-mistake correction="a">...</grammar-mistake> cat'
    assert sequence.tagged(None, edits) is None and sequence.tagged("x", []) == "x"


def test_scores_of_words():
    same = scoring.score_words("the cat", "The cat")
    assert [w["word_score"] for w in same] == [100.0, 100.0]
    missing = scoring.score_words("the cat", "the")
    assert missing[1]["word_score"] == 0.0 and [p["ipa_label"] for p in missing[1]["phonemes"]] == ["k", "æ", "t"]
    read = scoring.score_words("the cat", "the dog", True)
    assert read[1]["word_score"] == 10.0 and read[0]["word_score"] == 100.0
    pair = scoring.score_words("bat", "pat")
    assert pair[0]["word_score"] == pytest.approx((95 + 100 + 100) / 3)
    assert scoring.score_words(None, "x") == []


def test_scores_of_recordings():
    s = scoring.score_transcript(["at", "it"], [["æ", "t"], ["ɪ", "t"]], ["æ", "t", "s", "ɪ", "d"])
    assert [[p["ipa_label"] for p in w["phonemes"]] for w in s] == [["æ", "t", "s"], ["ɪ", "t"]]
    assert [w["word_score"] for w in s] == [pytest.approx(200 / 3), pytest.approx(97.5)]
    assert [w["word_score"] for w in scoring.score_transcript(["at"], [["æ", "t"]], ["æ"])] == [92.0]
    assert [w["word_score"] for w in scoring.score_transcript(["at"], [["æ", "t"]], [])] == [85.0]
    u = scoring.score_utterance("sit mat", "mat", ["s", "ɪ", "t", "m", "æ", "t"])
    # the missing word leaves its scores to the next one
    assert [w["word_score"] for w in u] == [0.0, 100.0] and [p["phoneme_score"] for p in u[1]["phonemes"]] == [100.0] * 3
    assert scoring.score_utterance("mat", "mat", ["s"], [["m", "æ", "d"]])[0]["word_score"] == pytest.approx(295 / 3)
    assert scoring.score_utterance("mat", "mat", ["s"], None)[0]["word_score"] == 0.0
    assert scoring.score_utterance("mat", "mat", [], None, [77.0])[0]["word_score"] == 77.0
    assert scoring.speech_rate("um well yes", 1.0) == 120.0 and scoring.speech_rate("x", 0) == 0.0 and scoring.speech_rate(None, 5.0) == 0.0


def test_gate_moves_forward_only():
    g = scoring.lexical_gate("cat dogs sat cat", "cat dog sat")
    assert [w["heard_at"] for w in g] == [0, 1, 2, None]
    assert SequenceMatcher(None, "dogs", "dog").ratio() < 0.9


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    seq = lambda *xs: F.array(*map(F.lit, xs))
    assert get(P.split_diphthongs(seq("t", "aɪ"))) == ["t", "a", "ɪ"]
    assert get(P.from_arpabet(seq("EY1", " g ", "??"))) == ["eɪ", "ɡ"]
    assert get(P.to_oxford(seq("iː", "sː", "tʃ", "a", "x"))) == ["iː", "s", "ʧ", "aɪ", "x"]
    assert get(P.from_espeak(seq("tS", "aI", "u:"))) == ["ʧ", "æɪ", "uː"]
    assert get(P.only_known(seq("t", "e", "qq", "q"))) == ["t", "ə", "q"]
    assert get(P.without_repeats(seq("t", "t", "a", "t"))) == ["t", "a", "t"] and get(P.has_repeats(seq("t", "a"))) is False
    assert get(P.without_silence(seq("<sil>", "t ", ""))) == ["t"]
    assert get(text.tokens(F.lit("x' can't 17th --"))) == ["x'", "can't", "17th"]
    assert get(text.variants(F.lit("berries"))) == ["berries", "berry", "berri", "berrie"]
    assert get(text.without_tag(F.lit('a <mark class="a">b</mark>\n c'))) == "a b c"
    assert get(text.truncated(F.lit(""))) is None and get(text.truncated(F.lit("x" * 2000))) == "x" * 1000
    assert get(text.fluency_score(F.lit(160.0), F.lit(0), F.lit(0))) == 7.0 and get(text.fluency_score(F.lit(None), F.lit(9), F.lit(9))) == 2.0
    assert get(signal.cosine_percent(seq(0.0, 0.0), seq(1.0, 0.0))) is None
    assert get(signal.peak_normalized(seq(0.0, 0.0))) == [0.0, 0.0]
    bounds = get(signal.segment_bounds(F.lit(5.0), F.lit(5.0), F.lit(80000)))
    assert (bounds["from"], bounds["to"]) == (79200, 80000)


@pytest.mark.parametrize("n", [0, 9, 10, 14, 15, 19, 20, 29, 30, 49, 50, 74, 75, 119, 120, 179, 180])
def test_band_cuts(spark, n):
    s = spark.createDataFrame([(" ".join(["word"] * n),)], "t string")
    b = s.select(*[c.alias(k) for k, c in text.band_scores(F.col("t"), F.lit(n)).items()]).first()
    task = [2, 3, 3.5, 4, 5][sum(n >= c for c in (10, 20, 30, 50))] + (n >= 75) + (n >= 120) + 0.5 * (n >= 180)
    assert b["task"] == task and b["grammar"] == [3, 4, 5, 5.5][sum(n >= c for c in (15, 30, 50))] + (1.5 if 15 <= n <= 25 else 1.0 if 10 <= n <= 30 else 0)
    assert b["coherence"] == [2.5, 3, 4, 5][sum(n >= c for c in (15, 30, 50))]


def plain_repetitions(text):
    words = sequence.word_offsets((text or "").lower())
    out, i = [], 0
    while i < len(words):
        j = i + 1
        while j < len(words) and words[j]["word"].strip(".,!?") == words[i]["word"].strip(".,!?"):
            j += 1
        if j - i > 1:
            out.append({"text": words[i]["word"].strip(".,!?"), "start_index": words[i]["start"], "end_index": words[j - 1]["start"] + len(words[j - 1]["word"]), "repeat_count": j - i})
        i = j
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAb.! \t\n\u00a0\x1c\x85🙂é", max_size=25), max_size=6))
def test_batches_of_words_as_one_by_one(texts):
    arrow = pa.array(texts, pa.string())
    assert sequence._offsets(arrow).to_pylist() == [sequence.word_offsets(t) for t in texts]
    assert sequence._repetitions(arrow).to_pylist() == [plain_repetitions(t) for t in texts]


def test_scores_follow_the_lexicon(spark):
    lex = spark.createDataFrame([("Tough", ["t", "ʌ", "f"]), ("tough", ["t", "ʌ", "f", "x"]), ("dough", ["d", "oʊ"]), (None, ["x"]), ("the", []), ("unused", ["j"])], "word string, sounds array<string>")
    rows = spark.createDataFrame([(1, "Tough the dough", "tough the tuff", "c"), (2, None, "dough", "c"), (3, "", None, "c"), (4, "plain", "plain", "c")], "id int, expected string, said string, word string")
    words = {"es": text.tokens(F.col("expected")), "ss": F.when(F.col("said").isNotNull(), text.tokens(F.col("said")))}
    few = sorted(map(str, lexicon.with_sounds(rows, "id", words, lex).collect()))
    assert few == sorted(map(str, lexicon.with_sounds(rows, "id", words, lex, most=1).select("id", "expected", "said", "word", "es", "ss").collect()))
    one = {r["id"]: r for r in lexicon.with_sounds(rows, "id", words, lex).collect()}
    assert one[1]["es"] == [["t", "ʌ", "f"], None, ["d", "oʊ"]] and one[1]["ss"] == [["t", "ʌ", "f"], None, None]
    assert one[2]["es"] == [] and one[3]["ss"] is None and one[4]["es"] == [None]
    by = scoring.score_words("Tough the dough", "tough the dough", False, one[1]["es"], one[1]["es"])
    assert [p["ipa_label"] for p in by[0]["phonemes"]] == ["t", "ʌ", "f"] and [p["ipa_label"] for p in by[1]["phonemes"]] == ["θ", "ɛ"]
    assert [p["ipa_label"] for p in scoring.score_words("dough", "dough")[0]["phonemes"]] == ["d", "a", "ʊ", "g", "h"]
    u = scoring.score_utterance("tough", "tough", ["t", "ʌ", "f"], None, None, [["t", "ʌ", "f"]])
    assert u[0]["word_score"] == 100.0
    assert P.dictionary_line("dough", ["d", "oʊ"]) == "dough\tD OW0"


def test_the_observed_lexicon_takes_the_most_frequent(spark):
    df = spark.createDataFrame([("a", ["x"]), ("A", ["y"]), ("a", ["y"]), ("b", ["q"]), ("b", ["p"]), ("c", []), (None, ["x"]), ("d", None)], "word string, sounds array<string>")
    assert sorted(map(tuple, lexicon.observed(df).collect())) == [("a", ["y"], 2), ("b", ["p"], 1)]


def test_pauses_in_speech():
    rate, loud = 1000, 0.5 * np.sin(np.arange(3000))
    x = np.concatenate([loud, np.zeros(2500), loud, np.zeros(500), loud, np.zeros(4000)])
    got = signal.speech_pauses(x, rate, frame=200, hop=50)
    assert len(got) == 1 and got[0]["duration"] == pytest.approx(2.5, abs=0.3) and got[0]["start_index"] == got[0]["end_index"] == pytest.approx(3000 * 0.05, abs=8)
    assert signal.speech_pauses(None) == signal.speech_pauses([]) == signal.speech_pauses(np.zeros(5000), rate) == signal.speech_pauses(loud, rate) == []


def test_words_beyond_the_alignment_get_equal_parts(spark):
    known = F.array(F.struct(F.lit(0.2).alias("start"), F.lit(0.9).alias("end")))
    get = lambda c: [tuple(x) for x in spark.range(1).select(c.alias("x")).first()["x"]]
    assert get(signal.word_spans(known, F.lit(3), F.lit(6.0))) == [(0.2, 0.9), (2.0, 4.0), (4.0, 6.0)]
    assert get(signal.word_spans(F.lit(None).cast("array<struct<start:double,end:double>>"), F.lit(2), F.lit(1.0))) == [(0.0, 0.5), (0.5, 1.0)]
    assert get(signal.word_spans(known, F.lit(0), F.lit(1.0))) == []


def test_words_keep_their_place_without_phones(spark):
    from veloquent.operators import intervals

    words = [("f", "hi", 0.0, 1.0), ("f", "there", 1.0, 2.0), ("f", "sil", 2.0, 3.0), ("f", "", 3.0, 4.0), ("g", "alone", 0.0, 500.0), ("f", None, 0.0, 1.0)]
    phones = [("f", "IY", 0.5, 1.00005), ("f", "HH", 0.0, 0.5), ("f", "sp", 0.5, 0.6), ("f", "x", 0.9, 1.2), ("g", None, 1.0, 2.0)]
    schema = "file string, label string, start double, end double"
    got = intervals.words_with_phones(spark.createDataFrame(words, schema), spark.createDataFrame(phones, schema), "file").collect()
    assert sorted((g["file"], g["label"], [p["label"] for p in g["phones"]]) for g in got) == [("f", "hi", ["HH", "IY"]), ("f", "there", []), ("g", "alone", [])]
