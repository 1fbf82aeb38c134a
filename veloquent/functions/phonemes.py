"""Phoneme symbols: maps, normal forms, merging of split sounds, feature distance, alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.functions.udf import let, per_row

GAP = "∅"

# Symbol tables and rules that scores depend on.
SPLITS = {"eɪ": ["e", "ɪ"], "oʊ": ["o", "ʊ"], "aɪ": ["a", "ɪ"], "aʊ": ["a", "ʊ"], "ɔɪ": ["ɔ", "ɪ"], "ɪə": ["ɪ", "ə"], "ʊə": ["ʊ", "ə"]}
RESPELL = [
    ("tɕ", "tʃ"), ("tɕʰ", "tʃ"), ("tʂ", "tʃ"), ("dʑ", "dʒ"), ("ɕ", "ʃ"), ("ʂ", "ʃ"), ("ʐ", "ʒ"), ("ɹ", "r"), ("ɾ", "r"), ("x", "h"), ("y", "j"),
    ("ɴ", "n"), ("ɫ", "l"), ("ɒ", "ɑ"), ("ɤ", "ʌ"),
]
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "EH": "ɛ", "ER": "ɝ", "EY": "eɪ", "F": "f",
    "G": "ɡ", "HH": "h", "IH": "ɪ", "IY": "i", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "OW": "oʊ", "OY": "ɔɪ", "P": "p", "R": "r",
    "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "UH": "ʊ", "UW": "u", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
STRESSED = {"AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"}
MERGES_OVERSPLIT = {("a", "ɪ"): "aɪ", ("e", "ɪ"): "eɪ", ("a", "ʊ"): "aʊ", ("o", "ʊ"): "oʊ", ("ɔ", "ɪ"): "ɔɪ", ("ɪ", "ə"): "ɪə", ("ɛ", "ə"): "ɛə", ("ʊ", "ə"): "ʊə"}
MERGES_CLEAN = {("e", "ɪ"): "eɪ", ("o", "ʊ"): "oʊ", ("a", "ɪ"): "aɪ", ("a", "ʊ"): "aʊ"}
LONE_VOWELS = {"a": "æ", "e": "ɛ", "i": "ɪ", "o": "ɒ", "u": "ʊ"}
OXFORD = {
    "tʃ": "ʧ", "dʒ": "ʤ", "i": "iː", "u": "uː", "ɜ": "ɜː", "e": "eɪ", "o": "oʊ", "a": "aɪ", "ɚ": "ər", "ɝ": "ɜː", "n̩": "n", "m̩": "m", "l̩": "l", "ˈ": "", "ˌ": "", "ː": "",
}
KEEPS_LENGTH = ("i", "u", "ɑ", "ɔ", "ɜ")
# replaced one after another, in this order; symbols that stay as they are have no entry
ESPEAK = [
    ("tS", "ʧ"), ("dZ", "ʤ"), ("N", "ŋ"), ("T", "θ"), ("D", "ð"), ("S", "ʃ"), ("Z", "ʒ"), ("x", "h"), ("?", "ʔ"), ("J", "j"),
    ("@", "ə"), ("3", "ɜ"), ("A", "ɑ"), ("I", "ɪ"), ("O", "ɔ"), ("U", "ʊ"), ("e", "ɛ"), ("o", "ɒ"), ("a", "æ"), ("V", "ʌ"), ("Q", "ɒ"), ("E", "ɛ"),
    ("A:", "ɑː"), ("3:", "əː"), ("i:", "iː"), ("O:", "ɔː"), ("u:", "uː"),
    ("aI", "aɪ"), ("AI", "aɪ"), ("aj", "aɪ"), ("eI", "eɪ"), ("EI", "eɪ"), ("ej", "eɪ"), ("OI", "ɔɪ"), ("oj", "ɔɪ"), ("aU", "aʊ"), ("AU", "aʊ"), ("aw", "aʊ"), ("oU", "oʊ"), ("OU", "oʊ"), ("ow", "oʊ"),
    ("@U", "əʊ"), ("I@", "ɪə"), ("e@", "ɛː"), ("u@", "ʊə"),
    ("ɐ", "æ"), ("ɚ", "ər"), ("uu", "u"), ("ii", "i"), ("oo", "o"), ("aa", "a"), ("ee", "e"), ("r=", "ər"), ("l=", "l"), ("n=", "n"), ("m=", "m"),
    ("'", ""), (",", ""), (":", ""),
]
KNOWN = {
    "b", "ʧ", "d", "ð", "f", "g", "h", "ʤ", "k", "l", "m", "n", "ŋ", "p", "r", "s", "ʃ", "t", "θ", "v", "w", "j", "z", "ʒ",
    "ɛ", "ə", "ɪ", "i", "ʊ", "ɑ", "ɔ", "æ", "u", "a", "ɒ", "ʌ", "ɑː", "ɛː", "əː", "iː", "ɔː", "uː", "aʊ", "eɪ", "ɔɪ", "aɪ", "oʊ", "ʌɪ", "əʊ", "ɪə", "ʊə",
}
SILENCE = {"<unk>", "<sil>", "<spn>", ""}
ALIASES = [
    {"h", GAP}, {"ə", "ʌ", "ɐ", "ɑ", "a"}, {"ɜ", "ɚ", "ɝ", "ər", "ɜː", "ʊ", "u", "uː"}, {"o", "oʊ", "əʊ", "ɔ", "ɔː", "oː", "ə"}, {"e", "eɪ", "ɛ", "eː"}, {"i", "iː", "ɪ"},
    {"aɪ", "ɑɪ", "ai"}, {"aʊ", "ɑʊ", "au"}, {"p", "pʰ", "b"}, {"t", "tʰ", "d", "ɾ"}, {"k", "kʰ", "g"}, {"v", "b"}, {"f", "p"},
]
SYMBOLS = {"ɝ": "ɚ", "ɛr": "ɛ", "ʊr": "ʊ", "ur": "u", "ər": "ə"}
#: vowels: height, backness, rounding
VOWELS = {
    "i": ("high", "front", "no"),
    "ɪ": ("near-high", "front", "no"),
    "e": ("mid", "front", "no"),
    "ɛ": ("open-mid", "front", "no"),
    "æ": ("near-open", "front", "no"),
    "a": ("open", "front", "no"),
    "ɑ": ("open", "back", "no"),
    "ɒ": ("open", "back", "yes"),
    "ɔ": ("open-mid", "back", "yes"),
    "o": ("mid", "back", "yes"),
    "u": ("high", "back", "yes"),
    "ʊ": ("near-high", "back", "yes"),
    "ə": ("mid", "central", "no"),
    "ɜ": ("mid", "central", "no"),
    "ʌ": ("open-mid", "central", "no"),
    "ɚ": ("mid", "central", "no"),
    "ɝ": ("mid", "central", "no"),
    "eɪ": ("mid", "front", "no"),
    "aɪ": ("open", "front", "no"),
    "oʊ": ("mid", "back", "yes"),
    "aʊ": ("open", "back", "yes"),
    "ɔɪ": ("open-mid", "back", "yes"),
    "ᵻ": ("mid", "central", "no"),
}
#: consonants: place, manner, voice
CONSONANTS = {
    "p": ("bilabial", "plosive", "no"),
    "b": ("bilabial", "plosive", "yes"),
    "m": ("bilabial", "nasal", "yes"),
    "f": ("labiodental", "fricative", "no"),
    "v": ("labiodental", "fricative", "yes"),
    "w": ("labial-velar", "approximant", "yes"),
    "t": ("alveolar", "plosive", "no"),
    "d": ("alveolar", "plosive", "yes"),
    "n": ("alveolar", "nasal", "yes"),
    "s": ("alveolar", "fricative", "no"),
    "z": ("alveolar", "fricative", "yes"),
    "l": ("alveolar", "lateral", "yes"),
    "r": ("alveolar", "approximant", "yes"),
    "ɹ": ("alveolar", "approximant", "yes"),
    "θ": ("dental", "fricative", "no"),
    "ð": ("dental", "fricative", "yes"),
    "ʃ": ("postalveolar", "fricative", "no"),
    "ʒ": ("postalveolar", "fricative", "yes"),
    "tʃ": ("postalveolar", "affricate", "no"),
    "dʒ": ("postalveolar", "affricate", "yes"),
    "j": ("palatal", "approximant", "yes"),
    "k": ("velar", "plosive", "no"),
    "g": ("velar", "plosive", "yes"),
    "ŋ": ("velar", "nasal", "yes"),
    "h": ("glottal", "fricative", "no"),
}
FILLER_SOUNDS = {
    ("ʌ", "m"): "um", ("ə", "m"): "um", ("ʊ", "m"): "um", ("a", "m"): "um", ("h", "ə", "m"): "hmm", ("h", "m"): "hmm", ("m", "m"): "hmm", ("ɚ", "r"): "er", ("ə", "r"): "er",
    ("ʌ",): "uh", ("ə",): "uh", ("a",): "ah",
}
STOPS = {"t", "d", "k", "g", "p", "b"}
NEIGHBOUR_CONSONANTS = STOPS | {"f", "v", "s", "z", "ʃ", "ʒ", "n", "l", "r", "w", "j", "h", "tʃ", "dʒ"}
DELETED = {"h": 60.0}
GAP_COST = 0.9


_GROUPS: dict[str, set[int]] = {}
for _i, _g in enumerate(ALIASES):
    for _s in _g:
        _GROUPS.setdefault(_s, set()).add(_i)


# -- columns ---------------------------------------------------------------------------------------------------


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def split_diphthongs(seq: Column) -> Column:
    table = F.create_map(*[x for k, v in SPLITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(seq, lambda p: F.coalesce(table[p], F.array(p))))


def from_arpabet(seq: Column) -> Column:
    """ARPABET with or without stress digits as IPA; unknown symbols are dropped."""
    table = _map(ARPABET)
    return F.array_compact(F.transform(seq, lambda p: table[F.regexp_replace(F.upper(F.trim(p)), "[0-9]$", "")]))


def to_arpabet(seq: Column) -> Column:
    table = _map({v: k for k, v in reversed(ARPABET.items())})
    return F.array_compact(F.transform(seq, lambda p: table[p]))


def without_repeats(seq: Column) -> Column:
    return let(seq, lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(xs, i - 1))))


def has_repeats(seq: Column) -> Column:
    return F.size(without_repeats(seq)) < F.size(seq)


def without_silence(seq: Column) -> Column:
    return F.filter(F.transform(seq, lambda p: F.trim(p)), lambda p: ~p.isin(*sorted(SILENCE)))


def to_oxford(seq: Column) -> Column:
    table = _map(OXFORD)

    def one(p: Column) -> Column:
        q = F.trim(p)
        base = F.left(q, F.greatest(F.length(q) - 1, F.lit(0)))
        short = F.when(q.endswith("ː"), base).otherwise(q)
        return F.when(q.endswith("ː") & base.isin(*KEEPS_LENGTH), q).otherwise(F.coalesce(table[short], short))

    return F.transform(seq, one)


def from_espeak(seq: Column) -> Column:
    """Replacements one after another in their order, so that early ones can hide later ones."""

    def one(p: Column) -> Column:
        for a, b in ESPEAK:
            p = F.replace(p, F.lit(a), F.lit(b))
        return p

    return F.transform(seq, one)


def only_known(seq: Column) -> Column:
    """Known symbols; a lone other vowel letter becomes schwa, a lone other letter stays, the rest goes."""
    known = sorted(KNOWN)

    def one(p: Column) -> Column:
        lone = F.length(p) == 1
        return F.when(p.isin(*known), p).when(lone & p.isin("a", "e", "i", "o", "u"), "ə").when(lone & p.rlike(r"^\p{L}$"), p)

    return F.array_compact(F.transform(seq, one))


def coverage(expected: Column, recognized: Column) -> Column:
    return F.size(recognized) / F.greatest(F.size(expected), F.lit(1))


def _pairwise(seq: Column, joint, alone=None, swallows=None) -> Column:
    """A sequence read from the left with one symbol held back: ``joint(held, next)`` takes the place of both if it is
    not null, and ``swallows(held, next)`` lets the held one stand for both; else the held one goes out as ``alone``."""
    alone = alone or (lambda p: p)
    nothing = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), nothing.alias("held"))

    def step(acc: Column, q: Column) -> Column:
        held, pair = acc["held"], joint(acc["held"], q)
        moved = F.struct(F.array_append(acc["out"], alone(held)).alias("out"), q.alias("held"))
        x = F.when(held.isNull(), F.struct(acc["out"].alias("out"), q.alias("held"))).when(pair.isNotNull(), F.struct(F.array_append(acc["out"], pair).alias("out"), nothing.alias("held")))
        if swallows is not None:
            x = x.when(swallows(held, q), F.struct(F.array_append(acc["out"], alone(held)).alias("out"), nothing.alias("held")))
        return x.otherwise(moved)

    last = lambda acc: F.when(acc["held"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], alone(acc["held"])))
    return F.aggregate(F.coalesce(seq, F.array().cast("array<string>")), start, step, last)


def _pair_in(pairs: dict[tuple[str, str], str]):
    table = _map({f"{a}\t{b}": c for (a, b), c in pairs.items()})
    return lambda a, b: table[F.concat(a, F.lit("\t"), b)]


def joined(seq: Column) -> Column:
    """Repeats removed, then split diphthongs joined from the left."""
    return _pairwise(without_repeats(seq), _pair_in(MERGES_OVERSPLIT))


def rebuilt(seq: Column) -> Column:
    """Split diphthongs joined; one already whole (but for aɪ) swallows its own second half if that follows; lone
    vowel letters become the short vowels."""
    whole = lambda p: p.isin([x for x in MERGES_OVERSPLIT.values() if x != "aɪ"])
    table = _map(LONE_VOWELS)
    return _pairwise(seq, _pair_in(MERGES_OVERSPLIT), lambda p: F.coalesce(table[p], p), lambda p, q: whole(p) & (q == F.right(p, F.lit(1))))


def cleaned(seq: Column) -> Column:
    """Pairs joined where both stand side by side, blanks dropped, then repeats removed."""
    return without_repeats(F.filter(_pairwise(seq, _pair_in(MERGES_CLEAN)), lambda p: F.trim(p) != ""))


# -- sequences ----------------------------------------------------------------------------------------------------


@lru_cache(1 << 14)
def _normal(p: str) -> str:
    q = "".join(c for c in unicodedata.normalize("NFD", p) if not unicodedata.combining(c) and c not in "ːˑ")
    for a, b in RESPELL:
        q = q.replace(a, b)
    return q


def normal_ipa(seq: list[str] | None, split: bool = True) -> list[str]:
    """Symbols without marks and length, respelled in order; diphthongs split first unless asked not to."""
    parts = (q for p in seq or [] for q in (SPLITS.get(p, (p,)) if split else (p,)))
    return [q for q in map(_normal, parts) if q]


def filler_sounds(seq: list[str] | None) -> list[dict]:
    """Fillers heard in a sequence: longest pattern first, consumed on a hit; places are three characters a sound."""
    seq, out, i = seq or [], [], 0
    while i < len(seq):
        for k in (3, 2, 1):
            part = tuple(seq[i : i + k])
            if len(part) == k and part in FILLER_SOUNDS and _alone(seq, i, k):
                word = FILLER_SOUNDS[part]
                out.append({"text": word, "start_index": 3 * i, "end_index": 3 * i + len(word), "phonemes": "/".join(part)})
                i += k
                break
        else:
            i += 1
    return out


def _alone(seq: list[str], i: int, k: int) -> bool:
    n = len(seq)
    if k > 1:
        return seq[i + k - 1] != "r" or i < 3 or n - (i + k) < 3
    if seq[i] not in ("ʌ", "ə"):
        return False
    if i == 0 or i == n - 1:
        return True
    before, after = seq[i - 1], seq[i + 1]
    if before in STOPS and after in NEIGHBOUR_CONSONANTS:
        return True
    if before in NEIGHBOUR_CONSONANTS and after in NEIGHBOUR_CONSONANTS and min(i, 2) + min(n - 1 - i, 2) < 3:
        return True
    return n > 8 and min(i, 3) + min(n - 1 - i, 3) < 6


@lru_cache(1 << 16)
def distance(a: str, b: str) -> float:
    """0 for equals, 0.05 within an alias group, else one less the share of common features."""
    if a == b:
        return 0.0
    if _GROUPS.get(a, set()) & _GROUPS.get(b, set()):
        return 0.05
    x, y = SYMBOLS.get(a, a), SYMBOLS.get(b, b)
    for table, base, weights, most in ((VOWELS, 0.35, (0.25, 0.25, 0.10), 0.98), (CONSONANTS, 0.30, (0.30, 0.30, 0.10), 0.95)):
        if x in table and y in table:
            s = base
            for same, w in zip(map(str.__eq__, table[x], table[y]), weights):
                s += w if same else 0.0
            return 1.0 - min(s, most)
    return 1.0 - 0.15


@lru_cache(1 << 16)
def _cost(a: str, b: str) -> float:
    return 1.0 - (1.0 - distance(a, b))


def align(expected: list[str] | None, recognized: list[str] | None) -> dict:
    """Global alignment: the percent score of each expected symbol, and the pairs with ∅ for a gap.

    Ties prefer a match, then a deletion. Symbols recognized before the first expected one are not in the pairs;
    later insertions are, without a score. Short sequences (words) are remembered, as words recur.
    """
    e, r = tuple(expected or ()), tuple(recognized or ())
    pairs = _short(e, r) if len(e) + len(r) <= 24 else _pairs(e, r)
    return {"scores": [s for _, _, s in pairs if s is not None], "pairs": [{"expected": a, "recognized": b, "score": s} for a, b, s in pairs]}


def _pairs(e: tuple[str, ...], r: tuple[str, ...]) -> list[tuple]:
    if e == r:  # all matches cost nothing, and ties prefer them
        return [(p, p, 100.0) for p in e]
    m = len(r)
    above = [0.0]
    for _ in r:
        above.append(above[-1] - GAP_COST)
    moves = []
    for p in e:
        corner, left = above[0], above[0] - GAP_COST
        row, move = [left], ["d"]
        for q, up in zip(r, above[1:]):
            best, step = corner - _cost(p, q), "m"
            if up - GAP_COST > best:
                best, step = up - GAP_COST, "d"
            if left - GAP_COST > best:
                best, step = left - GAP_COST, "i"
            row.append(best)
            move.append(step)
            corner, left = up, best
        moves.append(move)
        above = row
    pairs, i, j = [], len(e), m
    while i > 0:
        step = moves[i - 1][j]
        if step == "m":
            i, j = i - 1, j - 1
            pairs.append((e[i], r[j], (1.0 - distance(e[i], r[j])) * 100.0))
        elif step == "d":
            i -= 1
            pairs.append((e[i], GAP, DELETED.get(e[i], 0.0)))
        else:
            j -= 1
            pairs.append((GAP, r[j], None))
    pairs.reverse()
    return pairs


_short = lru_cache(1 << 15)(_pairs)


def shown(pairs: list[dict]) -> list[dict]:
    """Pairs as scored symbols: gaps on either side score 0, an inserted symbol under its own label."""
    return [{"ipa_label": p["recognized"] if p["expected"] == GAP else p["expected"], "phoneme_score": 0.0 if GAP in (p["expected"], p["recognized"]) else p["score"]} for p in pairs]


#: one sound per spelling, longest first; a stand-in for a pronunciation lexicon, which is an input where there is one
SPELLINGS = {
    "igh": ["aɪ"], "tch": ["tʃ"], "sh": ["ʃ"], "ch": ["tʃ"], "th": ["θ"], "ph": ["f"], "ng": ["ŋ"], "ee": ["i"], "ea": ["i"], "oo": ["u"], "ou": ["aʊ"], "ow": ["oʊ"], "ai": ["eɪ"],
    "ay": ["eɪ"], "oi": ["ɔɪ"], "oy": ["ɔɪ"], "ck": ["k"], "qu": ["k", "w"], "wh": ["w"], "a": ["æ"], "b": ["b"], "c": ["k"], "d": ["d"], "e": ["ɛ"], "f": ["f"], "g": ["g"], "h": ["h"],
    "i": ["ɪ"], "j": ["dʒ"], "k": ["k"], "l": ["l"], "m": ["m"], "n": ["n"], "o": ["ɒ"], "p": ["p"], "r": ["r"], "s": ["s"], "t": ["t"], "u": ["ʌ"], "v": ["v"], "w": ["w"], "x": ["k", "s"],
    "y": ["j"], "z": ["z"],
}
_SPELLING = re.compile("|".join(SPELLINGS))


def sounds(word: str | None, known: Sequence[str] | None = None) -> list[str]:
    """A word's symbols: those a lexicon gives (``known``), else letter by letter."""
    if known is not None and len(known):
        return list(known)
    return [s for m in _SPELLING.finditer((word or "").lower()) for s in SPELLINGS[m.group()]]


def dictionary_line(word: str, known: Sequence[str] | None = None) -> str | None:
    """A word with its ARPABET symbols, vowels marked unstressed; null if none is known."""
    back = {v: k for k, v in reversed(ARPABET.items())}
    found = []
    for s in normal_ipa(sounds(word, known), split=False):
        found += [back[x] for x in ([s] if s in back else s if len(s) > 1 else []) if x in back]
    return f"{word}\t{' '.join(a + '0' * (a in STRESSED) for a in found)}" if found else None


def distance_table(spark: SparkSession) -> DataFrame:
    """(a, b, distance) over the symbols with features or aliases: a fixed, small inventory."""
    symbols = sorted({*VOWELS, *CONSONANTS, *_GROUPS} - {GAP})
    return spark.createDataFrame([(a, b, distance(a, b)) for a in symbols for b in symbols], "a string, b string, distance double")


PAIRS = "array<struct<expected:string,recognized:string,score:double>>"
align_udf = per_row(align, f"struct<scores:array<double>,pairs:{PAIRS}>")
normal_udf = per_row(normal_ipa, "array<string>")
normal_whole_udf = per_row(lambda s: normal_ipa(s, split=False), "array<string>")
filler_udf = per_row(filler_sounds, "array<struct<text:string,start_index:int,end_index:int,phonemes:string>>")
sounds_udf = per_row(sounds, "array<string>")
dictionary_udf = per_row(dictionary_line, "string")
