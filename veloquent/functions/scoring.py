"""Scores of what was said against what was expected, word by word."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

from veloquent.functions import phonemes, sequence
from veloquent.functions.udf import per_row

_TOKEN = re.compile(r"[A-Za-z0-9]+'?[A-Za-z0-9]*")
WORDS = "array<struct<word_text:string,word_score:double,phonemes:array<struct<ipa_label:string,phoneme_score:double>>>>"
READING_SCORE = 10.0


def _mean(xs: list[float]) -> float:
    return sum(xs) / len(xs) if xs else 0.0


@lru_cache(1 << 14)
def _spelled(word: str) -> list[str]:
    return phonemes.normal_ipa(phonemes.sounds(word))


def _sounds(words: list[str], known: list | None) -> list[list[str]]:
    """Each word's normal sounds: a lexicon's, where it has the word, else those of its spelling."""
    known = known or []
    return [phonemes.normal_ipa(known[k]) if k < len(known) and known[k] else _spelled(w) for k, w in enumerate(words)]


def _word(text: str, sounds: list[dict]) -> dict:
    return {"word_text": text, "word_score": _mean([p["phoneme_score"] for p in sounds]), "phonemes": sounds}


def _flat(text: str, symbols: list[str], score: float) -> dict:
    return _word(text, [{"ipa_label": s, "phoneme_score": score} for s in symbols])


def score_words(expected: str | None, said: str | None, reading: bool | None = False, expected_sounds: list | None = None, said_sounds: list | None = None) -> list[dict]:
    """Every expected word with its sounds' scores. Words are matched in order by a word diff.

    Equal words are aligned sound by sound. Within a replaced stretch the pair of the least cost is taken first,
    earlier pairs first among equals, each word once; words left over, and words not said, score 0. For reading
    tasks whose text differs, replaced and missing words score a flat 10 instead. Words said beyond the expected
    ones are not scored. The sounds of both texts' words may come from a lexicon (see ``lexicon.with_sounds``).
    """
    e, s = _TOKEN.findall(expected or ""), _TOKEN.findall(said or "")
    es, ss = _sounds(e, expected_sounds), _sounds(s, said_sounds)
    strict = bool(reading) and (expected or "").lower().strip() != (said or "").lower().strip()
    flat = READING_SCORE if strict else 0.0
    out = []

    def aligned(i: int, j: int) -> dict:
        return _word(e[i], phonemes.shown(phonemes.align(es[i], ss[j])["pairs"]))

    for tag, i1, i2, j1, j2 in SequenceMatcher(a=[w.lower() for w in e], b=[w.lower() for w in s]).get_opcodes():
        if tag == "equal":
            out += [aligned(i1 + k, j1 + k) for k in range(i2 - i1)]
        elif tag == "replace" and not strict:
            costs = sorted((1.0 - _mean(phonemes.align(es[i], ss[j])["scores"]) / 100.0, i, j) for i in range(i1, i2) for j in range(j1, j2))
            left, free = set(range(i1, i2)), set(range(j1, j2))
            for _, i, j in costs:
                if i in left and j in free:
                    left.discard(i)
                    free.discard(j)
                    out.append(aligned(i, j))
            out += [_flat(e[i], es[i], flat) for i in sorted(left)]
        elif tag in ("replace", "delete"):
            out += [_flat(e[i], es[i], flat) for i in range(i1, i2)]
    return out


def _forms(word: str) -> list[str]:
    cuts = (("ies", 3, 3, "y"), ("es", 2, 2, ""), ("s", 1, 1, ""), ("ed", 2, 2, ""), ("ed", 2, 1, ""), ("ing", 4, 3, ""), ("ing", 4, 3, "e"), ("er", 3, 2, ""))
    forms = [word] + [word[:-n] + add for ending, longer, n, add in cuts if word.endswith(ending) and len(word) > longer]
    return [f for f in dict.fromkeys(forms) if f]


@lru_cache(1 << 16)
def _near(a: str, b: str, least: float) -> bool:
    """Whether the ratio of equal characters reaches ``least``; by length alone where that cannot."""
    if a == b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return a == b
    return SequenceMatcher(None, a, b).ratio() >= least


def lexical_gate(expected: str | None, said: str | None, least: float = 0.9) -> list[dict]:
    """For each expected word the place of the first heard word, from the last hit on, that is near enough; or null.

    The word itself is tried before its forms without endings, in their fixed order. A hit moves the start past
    itself, however far ahead it lies, and nothing moves it back.
    """
    plain = lambda ws: [re.sub(r"[^a-z0-9']+", "", w.lower()) for w in ws]
    e, heard, start, out = _TOKEN.findall(expected or ""), [w for w in plain(_TOKEN.findall(said or "")) if w], 0, []
    for raw, w in zip(e, plain(e)):
        hit = None
        for form in _forms(w) if w else []:
            hit = next((k for k in range(start, len(heard)) if _near(form, heard[k], least)), None)
            if hit is not None:
                start = hit + 1
                break
        out.append({"word": raw, "heard_at": hit})
    return out


def score_transcript(words: list[str] | None, expected: list[list[str]] | None, heard: list[str] | None) -> list[dict]:
    """Words of a transcript scored by the sounds heard in the whole recording.

    One alignment over all words' sounds; each sound goes back to its word, and a sound heard beyond the expected
    ones scores 0 in the word it follows. Fewer than 3 sounds heard, or under 0.3 of those expected, is no basis
    for that: then each sound scores a flat 92, and if none was heard each word 85.
    """
    words, expected, heard = words or [], [phonemes.normal_ipa(e, split=False) for e in expected or []], heard or []
    if not heard:
        return [_flat(w, ["transcribed"], 85.0) for w in words]
    owner = [k for k, e in enumerate(expected) for _ in e]
    parts: list[list[dict]] = [[] for _ in expected]
    if len(heard) < 3 or len(heard) / max(1, len(owner)) < 0.3:
        parts = [[{"ipa_label": s, "phoneme_score": 92.0} for s in e] for e in expected]
    elif owner:
        at = 0
        pairs = phonemes.align([s for e in expected for s in e], heard)["pairs"]
        for p in pairs:
            extra = p["expected"] == phonemes.GAP
            at += not extra
            parts[owner[max(at - 1, 0)]].append({"ipa_label": p["recognized"] if extra else p["expected"], "phoneme_score": 0.0 if extra else p["score"]})
    return [_word(w, parts[k] if k < len(parts) else []) for k, w in enumerate(words)]


def score_utterance(expected: str | None, said: str | None, heard: list[str] | None, segments: list[list[str]] | None = None, similarity: list[float] | None = None, expected_sounds: list | None = None) -> list[dict]:
    """Expected words scored by a transcript, the sounds of the whole recording, and those of each word's stretch.

    A word the transcript does not have (see ``lexical_gate``) scores 0, and the scores of the overall alignment
    that would have been its own stay for the words after it. A word with a similarity to a reference recording
    takes that for all its sounds. Any other word takes the next scores; if one of them is 0, it is aligned anew
    with the sounds of its own stretch, and scores 0 if that has none.
    """
    words = _TOKEN.findall(expected or "")
    own = _sounds(words, expected_sounds)
    pairs = phonemes.align([s for e in own for s in e], phonemes.normal_ipa(heard, split=False))["pairs"]
    scores = iter([p["score"] or 0.0 for p in pairs if p["expected"] != phonemes.GAP])
    of = lambda xs, k: xs[k] if xs and k < len(xs) else None
    out = []
    for k, gate in enumerate(lexical_gate(expected, said)):
        if gate["heard_at"] is None:
            out.append(_flat(words[k], own[k], 0.0))
        elif of(similarity, k) is not None:
            out.append({"word_text": words[k], "word_score": of(similarity, k), "phonemes": [{"ipa_label": s, "phoneme_score": of(similarity, k)} for s in own[k]]})
        else:
            got = [{"ipa_label": s, "phoneme_score": next(scores, 0.0)} for s in own[k]]
            if own[k] and any(p["phoneme_score"] == 0.0 for p in got):
                again = of(segments, k)
                got = [{"ipa_label": p["expected"], "phoneme_score": p["score"] or 0.0} for p in phonemes.align(own[k], again)["pairs"] if p["expected"] != phonemes.GAP] if again else _flat("", own[k], 0.0)["phonemes"]
            out.append(_word(words[k], got))
    return out


def speech_rate(text: str | None, seconds: float | None) -> float:
    """Words but fillers per minute of speech, to the nearest whole (halves to even); 0 for no speech.

    A filler of two words counts as one, the word at its start.
    """
    text = text or ""
    if not seconds:
        return 0.0
    skip = {len(text[: f["start_index"]].split()) for f in sequence.fillers(text)}
    return float(round(sum(i not in skip for i in range(len(text.split()))) / seconds * 60))


score_transcript_udf = per_row(score_transcript, WORDS)
score_utterance_udf = per_row(score_utterance, WORDS)
speech_rate_udf = per_row(speech_rate, "double")
score_words_udf = per_row(score_words, WORDS)
lexical_gate_udf = per_row(lexical_gate, "array<struct<word:string,heard_at:int>>")
