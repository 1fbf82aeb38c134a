"""Order-dependent text functions as Arrow-batched UDFs: offsets, repetitions, fillers, numbers, word differences.

Each works inside one row, so none of them shuffles.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veloquent.functions.udf import per_batch, per_row

# Fixed values of the filler rules.
DEFINITE = frozenset(["uh", "um", "hmm", "er", "ah", "mm", "erm", "eh", "oh"])
LIKE_BEFORE = frozenset(["was", "am", "is", "were", "like"])
LIKE_AFTER = frozenset(["uh", "um", "er", "ah", "you", "totally", "really", "literally", "like"])
YOU_KNOW_AFTER = frozenset(["", "like", "uh", "um"])
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _bare(w: str) -> str:
    return w.strip(".,!?")


def word_offsets(text: str | None) -> list[dict]:
    """Words with their place in the text as if parted by single spaces."""
    out, at = [], 0
    for w in (text or "").split():
        out.append({"word": w, "start": at})
        at += len(w) + 1
    return out


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a batch of texts, the row bounds among them, and each word's place and length in its text."""
    lists = pc.fill_null(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts)), pa.scalar([], pa.list_(pa.string())))
    ends = np.cumsum(np.concatenate(([0], pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    words = lists.flatten()
    some = pc.not_equal(words, "")  # a blank text splits into one empty word
    if not pc.all(some).as_py() if len(words) else False:
        gone = np.concatenate(([0], np.cumsum(~some.to_numpy(zero_copy_only=False))))
        words, ends = words.filter(some), ends - gone[ends]
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(size + 1)))
    start = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
    return words, ends, start, size


def _offsets(texts: pa.Array) -> pa.Array:
    words, ends, start, _ = _split(texts)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array(start, pa.int32())], ["word", "start"]))


def _repetitions(texts: pa.Array) -> pa.Array:
    """Runs of the same word, ignoring case and the marks at its ends: one comparison of neighbours over a whole batch."""
    words, ends, start, size = _split(pc.utf8_lower(texts))
    bare = pc.utf8_trim(words, ".,!?")
    n = len(words)
    fresh = np.ones(n + 1, bool)
    if n > 1:
        fresh[1:n] = ~pc.equal(bare.slice(1), bare.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    fresh[ends] = True
    first = np.flatnonzero(fresh)
    count = np.diff(first)
    runs = np.flatnonzero(count > 1)
    a, k = first[runs], count[runs]
    z = a + k - 1
    bounds = np.searchsorted(a, ends)
    columns = [bare.take(pa.array(a)), pa.array(start[a], pa.int32()), pa.array(start[z] + size[z], pa.int32()), pa.array(k, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["text", "start_index", "end_index", "repeat_count"]))


def fillers(text: str | None, heard: list[dict] | None = None) -> list[dict]:
    """Filler words of a text, with those ``heard`` in its sounds; of hits within 5 characters the first stays.

    ``like`` and ``you know`` count only in the company that makes them fillers. A definite filler is left out
    where the same one was heard within 10 characters.
    """
    words = word_offsets((text or "").lower())
    plain = [_bare(w["word"]) for w in words]
    at = lambda i: plain[i] if 0 <= i < len(plain) else ""
    hits = list(heard or [])

    def hit(i: int, n: int, sound: str) -> dict:
        raw = " ".join(w["word"] for w in words[i : i + n])
        return {"text": raw, "start_index": words[i]["start"], "end_index": words[i]["start"] + len(raw), "phonemes": sound}

    for i, w in enumerate(plain):
        if w in DEFINITE:
            if not any(h["text"].lower() == w and abs(h["start_index"] - words[i]["start"]) < 10 for h in hits):
                hits.append(hit(i, 1, w))
        elif w == "like":
            if i == 0 or at(i - 1) in LIKE_BEFORE or at(i + 1) in LIKE_AFTER:
                hits.append(hit(i, 1, w))
        elif w == "you" and at(i + 1) == "know":
            if at(i - 1) == "" or at(i + 2) in YOU_KNOW_AFTER:
                hits.append(hit(i, 2, "you know"))
    kept: list[dict] = []
    for h in sorted(hits, key=lambda h: h["start_index"]):
        if not kept or h["start_index"] - kept[-1]["start_index"] >= 5:
            kept.append(h)
    return kept


def number_words(digits: str) -> str:
    """0 to 999,999 in words, without hyphens or ``and``; anything else as it is."""
    try:
        n = int(digits)
    except ValueError:
        return digits
    if not 0 <= n < 1_000_000:
        return digits

    def below_thousand(k: int) -> list[str]:
        out = [ONES[k // 100], "hundred"] if k >= 100 else []
        k %= 100
        if k >= 20:
            out.append(TENS[k // 10 - 2])
            k %= 10
        return out + ([ONES[k]] if k else [])

    if n == 0:
        return "zero"
    high, low = divmod(n, 1000)
    return " ".join((below_thousand(high) + ["thousand"] if high else []) + below_thousand(low))


def _ordinal(m: re.Match) -> str:
    words = number_words(m.group(1))
    head, _, last = words.rpartition(" ")
    last = ORDINAL.get(last) or (last[:-1] + "ieth" if last in TENS else last + "th")
    return f"{head} {last}" if head else last


def spoken(text: str | None) -> str | None:
    """Ordinals, then numbers, as words; numbers of a million and more stay."""
    if text is None:
        return None
    text = re.sub(r"\b(\d+)(?:st|nd|rd|th)\b", _ordinal, text, flags=re.IGNORECASE)
    return re.sub(r"\b\d+\b", lambda m: number_words(m.group()), text)


def word_diff(a: str | None, b: str | None) -> list[dict]:
    """Word edits from ``a`` to ``b``: type, original, corrected and the place in ``a``."""
    x, y = (a or "").split(), (b or "").split()
    out = []

    def edit(kind, old, new, at):
        out.append({"type": kind, "original": old, "corrected": new, "position": at})

    for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y).get_opcodes():
        if tag == "equal":
            continue
        both = min(i2 - i1, j2 - j1)
        for k in range(both):
            if x[i1 + k].lower() != y[j1 + k].lower():
                edit("substitution", x[i1 + k], y[j1 + k], i1 + k)
        for k in range(i1 + both, i2):
            edit("deletion", x[k], None, k)
        for k in range(j1 + both, j2):
            edit("addition", None, y[k], i1 + both)
    return out


def tagged(a: str | None, edits: list[dict]) -> str | None:
    """The text with its edits marked: a changed word inside a tag, an addition as a tag around dots."""
    if a is None or not len(edits):
        return a
    words = a.split()
    at: dict[int, list[dict]] = {}
    for e in edits:
        at.setdefault(e["position"], []).append(e)
    tag = lambda fix, inside: f'<grammar-mistake correction="{fix}">{inside}</grammar-mistake>'
    for pos in sorted(at, reverse=True):
        changed = any(e["type"] != "addition" for e in at[pos])
        fixes = [e["corrected"] for e in at[pos] if e["corrected"]]
        if changed and pos < len(words):
            words[pos] = tag(" ".join(fixes), words[pos])
        elif fixes:
            words.insert(min(pos, len(words)), tag(" ".join(fixes), "..."))
    return " ".join(words)


offsets_udf = per_batch(_offsets, "array<struct<word:string,start:int>>")
repetitions_udf = per_batch(_repetitions, "array<struct<text:string,start_index:int,end_index:int,repeat_count:int>>")
fillers_udf = per_row(fillers, "array<struct<text:string,start_index:int,end_index:int,phonemes:string>>")
spoken_udf = per_row(spoken, "string")
word_diff_udf = per_row(word_diff, "array<struct<type:string,original:string,corrected:string,position:int>>")
tagged_udf = per_row(lambda a, b: tagged(a, word_diff(a, b)), "string")
