"""One form for texts that look the same: look-alike classes by union-find, rewriting by a multi-pattern automaton."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloquent import session
from veloquent.llm.tokens import spread

# Pairs of a letter and the letter of the same shape it is shown as.
SAME_SHAPE = (
    "АA ВB ЕE ЅS ІI ЇÏ ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ӀI ҺH "
    "аa еe ѕs іi їï јj оo рp сc уy хx һh ԁd ԛq ԝw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX νv οo ϲc ϳj ϹC "
    "օo ՕO ոn սu հh ՍU ɡg KK ÅÅ "
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᎳW ᏃZ "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ⲞO ⲟo ⲤC ⲥc ⲢP ⲣp ⲘM ⲚN ⲔK ⲎH ⲒI ⲦT ⲨY ⲬX"
)
#: Roman numerals made of letters, each shown as those letters
_NUMERALS = range(0x2160, 0x2180)
#: formatting characters that do show, or belong to a sign that does
_SHOWN = set(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0xE0020, 0xE0080)]))
_HIDDEN = {chr(c) for c in [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]}
_LIGATURES = "ﬀﬁﬂﬃﬄ"
_JOINER = "‍"


def target(ch: str) -> str:
    """What a code point is shown as, by the rules of single code points; itself if no rule applies."""
    kind = unicodedata.category(ch)
    if ch in _HIDDEN or (kind == "Cf" and ch not in _SHOWN):
        return ""
    if kind == "Zs":
        return " "
    if ch in _LIGATURES:
        return unicodedata.normalize("NFKD", ch)
    parts = unicodedata.decomposition(ch).split()
    # <font>: letters of mathematical alphabets; digits of theirs are styled on purpose, and stay
    if parts and (parts[0] in ("<wide>", "<narrow>") or (parts[0] == "<font>" and kind in ("Lu", "Ll")) or (parts[0] == "<compat>" and ord(ch) in _NUMERALS)):
        return "".join(chr(int(x, 16)) for x in parts[1:])
    return unicodedata.normalize("NFD", ch)


class Classes:
    """Union-find over code points and strings. A class is all that looks the same, through any chain of steps."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def groups(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in sorted(self.up):
            by.setdefault(self.find(x), []).append(x)
        return list(by.values())


def classes(seen: Iterable[str]) -> list[list[str]]:
    """Look-alike classes over the given code points and strings and all they lead to.

    A string looks as its characters do, one by one, so strings whose characters are pairwise alike are united
    too, until nothing changes; that carries the relation over compositions (a Cyrillic letter with an accent and
    the Latin one).
    """
    same = dict((p[0], p[1]) for p in SAME_SHAPE.split())
    todo, c = list(seen) + [x for p in same.items() for x in p], Classes()
    known: set[str] = set()
    while todo:
        x = todo.pop()
        if x in known:
            continue
        known.add(x)
        c.find(x)
        steps = [unicodedata.normalize("NFD", x), unicodedata.normalize("NFC", x)]
        if len(x) == 1:
            steps += [target(x), *([same[x]] if x in same else [])]
        else:
            todo += x
        for y in steps:
            c.union(x, y)
            todo.append(y)
    while True:
        # one representative per code point, then strings that read the same through them
        by_reading: dict[str, str] = {}
        changed = False
        for x in sorted(known):
            reading = unicodedata.normalize("NFD", "".join(c.find(ch) for ch in unicodedata.normalize("NFD", x)))
            first = by_reading.setdefault(reading, x)
            changed |= c.union(first, x)
        if not changed:
            return [g for g in c.groups() if len(g) > 1]


def representatives(groups: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Each member that is rewritten, with its class's most frequent member; ties go to the shorter, then the smaller.

    What shows nothing becomes nothing. Members that compose to one code point stand as composed. Where a sign looks
    like several letters (a ligature, a numeral), the letters stand for it, so that signs which overlap end up alike.
    """
    letters = lambda x: sum(unicodedata.category(ch)[0] != "M" for ch in unicodedata.normalize("NFC", x))
    out = {}
    for g in groups:
        if "" in g:
            best = ""
        else:
            most = max(map(letters, g))
            best = min((x for x in g if most < 2 or letters(x) == most), key=lambda x: (-counts.get(x, 0), len(x), x))
            best = unicodedata.normalize("NFC", best)
        out |= {x: best for x in g if x not in (best, "")}
    return out


class Rewriter:
    """Greedy longest-match rewriting, repeated with composition in between until a text stays as it is."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for pattern in rules:
            self.automaton.add_word(pattern, pattern)
        self.any = bool(rules)
        if self.any:
            self.automaton.make_automaton()

    def once(self, text: str) -> str:
        out, at = [], 0
        for end, pattern in self.automaton.iter_long(text):
            start = end - len(pattern) + 1
            if pattern == _JOINER and _joins(text, start):
                continue  # the joiner of an emoji sequence changes how it looks
            out += (text[at:start], self.rules[pattern])
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        while self.any:
            new = unicodedata.normalize("NFC", self.once(text))
            if new == text:
                break
            text = new
        return text


def _joins(text: str, i: int) -> bool:
    before = i - 1
    while before >= 0 and (text[before] == "️" or text[before] == _JOINER):
        before -= 1
    pictures = ("So", "Sk")
    return before >= 0 and i + 1 < len(text) and unicodedata.category(text[before]) in pictures and unicodedata.category(text[i + 1]) == "So"


_CLUSTER = regex.compile(r"\P{M}\p{M}{1,3}")


def counted(docs: DataFrame, text_col: str) -> dict[str, int]:
    """How often each code point, and each sequence that composes to one, occurs in all texts.

    Both are bounded by the Unicode repertoire (some 150,000 code points), whatever the corpus, so the counts may
    be collected; they are combined per batch and per key before that.
    """

    strings = [target(x) for x in _LIGATURES]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(t)
                    for x in strings:
                        if n := t.count(x):
                            seen[x] += n
                    if not t.isascii():
                        seen.update(s for s in _CLUSTER.findall(t) if len(unicodedata.normalize("NFC", s)) == 1)
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    counts = spread(docs.select(text_col)).mapInArrow(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in counts.collect()}


def rules(docs: DataFrame, text_col: str) -> dict[str, str]:
    counts = counted(docs, text_col)
    return representatives(classes(counts), counts)


def canonical(docs: DataFrame, id_col: str, text_col: str, rewriting: dict[str, str] | None = None) -> DataFrame:
    """(id, text, canonical): null stays null; texts are rewritten whole, in one pass without a shuffle."""
    rewriting = rules(docs, text_col) if rewriting is None else rewriting
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(rewriting)  # bounded by the Unicode repertoire

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(shared.value)
        stays = str.isascii if not any(x.isascii() for x in shared.value) else lambda t: False
        for b in batches:
            new = [None if t is None else t if stays(t) else rewrite(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(new, pa.string())], names=["id", "text", "canonical"])

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, f"id {kind}, text string, canonical string")


def forms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, c, t), staged: per document with visible text the hashes of its consistent form and of its own text."""
    x = canonical(docs, id_col, text_col)
    visible = F.col("canonical").rlike(r"[^\s\p{Z}\p{C}]")
    return session.staged(x.filter(visible).select("id", F.unhex(F.md5("canonical")).alias("c"), F.unhex(F.md5("text")).alias("t")), "lookalike")


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_texts, n_documents): each document of a class of several texts, with its class's smallest id.

    What ``pairs`` says, one row a document: documents of one class look the same. Classes are summed up before their
    shuffle, so one with any share of the documents is a row per task.
    """
    rows = forms(docs, id_col, text_col)
    texts = rows.groupBy("c", "t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    several = texts.groupBy("c").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_documents")).filter("n_texts > 1")
    return rows.select("id", "c").join(several, "c").select(F.col("id").alias(id_col), "class_id", "n_texts", "n_documents")


def pairs(docs: DataFrame, id_col: str, text_col: str, chunk: int = 1_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: documents with visible text that look the same and are not equal.

    Only hashes of texts travel. Copies of one text meet once, as a text, before texts are paired: a class held
    by many copies of few texts costs its pairs of texts, not of documents. The documents of a text are spread over
    chunks of about ``chunk`` by a hash of their id, and texts are paired chunk by chunk, so that a task holds a
    chunk's documents and makes the pairs of two chunks at a time, however many copies a text has; every row of the
    last join is a result.
    """
    rows = forms(docs, id_col, text_col)
    texts = rows.groupBy("c", "t").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("k"))
    texts = session.staged(texts.join(texts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c"), "c"), "texts")
    a, b = texts.select("c", F.col("t").alias("ta"), F.col("k").alias("ka")), texts.select("c", F.col("t").alias("tb"), F.col("k").alias("kb"))
    met = a.join(b, "c").filter(F.col("ta") < F.col("tb"))
    chunks = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    met = met.withColumn("i", chunks("ka")).withColumn("j", chunks("kb")).drop("ka", "kb")
    placed = rows.join(texts, ["c", "t"]).select("c", "t", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("i"), "id")
    left, right = placed.select("c", F.col("t").alias("ta"), "i", F.col("id").alias("ia")), placed.select("c", F.col("t").alias("tb"), F.col("i").alias("j"), F.col("id").alias("ib"))
    found = met.join(left, ["c", "ta", "i"]).join(right, ["c", "tb", "j"])
    return found.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b")).distinct()
