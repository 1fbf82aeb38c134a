"""Text as columns: tokens, normal forms, hashes, counts of markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as Python's str.split sees it; both Java's and RE2's \\s know ASCII only
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[A-Za-z0-9]+'?[A-Za-z0-9]*"


def tokens(text: Column) -> Column:
    """Letters and digits with at most one apostrophe inside or behind; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def split_words(text: Column) -> Column:
    """Words between white space; blank and null texts have none."""
    return F.filter(F.split(collapse(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def normal_word(token: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(token, F.lit(""))), "[^a-z0-9']+", "")


def bare(word: Column) -> Column:
    """A word without the marks ``.,!?`` at its ends."""
    return F.btrim(word, F.lit(".,!?"))


def same_text(a: Column, b: Column) -> Column:
    return strip(F.lower(a)) == strip(F.lower(b))


def text_hash(text: Column) -> Column:
    return F.sha2(collapse(F.lower(text)), 256)


def truncated(text: Column, most: int = 1000) -> Column:
    """The first ``most`` characters, null if that is nothing."""
    return F.nullif(F.left(text, F.lit(most)), F.lit(""))


def without_tag(text: Column, tag: str = "mark") -> Column:
    """The text inside each pair of tags in place of the pair, then white space collapsed."""
    return collapse(F.regexp_replace(text, rf"<{tag}[^>]*>(.*?)</{tag}>", "$1"))


def diversity(text: Column) -> Column:
    """Distinct words per word, in lower case; 0 for none."""
    w = split_words(F.lower(text))
    return F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))


def kinds_present(text: Column, marks: Sequence[str]) -> Column:
    """How many of the marks occur in the text at all, as parts of words too."""
    low = F.lower(text)
    total = F.lit(0)
    for m in marks:
        total = total + low.contains(m).cast("int")
    return total


def variants(word: Column) -> Column:
    """The word and its forms without common endings, in a fixed order, each once."""
    w = F.lower(F.coalesce(word, F.lit("")))

    def cut(ending: str, longer_than: int, n: int, add: str = "") -> Column:
        return F.when(w.endswith(ending) & (F.length(w) > longer_than), F.concat(F.left(w, F.length(w) - n), F.lit(add)))

    forms = F.array(w, cut("ies", 3, 3, "y"), cut("es", 2, 2), cut("s", 1, 1), cut("ed", 2, 2), cut("ed", 2, 1), cut("ing", 4, 3), cut("ing", 4, 3, "e"), cut("er", 3, 2))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def object_key(prefix: Column, question: Column, name: Column) -> Column:
    """Parts of an object's key joined by slashes, blank parts left out."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("/", some(prefix), some(question), some(name))


# Fixed values of the score heuristics.
ADVANCED = (
    "consequently", "furthermore", "nevertheless", "moreover", "specifically", "particularly", "significantly", "considerably", "effectively", "substantially",
    "demonstrate", "establish", "determine", "implement", "emphasize",
)
COMPLEX = (" which ", " that ", " although ", " because ", " since ", " while ", " if ", " unless ", " whereas ", " provided that ", " in order to ")
CONNECTORS = ("first", "second", "finally", "however", "moreover", "therefore", "in addition", "for example", "such as", "in conclusion", "overall")
DISCOURSE = {
    "and": "adding information", "but": "contrasting", "however": "contrasting", "therefore": "concluding", "so": "concluding", "first": "sequencing",
    "then": "sequencing", "next": "sequencing", "finally": "concluding", "also": "adding information", "furthermore": "adding information", "moreover": "adding information",
}


def _by_length(n: Column, cuts: Sequence[int], values: Sequence) -> Column:
    out = None
    for c, v in zip(cuts, values):
        v = v if isinstance(v, Column) else F.lit(float(v))
        out = F.when(n < c, v) if out is None else out.when(n < c, v)
    last = values[-1]
    return out.otherwise(last if isinstance(last, Column) else F.lit(float(last)))


def band_scores(text: Column, n: Column) -> dict[str, Column]:
    """Unrounded heuristic bands of a text of ``n`` words: lexical, grammar, task, coherence and their mean."""
    cuts, long = (15, 30, 50), n >= 30
    d = diversity(text)
    sentences = F.greatest(F.size(F.filter(F.split(text, r"\."), lambda s: strip(s) != "")), F.lit(1))
    adv = kinds_present(text, ADVANCED) / F.greatest(n / 20, F.lit(1.0))
    lex = _by_length(n, cuts, (0.5 + d * 1.5, 3.0 + d * 2.0, 3.5 + d * 2.5, 4.0 + d * 3.0)) + F.when(long, F.least(F.lit(2.0), adv * 2.0)).otherwise(F.least(F.lit(0.5), adv))
    lexical = F.least(_by_length(n, cuts, (2.5, 5.5, 6.5, 9.0)), lex)
    mean = n / sentences
    share = kinds_present(text, COMPLEX) / sentences
    gra = _by_length(n, cuts, (3, 4, 5, 5.5)) + F.when(mean.between(15, 25), 1.5).when(mean.between(10, 30), 1.0).otherwise(0.0)
    grammar = F.least(F.lit(9.0), gra + F.when(long, F.least(F.lit(2.0), share * 3.0)).otherwise(F.least(F.lit(0.5), share)))
    task = _by_length(n, (10, 20, 30, 50), (2, 3, 3.5, 4, 5))
    for at, more in ((75, 1.0), (120, 1.0), (180, 0.5)):
        task = task + F.when(n >= at, more).otherwise(0.0)
    links = kinds_present(text, CONNECTORS) / sentences
    coh = _by_length(n, cuts, (2.5, 3, 4, 5)) + F.when(long, F.least(F.lit(2.5), links * 4.0)).otherwise(F.least(F.lit(0.5), links * 2.0))
    coherence = F.least(_by_length(n, cuts, (4, 5, 6, 9)), coh)
    return {"lexical": lexical, "grammar": grammar, "task": F.least(F.lit(9.0), task), "coherence": coherence, "overall": lexical * 0.25 + grammar * 0.25 + F.least(F.lit(9.0), task) * 0.25 + coherence * 0.25}


def clamp(x: Column, low: float = 1.0, high: float = 9.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def fluency_score(rate: Column, fillers: Column, pauses: Column) -> Column:
    """Band from speech rate, fillers and pauses; nulls count as 0. Halves are rounded to even."""
    r, f, p = (F.coalesce(x, F.lit(0)) for x in (rate, fillers, pauses))
    score = F.lit(5.0) + F.when(r.between(150, 200), 1.0).when((r < 100) | (r > 250), -1.0).otherwise(0.0)
    score = score + F.when(f <= 2, 0.5).when(f > 5, -1.0).otherwise(0.0) + F.when(p <= 1, 0.5).when(p > 3, -0.5).otherwise(0.0)
    return clamp(F.bround(score, 0))


def band(fluency: Column, lexical: Column, grammar: Column, pronunciation: Column) -> dict[str, Column]:
    """The four parts, missing ones 5, and their mean to the nearest half."""
    f, lex, g = (F.coalesce(x.cast("double"), F.lit(5.0)) for x in (fluency, lexical, grammar))
    p = clamp(pronunciation / 11.11)
    return {"fluency_coherence": clamp(f), "lexical_resource": clamp(lex), "grammatical_range": clamp(g), "pronunciation": p, "overall_band": clamp(F.bround((f + lex + g + p) / 4 * 2, 0) / 2)}


def per_minute(n: Column, seconds: Column) -> Column:
    """How often per minute; 0 where there is no time."""
    return F.when(seconds > 0, n / seconds * 60).otherwise(F.lit(0.0))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("bigint")
