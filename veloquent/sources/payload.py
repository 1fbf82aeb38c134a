"""Cached reference documents, given as JSON or as JSON inside a JSON string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "expected_text string, ipa_sequence array<string>, ipa_joined string, audio_duration_ms int, generated_at string, "
    "word_phonemes array<struct<word_text:string,start:double,end:double,phonemes:array<string>>>"
)


def reference_payload(doc: Column) -> Column:
    """The document as a struct; blank symbols are dropped and missing lists are empty. Null for what is no JSON."""
    v = F.try_parse_json(doc)
    inner = F.coalesce(F.try_variant_get(v, "$", "string"), doc)
    x = F.from_json(F.when(v.isNotNull(), inner), SCHEMA)
    some = lambda seq: F.filter(F.coalesce(seq, F.array().cast("array<string>")), lambda p: p.isNotNull() & (F.trim(p) != ""))
    words = F.transform(F.coalesce(x["word_phonemes"], F.array().cast(SCHEMA.split("word_phonemes ")[1])), lambda w: w.withField("phonemes", some(w["phonemes"])))
    return F.when(x.isNotNull(), x.withField("ipa_sequence", some(x["ipa_sequence"])).withField("word_phonemes", words))


def cache_hit(stored_hash: Column, wanted_hash: Column, ready: Column, force: Column) -> Column:
    """Whether a cached reference can be used: there, ready, for the same text, and not to be made anew."""
    return F.coalesce(ready & (stored_hash == wanted_hash) & ~F.coalesce(force, F.lit(False)), F.lit(False))


def with_defaults(df: DataFrame, json_col: str, defaults: dict[str, object]) -> DataFrame:
    """Keys of a JSON object as columns, with defaults; a single value where a list is due becomes a list of one."""
    v = F.try_parse_json(json_col)
    out = []
    for k, default in defaults.items():
        path = f"$.{k}"
        if isinstance(default, list):
            one = F.try_variant_get(v, path, "string")
            many = F.try_variant_get(v, path, "array<string>")
            out.append(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array(*map(F.lit, default)).cast("array<string>")).alias(k))
        else:
            out.append(F.coalesce(F.try_variant_get(v, path, "double" if isinstance(default, float) else "string"), F.lit(default)).alias(k))
    return df.select("*", *out)
