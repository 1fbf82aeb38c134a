"""Queries of phoneme, scoring, signal and interval functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.functions import lexicon, phonemes, scoring, sequence, signal, text
from veloquent.functions.udf import per_row
from veloquent.operators import intervals
from veloquent.plans import fixed, texts
from veloquent.sources import sinks
from veloquent.tables import once, table

_C = F.col


def _objects(v):
    """The objects in a variant that is an array of them; an object in place of an array is an array of one."""
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(is_object(v), F.array(v)), F.array().cast("array<variant>"))
    return F.filter(many, lambda x: x.isNotNull() & is_object(x))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """(id, words): the scored words of each analysis, typed; a document inside a string is opened.

    What is no document has no words. Documents of more than 1,000 levels are none to the JVM's parser (see
    ``nested`` for those).
    """
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "words")
    v = F.try_parse_json("words")
    inside = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string"))).otherwise(x)
    part = lambda x, path, kind: F.try_variant_get(x, f"$.{path}", kind).alias(path)
    sound = lambda p: F.struct(part(p, "ipa_label", "string"), part(p, "phoneme_score", "double"))
    word = lambda w: F.struct(part(w, "word_text", "string"), part(w, "word_score", "double"), F.transform(_objects(F.try_variant_get(w, "$.phonemes", "variant")), sound).alias("phonemes"))
    return rows.select("id", inside(v).alias("v")).select("id", F.transform(_objects(_C("v")), word).alias("words"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    seq = F.filter(F.flatten(F.transform("words", lambda w: F.transform(w["phonemes"], lambda p: p["ipa_label"]))), lambda p: p.isNotNull())
    return _spoken(spark, d).select("id", seq.alias("seq"))


def _joined(c):
    return F.array_join(c, " ")


def phoneme_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("id", F.concat_ws(" ", "seq").alias("seq"))


def diphthong_split(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("id", _joined(phonemes.split_diphthongs(_C("seq"))).alias("seq"))


def ipa_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("id", _joined(phonemes.normal_udf("seq")).alias("split"), _joined(phonemes.normal_whole_udf("seq")).alias("whole"))


def diphthong_rebuild(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d).withColumn("seq", phonemes.split_diphthongs(_C("seq")))
    return x.select("id", *[_joined(f(_C("seq"))).alias(f.__name__) for f in (phonemes.joined, phonemes.rebuilt, phonemes.cleaned)])


def phoneme_map(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d)
    back = phonemes.from_arpabet(phonemes.to_arpabet(_C("seq")))
    forms = {"oxford": phonemes.to_oxford(_C("seq")), "espeak": phonemes.from_espeak(_C("seq")), "known": phonemes.only_known(_C("seq")), "arpabet": phonemes.to_arpabet(_C("seq")), "back": back, "audible": phonemes.without_silence(_C("seq"))}
    return x.select("id", *[_joined(c).alias(k) for k, c in forms.items()])


def phoneme_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("id", phonemes.has_repeats(_C("seq")).alias("repeats"), F.size(phonemes.without_repeats(_C("seq"))).alias("n"))


def phoneme_distance(spark: SparkSession, d: str) -> DataFrame:
    return phonemes.distance_table(spark)


def align_phonemes(spark: SparkSession, d: str) -> DataFrame:
    """Expected sounds of each scored word against its labels; each distinct pair is aligned once."""
    words = _spoken(spark, d).select(F.explode("words").alias("w")).filter(F.size("w.phonemes") > 0)
    seq = F.filter(F.transform("w.phonemes", lambda p: p["ipa_label"]), lambda p: p.isNotNull())
    seen = words.select(_C("w.word_text").alias("word"), seq.alias("seq")).groupBy("word", "seq").agg(F.count(F.lit(1)).alias("n"))
    pairs = seen.select("word", phonemes.normal_udf(phonemes.sounds_udf("word")).alias("e"), phonemes.normal_udf("seq").alias("r"), "n").groupBy("word", "e", "r").agg(F.sum("n").alias("n"))
    a = pairs.withColumn("a", phonemes.align_udf("e", "r"))
    mean = F.when(F.size("a.scores") > 0, F.aggregate("a.scores", F.lit(0.0), lambda s, x: s + x) / F.size("a.scores"))
    return a.select("word", _joined(_C("e")).alias("expected"), _joined(_C("r")).alias("recognized"), "n", F.size("a.pairs").alias("steps"), mean.alias("score"))


def phoneme_coverage(spark: SparkSession, d: str) -> DataFrame:
    words = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    x = words.select("id", phonemes.sounds_udf("expected_text").alias("e"), phonemes.sounds_udf("predicted_text").alias("r"))
    ratio = phonemes.coverage(_C("e"), _C("r"))
    return x.select("id", ratio.alias("coverage"), F.when((F.size("r") < 3) | (ratio < 0.3), F.lit(92.0)).alias("fallback_score"))


def _scored(spark: SparkSession, d: str, reading: bool) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    return rows.select("id", F.posexplode(scoring.score_words_udf("expected_text", "predicted_text", F.lit(reading))).alias("pos", "w")).select("id", "pos", "w.*")


def scripted_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, False).select("id", "pos", "word_text", "word_score", F.size("phonemes").alias("n_phonemes"))


def reading_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, True).groupBy("id").agg(F.avg("word_score").alias("overall"), F.count(F.lit(1)).alias("n_words"))


def observed_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Each scored word with the sounds it is most often shown with."""
    return _observed(spark, d).select("word", _joined(_C("sounds")).alias("sounds"), "n")


def _observed(spark: SparkSession, d: str) -> DataFrame:
    words = _spoken(spark, d).select(F.explode("words").alias("w"))
    seq = F.filter(F.transform("w.phonemes", lambda p: p["ipa_label"]), lambda p: p.isNotNull())
    return lexicon.observed(words.select(_C("w.word_text").alias("word"), seq.alias("sounds")))


def scripted_score_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Scripted scores with the sounds of a lexicon, and spelling for words it lacks."""
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    words = {"expected_sounds": text.tokens(_C("expected_text")), "said_sounds": text.tokens(_C("predicted_text"))}
    x = lexicon.with_sounds(rows, "id", words, _observed(spark, d))
    scored = scoring.score_words_udf("expected_text", "predicted_text", F.lit(False), "expected_sounds", "said_sounds")
    return x.select("id", F.posexplode(scored).alias("pos", "w")).select("id", "pos", "w.word_text", "w.word_score", F.size("w.phonemes").alias("n_phonemes"))


def dictionary_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return sinks.dictionary(table(spark, d, "documents"), "text", _observed(spark, d))


def _heard(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    return rows.join(_labels(spark, d), "id")


def transcript_score(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts against the sounds of their scored words."""
    x = _heard(spark, d).withColumn("words", text.tokens(_C("predicted_text")))
    sounds = per_row(lambda ws: [phonemes.sounds(w) for w in ws or []], "array<array<string>>")("words")
    return x.select("id", F.posexplode(scoring.score_transcript_udf("words", sounds, "seq")).alias("pos", "w")).select("id", "pos", "w.word_text", "w.word_score")


def utterance_score(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.score_utterance_udf("expected_text", "predicted_text", "seq")
    return _heard(spark, d).select("id", F.posexplode(scored).alias("pos", "w")).select("id", "pos", "w.word_text", "w.word_score")


def speech_rate(spark: SparkSession, d: str) -> DataFrame:
    """Words per minute and fillers per minute of transcribed requests."""
    logs = once(table(spark, d, "api_usage_logs").filter("predicted_text IS NOT NULL AND audio_duration_ms IS NOT NULL"), "id", "predicted_text", "audio_duration_ms")
    seconds = _C("audio_duration_ms") / 1000
    return logs.select("id", scoring.speech_rate_udf("predicted_text", seconds).alias("rate"), text.per_minute(F.size(sequence.fillers_udf("predicted_text")), seconds).alias("fillers_per_minute"))


def lexical_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    return rows.select("id", F.posexplode(scoring.lexical_gate_udf("expected_text", "predicted_text")).alias("pos", "w")).select("id", "pos", "w.*")


def fillers_phoneme(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("id", F.inline(phonemes.filler_udf("seq")))


def fillers_both(spark: SparkSession, d: str) -> DataFrame:
    """Fillers of the transcript together with those in the sounds."""
    texts = once(table(spark, d, "pronunciation_analyses"), "id", "predicted_text")
    both = per_row(lambda t, s: sequence.fillers(t, phonemes.filler_sounds(s)), "array<struct<text:string,start_index:int,end_index:int,phonemes:string>>")
    return texts.join(_labels(spark, d), "id").select("id", F.inline(both("predicted_text", "seq")))


def _mean(scores):
    known = F.filter(scores, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(F.lit(0.0))


def word_overall_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Words as the mean of their sounds, the whole as the plain mean of words, inside each row."""
    x = _spoken(spark, d).filter(F.size("words") > 0)
    per_word = F.transform("words", lambda w: _mean(F.transform(w["phonemes"], lambda p: p["phoneme_score"])))
    return x.select("id", F.size("words").alias("n_words"), _mean(per_word).alias("overall"))


def zero_nonzero_words(spark: SparkSession, d: str) -> DataFrame:
    x = _spoken(spark, d).filter(F.size("words") > 0)
    pick = lambda hit: F.array_join(F.transform(F.filter("words", hit), lambda w: F.coalesce(w["word_text"], F.lit(""))), " ")
    score = lambda w: F.coalesce(w["word_score"], F.lit(0.0))
    return x.select("id", pick(lambda w: score(w) > 0.01).alias("scored"), pick(lambda w: score(w) <= 0.01).alias("zero"))


def attempt_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean score per expected text over its attempts, summed exactly."""
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "overall_score").filter("expected_text IS NOT NULL AND overall_score IS NOT NULL")
    total = F.sum(F.col("overall_score").cast("decimal(18,4)"))
    return rows.groupBy("expected_text").agg(F.count(F.lit(1)).alias("attempts"), (total.cast("double") / F.count(F.lit(1))).alias("average"))


def attempt_words(spark: SparkSession, d: str) -> DataFrame:
    """Mean score per expected text and word over all its attempts; the same word twice counts as one."""
    words = _spoken(spark, d).join(once(table(spark, d, "pronunciation_analyses"), "id", "expected_text"), "id")
    x = words.select("expected_text", F.explode("words").alias("w")).groupBy("expected_text", "w.word_text")
    scores = F.col("w.word_score").cast("decimal(18,6)")  # summed exactly, so the order does not matter
    return x.agg(F.when(F.count(scores) > 0, F.sum(scores).cast("double") / F.count(scores)).alias("average"), F.count(F.lit(1)).alias("n"))


def word_phoneme_zip(spark: SparkSession, d: str) -> DataFrame:
    """Words of the expected text with the scored word at the same place; beyond its end there is none."""
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text").filter("expected_text IS NOT NULL").join(_spoken(spark, d), "id")
    x = rows.select("id", "words", F.posexplode(text.tokens(_C("expected_text"))).alias("pos", "word"))
    at = F.get("words", _C("pos"))
    return x.select("id", "pos", "word", at["word_text"].alias("scored_word"), F.coalesce(F.size(at["phonemes"]), F.lit(0)).alias("n_phonemes"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _at(x: DataFrame, name: str) -> DataFrame:
    return x.select("vec_id", F.posexplode(name).alias("pos", "value"))


def peak_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _at(_vectors(spark, d).select("vec_id", signal.peak_normalized(_C("embedding")).alias("x")), "x")


def noise_gate(spark: SparkSession, d: str) -> DataFrame:
    return _at(_vectors(spark, d).select("vec_id", signal.noise_gated(_C("embedding"), 0.2).alias("x")), "x")


def cosine_percent(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the one before it."""
    a = _vectors(spark, d)
    b = a.select((_C("vec_id") + 1).alias("vec_id"), _C("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", signal.cosine_percent(_C("embedding"), _C("other")).alias("percent"))


def pause_gaps(spark: SparkSession, d: str) -> DataFrame:
    spans = F.transform(signal.voiced(_C("embedding"), 0.1), lambda i: F.struct(i.cast("double").alias("start"), (i + 1).cast("double").alias("end")))
    return _vectors(spark, d).select("vec_id", F.inline(signal.pauses(spans, 2.0)))


def speech_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Pauses in signals of 2 samples a second, by frames of 4 samples, 2 apart, within 6 dB of the loudest."""
    pauses = signal.pauses_udf("embedding", F.lit(2), F.lit(1.0), F.lit(6.0), F.lit(4), F.lit(2))
    return _vectors(spark, d).select("vec_id", F.inline(pauses))


def word_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each expected word lies in a recording: by the alignment for the words it has (here, every third request's first two), else in equal parts."""
    logs = once(table(spark, d, "api_usage_logs").filter("audio_duration_ms IS NOT NULL AND expected_text IS NOT NULL"), "id", "expected_text", "audio_duration_ms")
    seconds = _C("audio_duration_ms") / 1000
    known = F.array(*[F.struct((seconds * a).alias("start"), (seconds * b).alias("end")) for a, b in ((0.0, 0.25), (0.25, 0.5))])
    aligned = F.when(_C("audio_duration_ms") % 3 == 0, known)
    return logs.select("id", F.posexplode(signal.word_spans(aligned, F.size(text.tokens(_C("expected_text"))), seconds)).alias("pos", "s")).select("id", "pos", "s.start", "s.end")


def voiced_spans(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.inline(signal.voiced_udf("embedding")))


def rate_over_time(spark: SparkSession, d: str) -> DataFrame:
    return _at(_vectors(spark, d).select("vec_id", signal.rate_udf("embedding", F.lit(12), F.lit(8)).alias("x")), "x")


def spectral_summary(spark: SparkSession, d: str) -> DataFrame:
    long = F.flatten(F.array_repeat(F.transform("embedding", lambda v: v.cast("double")), 20))
    return _at(_vectors(spark, d).select("vec_id", signal.summary_udf(long).alias("x")), "x")


def segment_bounds(spark: SparkSession, d: str) -> DataFrame:
    logs = once(table(spark, d, "api_usage_logs").filter("audio_duration_ms IS NOT NULL"), "id", "audio_duration_ms")
    n = (_C("audio_duration_ms") * 16).cast("bigint")
    return logs.select("id", F.inline(F.array(signal.segment_bounds(_C("audio_duration_ms") / 4000, _C("audio_duration_ms") / 2000, n))))


def _sentences(spark: SparkSession, d: str):
    words = table(spark, d, "documents").select("doc_id", F.inline(sequence.offsets_udf("text")))
    w = words.select("doc_id", _C("word").alias("label"), _C("start").cast("double").alias("start"), (_C("start") + F.length("word")).cast("double").alias("end"))
    runs = table(spark, d, "documents").select("doc_id", F.inline(sequence.repetitions_udf("text")))
    return runs.select("doc_id", _C("text").alias("label"), _C("start_index").cast("double").alias("start"), _C("end_index").cast("double").alias("end")), w


def interval_contain(spark: SparkSession, d: str) -> DataFrame:
    """Words inside each run of repeated words."""
    runs, words = _sentences(spark, d)
    return intervals.contained(runs, words, "doc_id", 200.0)


def words_with_phones(spark: SparkSession, d: str) -> DataFrame:
    """Runs of repeated words as words, and the words in them as phones; runs without any stay."""
    runs, words = _sentences(spark, d)
    found = intervals.words_with_phones(runs, words.filter(F.length("label") > 3), "doc_id", 200.0)
    return found.select("doc_id", "label", "start", "end", F.size("phones").alias("n"), F.array_join(F.transform("phones", lambda p: p["label"]), " ").alias("phones"))


QUERIES = {
    f.__name__: f
    for f in (
        phoneme_sequences, diphthong_split, ipa_normalize, diphthong_rebuild, phoneme_map, phoneme_repeats, phoneme_distance, align_phonemes, phoneme_coverage, scripted_score, scripted_score_lexicon, observed_lexicon, dictionary_lexicon, reading_score, transcript_score, utterance_score, speech_rate,
        lexical_gate, fillers_phoneme, fillers_both, word_overall_rollup, zero_nonzero_words, attempt_summary, attempt_words, word_phoneme_zip, peak_normalize, noise_gate, cosine_percent,
        pause_gaps, speech_pauses, word_spans, voiced_spans, rate_over_time, spectral_summary, segment_bounds, interval_contain, words_with_phones,
    )
}

_OPEN = "CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END"
_SPOKEN = f"""WITH a AS (SELECT id, TRY_CAST(words AS JSON) AS j FROM (SELECT DISTINCT id, words FROM pronunciation_analyses)), b AS (SELECT id, {_OPEN} AS j FROM a),
c AS (SELECT id, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [j] END AS ws FROM b),
d AS (SELECT id, list_filter(ws, lambda w: json_type(w) = 'OBJECT') AS ws FROM c WHERE ws IS NOT NULL)
"""


def _lookup(pairs: str, x: str) -> str:
    return f"map_from_entries([{pairs}])[{x}]"


def _replaced(x: str) -> str:
    for a, b in re.findall(r"\(('(?:[^']|'')*'), ('(?:[^']|'')*')\)", fixed.ESPEAK):
        x = f"replace({x}, {a}, {b})"
    return x


def _each(body: str) -> str:
    return f"array_to_string(list_filter(list_transform(seq, lambda p: {body}), lambda x: x IS NOT NULL), ' ')"


_SEQ = _SPOKEN + """, q AS (SELECT id, list_filter(flatten(list_transform(ws, lambda w: list_transform(json_extract(w, '$.phonemes[*]'), lambda p: json_extract_string(p, '$.ipa_label')))), lambda x: x IS NOT NULL) AS seq FROM d
  UNION ALL SELECT id, CAST([] AS VARCHAR[]) FROM c WHERE ws IS NULL)
"""
#: IPA symbol, the first ARPABET symbol for it
_BACK = ", ".join(f"({b}, {a})" for a, b in re.findall(r"\(('[A-Z]+'), ('[^']+')\)", fixed.ARPABET))
_BASE = "CASE WHEN ends_with(trim(p), 'ː') THEN left(trim(p), length(trim(p)) - 1) ELSE trim(p) END"
_V = "(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos FROM embeddings)"
_TIMED = "(SELECT DISTINCT id, predicted_text, audio_duration_ms FROM api_usage_logs WHERE predicted_text IS NOT NULL AND audio_duration_ms IS NOT NULL)"
_SOUNDS = lambda x: f"""coalesce(list_sum(list_transform(regexp_extract_all(lower({x}),
  'igh|tch|sh|ch|th|ph|ng|ee|ea|oo|ou|ow|ai|ay|oi|oy|ck|qu|wh|[a-z]'), lambda m: CASE WHEN m IN ('qu', 'x') THEN 2 ELSE 1 END)), 0)"""  # noqa: E731
ORACLES = {
    "word_overall_rollup": _SPOKEN + """, e AS (SELECT id, list_transform(ws, lambda w: coalesce(list_avg(list_transform(list_filter(json_extract(w, '$.phonemes[*]'), lambda p: json_extract(p, '$.phoneme_score') IS NOT NULL AND json_type(p, '$.phoneme_score') <> 'NULL'), lambda p: CAST(json_extract(p, '$.phoneme_score') AS DOUBLE))), 0)) AS s FROM d)
SELECT id, CAST(len(s) AS INT) AS n_words, list_avg(s) AS overall FROM e WHERE len(s) > 0""",
    "zero_nonzero_words": _SPOKEN + """SELECT id, array_to_string(list_transform(list_filter(ws, lambda w: coalesce(TRY_CAST(json_extract(w, '$.word_score') AS DOUBLE), 0) > 0.01), lambda w: coalesce(json_extract_string(w, '$.word_text'), '')), ' ') AS scored,
  array_to_string(list_transform(list_filter(ws, lambda w: coalesce(TRY_CAST(json_extract(w, '$.word_score') AS DOUBLE), 0) <= 0.01), lambda w: coalesce(json_extract_string(w, '$.word_text'), '')), ' ') AS zero FROM d WHERE len(ws) > 0""",
    "phoneme_sequences": _SPOKEN + """SELECT id, array_to_string(list_filter(flatten(list_transform(ws, lambda w: list_transform(json_extract(w, '$.phonemes[*]'), lambda p: json_extract_string(p, '$.ipa_label')))), lambda x: x IS NOT NULL), ' ') AS seq FROM d
UNION ALL SELECT id, '' FROM c WHERE ws IS NULL""",
    "attempt_summary": "SELECT expected_text, count(*) AS attempts, CAST(sum(CAST(overall_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS average FROM (SELECT DISTINCT id, expected_text, overall_score FROM pronunciation_analyses) WHERE expected_text IS NOT NULL AND overall_score IS NOT NULL GROUP BY expected_text",
    "peak_normalize": f"SELECT vec_id, pos, v * 0.9::DOUBLE / max(abs(v)) OVER (PARTITION BY vec_id) AS value FROM {_V}",
    "noise_gate": f"""WITH a AS (SELECT vec_id, pos, v / (max(abs(v)) OVER (PARTITION BY vec_id) + 1e-8::DOUBLE) AS v FROM {_V}), b AS (SELECT vec_id, pos, CASE WHEN abs(v) < 0.2 THEN 0::DOUBLE ELSE v END AS v FROM a)
SELECT vec_id, pos, v * 0.9::DOUBLE / max(abs(v)) OVER (PARTITION BY vec_id) AS value FROM b""",
    "cosine_percent": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, list_dot_product(a.v, b.v) AS ab, list_dot_product(a.v, a.v) AS aa, list_dot_product(b.v, b.v) AS bb FROM e a JOIN e b ON b.vec_id + 1 = a.vec_id)
SELECT vec_id, CASE WHEN aa > 0 AND bb > 0 THEN (greatest(-1::DOUBLE, least(1::DOUBLE, ab / (sqrt(aa) * sqrt(bb)))) + 1) / 2 * 100 END AS percent FROM p""",
    "diphthong_split": _SEQ + "SELECT id, " + _each(f"coalesce({_lookup(fixed.SPLITS, 'p')}, p)") + " AS seq FROM q",
    "phoneme_repeats": _SEQ + """, r AS (SELECT id, len(seq) AS k, CASE WHEN len(seq) = 0 THEN 0 ELSE 1 + len(list_filter(range(2, len(seq) + 1), lambda i: seq[i] <> seq[i - 1])) END AS n FROM q)
SELECT id, n < k AS repeats, CAST(n AS INT) AS n FROM r""",
    "phoneme_map": _SEQ + f"""SELECT id, {_each(f"CASE WHEN ends_with(trim(p), 'ː') AND left(trim(p), length(trim(p)) - 1) IN ({fixed.KEEPS_LENGTH}) THEN trim(p) ELSE coalesce({_lookup(fixed.OXFORD, _BASE)}, {_BASE}) END")} AS oxford,
  {_each(_replaced("p"))} AS espeak, {_each(f"CASE WHEN p IN ({fixed.KNOWN}) THEN p WHEN p IN ('a', 'e', 'i', 'o', 'u') THEN 'ə' WHEN regexp_full_match(p, '[[:alpha:]]|\\p{{L}}') THEN p END")} AS known,
  {_each(_lookup(_BACK, "p"))} AS arpabet, {_each(f"CASE WHEN {_lookup(_BACK, 'p')} IS NOT NULL THEN p END")} AS back, {_each(f"CASE WHEN trim(p) NOT IN ({fixed.SILENCE}) THEN trim(p) END")} AS audible FROM q""",
    "phoneme_distance": f"""WITH v(s, f1, f2, f3) AS (VALUES {fixed.VOWELS}), k(s, f1, f2, f3) AS (VALUES {fixed.CONSONANTS}),
n(a, b) AS (VALUES {fixed.SYMBOLS}), g(s, i) AS (VALUES {fixed.ALIASES}),
i AS (SELECT s, coalesce(n.b, s) AS m FROM (SELECT s FROM v UNION SELECT s FROM k UNION SELECT s FROM g WHERE s <> '∅') LEFT JOIN n ON n.a = s),
x AS (SELECT a.s AS a, b.s AS b, EXISTS (SELECT 1 FROM g p JOIN g q USING (i) WHERE p.s = a.s AND q.s = b.s) AS alias,
  v1.s IS NOT NULL AND v2.s IS NOT NULL AS vowels, k1.s IS NOT NULL AND k2.s IS NOT NULL AS consonants,
  0.35::DOUBLE + CASE WHEN v1.f1 = v2.f1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN v1.f2 = v2.f2 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN v1.f3 = v2.f3 THEN 0.10::DOUBLE ELSE 0 END AS sv,
  0.30::DOUBLE + CASE WHEN k1.f1 = k2.f1 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN k1.f2 = k2.f2 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN k1.f3 = k2.f3 THEN 0.10::DOUBLE ELSE 0 END AS sk
  FROM i a CROSS JOIN i b LEFT JOIN v v1 ON v1.s = a.m LEFT JOIN v v2 ON v2.s = b.m LEFT JOIN k k1 ON k1.s = a.m LEFT JOIN k k2 ON k2.s = b.m)
SELECT a, b, CASE WHEN a = b THEN 0::DOUBLE WHEN alias THEN 0.05::DOUBLE WHEN vowels THEN 1::DOUBLE - least(sv, 0.98::DOUBLE) WHEN consonants THEN 1::DOUBLE - least(sk, 0.95::DOUBLE) ELSE 1::DOUBLE - 0.15::DOUBLE END AS distance FROM x""",
    "attempt_words": _SPOKEN + """, t AS (SELECT DISTINCT id, expected_text FROM pronunciation_analyses), x AS (SELECT expected_text, unnest(ws) AS w FROM d JOIN t USING (id)),
y AS (SELECT expected_text, json_extract_string(w, '$.word_text') AS word_text, TRY_CAST(json_extract_string(w, '$.word_score') AS DECIMAL(18,6)) AS s FROM x)
SELECT expected_text, word_text, CASE WHEN count(s) > 0 THEN CAST(sum(s) AS DOUBLE) / count(s) END AS average, count(*) AS n FROM y GROUP BY expected_text, word_text""",
    "voiced_spans": f"""WITH a AS (SELECT vec_id, pos, v * v >= 0.1::DOUBLE * max(v * v) OVER (PARTITION BY vec_id) AS loud FROM {_V}), b AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM a WHERE loud)
SELECT vec_id, CAST(min(pos) AS DOUBLE) AS start, CAST(max(pos) + 1 AS DOUBLE) AS "end" FROM b GROUP BY vec_id, run""",
    "interval_contain": texts._W.replace("o AS (", "o AS MATERIALIZED (") + """, b AS (SELECT *, trim(lower(word), '.,!?') AS b FROM o), c AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM b),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
u AS MATERIALIZED (SELECT doc_id, min(b) AS label, CAST(min(start) AS DOUBLE) AS s, CAST(max(start + length(word)) AS DOUBLE) AS e FROM r GROUP BY doc_id, run HAVING count(*) > 1),
i AS MATERIALIZED (SELECT doc_id, word AS label, CAST(start AS DOUBLE) AS s, CAST(start + length(word) AS DOUBLE) AS e FROM o WHERE regexp_replace(lower(word), '[^a-z0-9'']+', '', 'g') NOT IN ('', 'sil', 'sp'))
SELECT u.doc_id, u.label AS outer_label, u.s AS outer_start, u.e AS outer_end, i.label AS inner_label, i.s AS inner_start, i.e AS inner_end FROM u JOIN i ON u.doc_id = i.doc_id AND i.s + 0.0001 >= u.s AND i.e - 0.0001 <= u.e""",
    "pause_gaps": f"""WITH a AS (SELECT vec_id, pos, lag(pos) OVER (PARTITION BY vec_id ORDER BY pos) AS last FROM {_V} WHERE abs(v) >= 0.1)
SELECT vec_id, CAST(last + 1 AS DOUBLE) AS start, CAST(pos - last - 1 AS DOUBLE) AS duration FROM a WHERE pos - last - 1 >= 2""",
    "segment_bounds": """WITH a AS (SELECT DISTINCT id, audio_duration_ms AS ms FROM api_usage_logs WHERE audio_duration_ms IS NOT NULL),
b AS (SELECT id, CAST(ms AS BIGINT) * 16 AS n, greatest(0, floor(greatest(0::DOUBLE, ms / 4000 - 0.05::DOUBLE) * 16000)) AS a, floor(least(CAST(ms AS BIGINT) * 16 / 16000, ms / 2000 + 0.05::DOUBLE) * 16000) AS b FROM a)
SELECT id, CAST(a AS BIGINT) AS "from", CAST(CASE WHEN least(n, b) <= a THEN least(n, a + 1600) ELSE least(n, b) END AS BIGINT) AS "to" FROM b""",
    "speech_rate": texts.fillers_sql(_TIMED, "id", "predicted_text") + f""", c AS (SELECT l.id, ms / 1000 AS s, len({texts._split("x")}) AS n, f.k, f.skipped
  FROM (SELECT id, predicted_text AS x, audio_duration_ms AS ms FROM {_TIMED}) l LEFT JOIN (SELECT k.id, count(*) AS k, count(DISTINCT len({texts._split("left(t.predicted_text, k.start)")})) AS skipped FROM kept k JOIN {_TIMED} t ON t.id = k.id GROUP BY k.id) f ON f.id = l.id)
SELECT id, CASE WHEN s <> 0 THEN round_even((n - coalesce(skipped, 0)) / s * 60, 0) ELSE 0 END::DOUBLE AS rate, CASE WHEN s > 0 THEN coalesce(k, 0) / s * 60 ELSE 0 END::DOUBLE AS fillers_per_minute FROM c""",
    "word_phoneme_zip": _SPOKEN.replace("WITH a AS", "WITH t AS (SELECT DISTINCT id, expected_text FROM pronunciation_analyses WHERE expected_text IS NOT NULL), a AS", 1) + f""",
x AS (SELECT id, regexp_extract_all(expected_text, '{fixed.TOKEN}') AS es, coalesce(d.ws, []) AS ws FROM t LEFT JOIN d USING (id)),
y AS (SELECT id, unnest(es) AS word, CAST(generate_subscripts(es, 1) - 1 AS INT) AS pos, ws FROM x)
SELECT id, pos, word, json_extract_string(ws[pos + 1], '$.word_text') AS scored_word,
  CAST(CASE json_type(ws[pos + 1], '$.phonemes') WHEN 'ARRAY' THEN len(list_filter(json_extract(ws[pos + 1], '$.phonemes[*]'), lambda p: json_type(p) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END AS INT) AS n_phonemes FROM y""",
    "observed_lexicon": _SPOKEN + """, w AS (SELECT unnest(ws) AS w FROM d),
x AS (SELECT lower(json_extract_string(w, '$.word_text')) AS word, array_to_string(list_filter(list_transform(json_extract(w, '$.phonemes[*]'), lambda p: json_extract_string(p, '$.ipa_label')), lambda p: p IS NOT NULL), ' ') AS sounds FROM w),
n AS (SELECT word, sounds, count(*) AS n FROM x WHERE word IS NOT NULL AND sounds <> '' GROUP BY word, sounds)
SELECT word, sounds, n FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, string_split(sounds, ' ')) = 1""",
    "phoneme_coverage": f"""WITH t AS (SELECT DISTINCT id, expected_text, predicted_text FROM pronunciation_analyses),
s AS (SELECT id, {_SOUNDS("expected_text")} AS e, {_SOUNDS("predicted_text")} AS r FROM t)
SELECT id, r / greatest(e, 1) AS coverage, CASE WHEN r < 3 OR r / greatest(e, 1) < 0.3::DOUBLE THEN 92::DOUBLE END AS fallback_score FROM s""",
    "rate_over_time": f"""WITH v AS (SELECT vec_id, pos // 16 AS chunk, pos, abs(v) AS a FROM {_V}), p AS (SELECT *, max(a) OVER (PARTITION BY vec_id, chunk) AS top FROM v),
l AS (SELECT vec_id, chunk, min(pos) FILTER (a > top * 0.1::DOUBLE) AS first, max(pos) FILTER (a > top * 0.1::DOUBLE) AS last FROM p GROUP BY ALL),
h AS (SELECT vec_id, chunk, count(*) AS n, avg(a) AS mean FROM p JOIN l USING (vec_id, chunk) WHERE pos BETWEEN first AND last GROUP BY ALL)
SELECT vec_id, CAST(chunk AS INT) AS pos, greatest(0, round_even(12 / 4 * (n / 8 / 2) * least(1.5::DOUBLE, greatest(0.5::DOUBLE, mean * 1000)) / 2 * 60 * (1 + 0.1::DOUBLE * sin(chunk * 0.5::DOUBLE)), 0))::DOUBLE AS value FROM h""",
    "speech_pauses": f"""WITH f AS (SELECT vec_id, k, sum(v * v) / 4 AS power FROM {_V}, (SELECT unnest(range(0, 33)) AS k) WHERE pos >= 2 * k - 2 AND pos < 2 * k + 2 GROUP BY ALL),
n AS (SELECT vec_id, k, 10 * log10(greatest(power, 1e-10::DOUBLE) / greatest(max(power) OVER (PARTITION BY vec_id), 1e-10::DOUBLE)) > -6 AS is_on FROM f),
r AS (SELECT vec_id, k, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS run FROM n WHERE is_on),
s AS (SELECT vec_id, least(min(k) * 2, 64) AS a, least((max(k) + 1) * 2, 64) AS b FROM r GROUP BY vec_id, run),
g AS (SELECT vec_id, lag(b) OVER (PARTITION BY vec_id ORDER BY a) AS b, a FROM s)
SELECT vec_id, CAST(floor(b * 0.05::DOUBLE) AS INT) AS start_index, CAST(floor(b * 0.05::DOUBLE) AS INT) AS end_index, round_even((a - b) / 2, 1) AS duration FROM g WHERE (a - b) / 2 >= 1""",
    "word_spans": f"""WITH l AS (SELECT DISTINCT id, expected_text, audio_duration_ms AS ms FROM api_usage_logs WHERE audio_duration_ms IS NOT NULL AND expected_text IS NOT NULL),
n AS (SELECT id, ms, ms / 1000 AS s, len(regexp_extract_all(expected_text, '{fixed.TOKEN}')) AS n FROM l), w AS (SELECT *, CAST(unnest(range(0, n)) AS INT) AS pos FROM n)
SELECT id, pos, CASE WHEN ms % 3 = 0 AND pos < 2 THEN s * (pos * 0.25::DOUBLE) ELSE pos * (s / n) END AS start, CASE WHEN ms % 3 = 0 AND pos < 2 THEN s * ((pos + 1) * 0.25::DOUBLE) ELSE least(s, pos * (s / n) + s / n) END AS "end" FROM w""",
    "words_with_phones": texts._W.replace("o AS (", "o AS MATERIALIZED (") + """, b AS (SELECT *, trim(lower(word), '.,!?') AS b FROM o), c AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM b),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
u AS MATERIALIZED (SELECT doc_id, min(b) AS label, CAST(min(start) AS DOUBLE) AS s, CAST(max(start + length(word)) AS DOUBLE) AS e FROM r GROUP BY doc_id, run HAVING count(*) > 1),
i AS MATERIALIZED (SELECT doc_id, word AS label, CAST(start AS DOUBLE) AS s, CAST(start + length(word) AS DOUBLE) AS e FROM o WHERE length(word) > 3 AND regexp_replace(lower(word), '[^a-z0-9'']+', '', 'g') NOT IN ('', 'sil', 'sp'))
SELECT u.doc_id, u.label, u.s AS start, u.e AS "end", CAST(count(i.label) AS INT) AS n, coalesce(string_agg(i.label, ' ' ORDER BY i.s), '') AS phones
FROM u LEFT JOIN i ON u.doc_id = i.doc_id AND i.s + 0.0001 >= u.s AND i.e - 0.0001 <= u.e WHERE regexp_replace(u.label, '[^a-z0-9'']+', '', 'g') NOT IN ('', 'sil', 'sp') GROUP BY u.doc_id, u.label, u.s, u.e""",
}
