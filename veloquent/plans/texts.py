"""Queries of text and fluency functions, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.functions import sequence, text
from veloquent.plans import fixed
from veloquent.tables import once, table

_T = F.col


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(text.tokens(_T("text"))).alias("pos", "word"))


def word_normalize(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", F.posexplode(text.split_words(_T("text"))).alias("pos", "word"))
    return words.select("doc_id", "pos", text.normal_word(_T("word")).alias("word"))


def word_variants(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(text.tokens(_T("text"))).alias("word")).select(text.normal_word(_T("word")).alias("word")).distinct()
    return words.select("word", F.array_join(text.variants(_T("word")), " ").alias("forms"))


def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.text_hash(_T("text")).alias("hash"), F.sha2(_T("text"), 256).alias("exact"), F.md5("text").alias("md5"))


def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.collapse(_T("text")).alias("text"))


def truncate_preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.truncated(_T("text")).alias("text"), text.truncated(_T("text"), 500).alias("preview"))


def strip_mark_tags(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.without_tag(_T("text")).alias("text"))


def discourse_markers(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", F.inline(sequence.offsets_udf("text")))
    kinds = F.create_map(*[F.lit(x) for kv in text.DISCOURSE.items() for x in kv])
    x = words.withColumn("marker", text.bare(F.lower("word"))).withColumn("description", kinds[_T("marker")]).filter(_T("description").isNotNull())
    return x.select("doc_id", _T("marker").alias("text"), _T("start").alias("start_index"), (_T("start") + F.length("marker")).alias("end_index"), "description")


def char_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(sequence.offsets_udf("text")).alias("pos", "w")).select("doc_id", "pos", "w.word", "w.start")


def repetitions(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.inline(sequence.repetitions_udf("text")))


def fillers_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.inline(sequence.fillers_udf("text")))


def number_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(_T("text").rlike("[0-9]")).select("doc_id", sequence.spoken_udf("text").alias("text"))


def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(_T("text").isNotNull()).select("doc_id", text.diversity(_T("text")).alias("diversity"))


def marker_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"advanced": text.ADVANCED, "complex": text.COMPLEX, "connectors": text.CONNECTORS}
    return _docs(spark, d).select("doc_id", *[text.kinds_present(_T("text"), v).alias(k) for k, v in kinds.items()])


def ielts_heuristics(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).filter(_T("text").isNotNull()).withColumn("n", F.size(text.split_words(_T("text"))))
    return x.select("doc_id", "n", *[c.alias(k) for k, c in text.band_scores(_T("text"), _T("n")).items()])


def _analyses(spark: SparkSession, d: str) -> DataFrame:
    """Analyses once, with their metrics document opened."""
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "overall_score", "speech_metrics", "ielts_score", "grammar_analysis")
    inner = F.coalesce(F.try_variant_get(F.try_parse_json("speech_metrics"), "$", "string"), _T("speech_metrics"))
    m = F.from_json(F.when(F.try_parse_json("speech_metrics").isNotNull(), inner), "speech_rate double, filler_words int, pauses int")
    return rows.select("id", _T("overall_score").cast("double").alias("overall_score"), m.alias("m"), F.try_variant_get(F.try_parse_json("grammar_analysis"), "$.lexical_band_score", "double").alias("lexical"), F.try_variant_get(F.try_parse_json("grammar_analysis"), "$.grammar_score", "double").alias("grammar"))


def fluency_score(spark: SparkSession, d: str) -> DataFrame:
    x = _analyses(spark, d).filter(_T("m.speech_rate").isNotNull())
    return x.select("id", text.fluency_score(_T("m.speech_rate"), _T("m.filler_words"), _T("m.pauses")).alias("fluency"))


def ielts_band(spark: SparkSession, d: str) -> DataFrame:
    x = _analyses(spark, d).filter(_T("overall_score").isNotNull())
    fluency = F.when(_T("m.speech_rate").isNotNull(), text.fluency_score(_T("m.speech_rate"), _T("m.filler_words"), _T("m.pauses")))
    return x.select("id", *[c.alias(k) for k, c in text.band(fluency, _T("lexical"), _T("grammar"), _T("overall_score")).items()])


def word_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    return rows.select("id", F.inline(sequence.word_diff_udf("expected_text", "predicted_text")))


def tagged_text(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    return rows.select("id", sequence.tagged_udf("expected_text", "predicted_text").alias("tagged"))


def reading_match(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text")
    return rows.select("id", text.same_text(_T("expected_text"), _T("predicted_text")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_words, word_normalize, word_variants, text_hash, collapse_ws, truncate_preview, strip_mark_tags, discourse_markers, char_offsets, repetitions, fillers_text, number_words,
        lexical_diversity, marker_kinds, ielts_heuristics, fluency_score, ielts_band, word_diff, tagged_text, reading_match,
    )
}

_S = fixed.SPACE


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'), ' ')"


def _split(x: str) -> str:
    return f"list_filter(string_split({_collapse(x)}, ' '), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_ENDINGS = (("ies", 3, 3, "y"), ("es", 2, 2, ""), ("s", 1, 1, ""), ("ed", 2, 2, ""), ("ed", 2, 1, ""), ("ing", 4, 3, ""), ("ing", 4, 3, "e"), ("er", 3, 2, ""))
_BANDS = """WITH a AS (SELECT id, CAST(overall_score AS DOUBLE) AS s, TRY_CAST(speech_metrics AS JSON) AS j, TRY_CAST(grammar_analysis AS JSON) AS g FROM (SELECT DISTINCT id, overall_score, speech_metrics, grammar_analysis FROM pronunciation_analyses)),
b AS (SELECT id, s, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j, g FROM a),
c AS (SELECT id, s, TRY_CAST(json_extract_string(j, '$.speech_rate') AS DOUBLE) AS r, coalesce(TRY_CAST(json_extract_string(j, '$.filler_words') AS INT), 0) AS n, coalesce(TRY_CAST(json_extract_string(j, '$.pauses') AS INT), 0) AS p,
  TRY_CAST(json_extract_string(g, '$.lexical_band_score') AS DOUBLE) AS lexical, TRY_CAST(json_extract_string(g, '$.grammar_score') AS DOUBLE) AS grammar FROM b),
f AS (SELECT id, s, lexical, grammar, CASE WHEN r IS NOT NULL THEN greatest(1, least(9, round_even(5 + CASE WHEN r BETWEEN 150 AND 200 THEN 1 WHEN r < 100 OR r > 250 THEN -1 ELSE 0 END
  + CASE WHEN n <= 2 THEN 0.5 WHEN n > 5 THEN -1 ELSE 0 END + CASE WHEN p <= 1 THEN 0.5 WHEN p > 3 THEN -0.5 ELSE 0 END, 0))) END::DOUBLE AS fluency FROM c)
"""
_W = f"""WITH a AS (SELECT doc_id, {_split("text")} AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM a),
o AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)
"""
_PRESENT = lambda marks: f"CAST(len(list_filter([{marks}], lambda m: contains(lower(text), m))) AS INT)"


def _cuts(values, cuts=(15, 30, 50)) -> str:
    return "CASE " + " ".join(f"WHEN n < {c} THEN {v}" for c, v in zip(cuts, values)) + f" ELSE {values[-1]} END"


def fillers_sql(source: str, key: str, column: str) -> str:
    """CTEs that end in ``kept`` (key, start, stop, raw, sound): the fillers of a text column, near ones after another left out."""
    at = lambda n: f"lead(plain, {n}) OVER w"
    return f"""WITH RECURSIVE a AS (SELECT {key}, {_split(f"lower({column})")} AS ws FROM {source} WHERE {column} IS NOT NULL),
w AS (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM a),
o AS (SELECT *, trim(word, '.,!?') AS plain, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM w),
n AS (SELECT *, coalesce(lag(plain) OVER w, '') AS before, coalesce({at(1)}, '') AS next, coalesce({at(2)}, '') AS second, lead(word) OVER w AS next_word FROM o WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
h AS MATERIALIZED (SELECT {key}, start, CASE WHEN plain = 'you' THEN word || ' ' || next_word ELSE word END AS raw, CASE WHEN plain = 'you' THEN 'you know' ELSE plain END AS sound FROM n
  WHERE plain IN ('uh', 'um', 'hmm', 'er', 'ah', 'mm', 'erm', 'eh', 'oh')
  OR (plain = 'like' AND (pos = 0 OR before IN ('was', 'am', 'is', 'were', 'like') OR next IN ('uh', 'um', 'er', 'ah', 'you', 'totally', 'really', 'literally', 'like')))
  OR (plain = 'you' AND next = 'know' AND (before = '' OR second IN ('', 'like', 'uh', 'um')))),
p AS MATERIALIZED (SELECT *, min(start) OVER (PARTITION BY {key} ORDER BY start RANGE BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM h),
chain({key}, start) AS (SELECT {key}, min(start) FROM h GROUP BY {key} UNION ALL SELECT c.{key}, p.following FROM chain c JOIN p ON p.{key} = c.{key} AND p.start = c.start WHERE p.following IS NOT NULL),
kept AS (SELECT {key}, start, CAST(start + length(raw) AS INT) AS stop, raw, sound FROM h JOIN chain USING ({key}, start))
"""


ORACLES = {
    "fillers_text": fillers_sql("documents", "doc_id", "text") + "SELECT doc_id, raw AS text, start AS start_index, stop AS end_index, sound AS phonemes FROM kept",
    "tokenize_words": f"WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{fixed.TOKEN}') AS ws FROM documents) SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS pos, unnest(ws) AS word FROM a",
    "word_normalize": _W + "SELECT doc_id, CAST(pos AS INT) AS pos, regexp_replace(lower(word), '[^a-z0-9'']+', '', 'g') AS word FROM w",
    "text_hash": f"SELECT doc_id, sha256({_collapse('lower(text)')}) AS hash, sha256(text) AS exact, md5(text) AS md5 FROM documents",
    "collapse_ws": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
    "truncate_preview": "SELECT doc_id, nullif(array_to_string(list_slice(regexp_extract_all(text, '(?s).'), 1, 1000), ''), '') AS text, nullif(array_to_string(list_slice(regexp_extract_all(text, '(?s).'), 1, 500), ''), '') AS preview FROM documents",
    "strip_mark_tags": f"SELECT doc_id, {_collapse('''regexp_replace(text, '<mark[^>]*>(.*?)</mark>', '\\1', 'g')''')} AS text FROM documents",
    "discourse_markers": _W + f"SELECT doc_id, m AS text, CAST(start AS INT) AS start_index, CAST(start + length(m) AS INT) AS end_index, description FROM (SELECT *, trim(lower(word), '.,!?') AS b FROM o) JOIN (VALUES {fixed.DISCOURSE}) AS k(m, description) ON b = m",
    "char_offsets": _W + "SELECT doc_id, CAST(pos AS INT) AS pos, word, CAST(start AS INT) AS start FROM o",
    "repetitions": _W + """, b AS (SELECT *, trim(lower(word), '.,!?') AS b FROM o), c AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM b),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c)
SELECT doc_id, min(b) AS text, CAST(min(start) AS INT) AS start_index, CAST(max(start + length(word)) AS INT) AS end_index, CAST(count(*) AS INT) AS repeat_count FROM r GROUP BY doc_id, run HAVING count(*) > 1""",
    "lexical_diversity": f"SELECT doc_id, len(list_distinct(ws)) / greatest(len(ws), 1) AS diversity FROM (SELECT doc_id, {_split('lower(text)')} AS ws FROM documents WHERE text IS NOT NULL)",
    "marker_kinds": "SELECT doc_id, " + ", ".join(f"CASE WHEN text IS NOT NULL THEN {_PRESENT(v)} END AS {k}" for k, v in (("advanced", fixed.ADVANCED), ("complex", fixed.COMPLEX), ("connectors", fixed.CONNECTORS))) + " FROM documents",
    "ielts_heuristics": f"""WITH a AS (SELECT doc_id, text, CAST(len({_split('text')}) AS INT) AS n, CAST(len(list_distinct({_split('lower(text)')})) AS DOUBLE) / greatest(len({_split('lower(text)')}), 1) AS d,
  greatest(len(list_filter(string_split(text, '.'), lambda s: {_collapse('s')} <> '')), 1) AS s, {_PRESENT(fixed.ADVANCED)} AS ka, {_PRESENT(fixed.COMPLEX)} AS kg, {_PRESENT(fixed.CONNECTORS)} AS kc FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, ka / greatest(n / 20, 1.0::DOUBLE) AS ar, n / s AS mean, kg / s AS gr, kc / s AS cr FROM a),
c AS (SELECT doc_id, n, least({_cuts((2.5, 5.5, 6.5, 9.0))}::DOUBLE, {_cuts(('0.5::DOUBLE + d * 1.5::DOUBLE', '3::DOUBLE + d * 2::DOUBLE', '3.5::DOUBLE + d * 2.5::DOUBLE', '4::DOUBLE + d * 3::DOUBLE'))} + CASE WHEN n >= 30 THEN least(2::DOUBLE, ar * 2::DOUBLE) ELSE least(0.5::DOUBLE, ar) END) AS lexical,
  least(9::DOUBLE, {_cuts((3, 4, 5, 5.5))}::DOUBLE + CASE WHEN mean BETWEEN 15 AND 25 THEN 1.5 WHEN mean BETWEEN 10 AND 30 THEN 1.0 ELSE 0 END::DOUBLE + CASE WHEN n >= 30 THEN least(2::DOUBLE, gr * 3::DOUBLE) ELSE least(0.5::DOUBLE, gr) END) AS grammar,
  least(9::DOUBLE, {_cuts((2, 3, 3.5, 4, 5), (10, 20, 30, 50))}::DOUBLE + (CASE WHEN n >= 75 THEN 1 ELSE 0 END + CASE WHEN n >= 120 THEN 1 ELSE 0 END + CASE WHEN n >= 180 THEN 0.5 ELSE 0 END)::DOUBLE) AS task,
  least({_cuts((4, 5, 6, 9))}::DOUBLE, {_cuts((2.5, 3, 4, 5))}::DOUBLE + CASE WHEN n >= 30 THEN least(2.5::DOUBLE, cr * 4::DOUBLE) ELSE least(0.5::DOUBLE, cr * 2::DOUBLE) END) AS coherence FROM b)
SELECT *, lexical * 0.25::DOUBLE + grammar * 0.25::DOUBLE + task * 0.25::DOUBLE + coherence * 0.25::DOUBLE AS overall FROM c""",
    "reading_match": f"SELECT DISTINCT id, {_strip('lower(expected_text)')} = {_strip('lower(predicted_text)')} AS same FROM pronunciation_analyses",
    "word_variants": f"""WITH w AS (SELECT DISTINCT regexp_replace(lower(unnest(regexp_extract_all(coalesce(text, ''), '{fixed.TOKEN}'))), '[^a-z0-9'']+', '', 'g') AS word FROM documents),
v AS (SELECT word, [word, {", ".join(f"CASE WHEN word LIKE '%{e}' AND length(word) > {k} THEN left(word, length(word) - {n}) || '{a}' END" for e, k, n, a in _ENDINGS)}] AS fs FROM w),
u AS (SELECT word, unnest(fs) AS f, generate_subscripts(fs, 1) AS k FROM v)
SELECT w.word, coalesce(string_agg(f, ' ' ORDER BY k), '') AS forms FROM w LEFT JOIN (SELECT word, f, min(k) AS k FROM u WHERE f <> '' GROUP BY word, f) USING (word) GROUP BY w.word""",
    "fluency_score": _BANDS + "SELECT id, fluency FROM f WHERE fluency IS NOT NULL",
    "ielts_band": _BANDS + """, g AS (SELECT id, coalesce(fluency, 5) AS f, coalesce(lexical, 5) AS l, coalesce(grammar, 5) AS g, greatest(1, least(9, s / 11.11::DOUBLE)) AS p FROM f WHERE s IS NOT NULL)
SELECT id, greatest(1, least(9, f)) AS fluency_coherence, greatest(1, least(9, l)) AS lexical_resource, greatest(1, least(9, g)) AS grammatical_range, p AS pronunciation, greatest(1, least(9, round_even((f + l + g + p) / 4 * 2, 0) / 2)) AS overall_band FROM g""",
}
