"""Queries of sources and sinks: payloads, keys of stored objects, dictionaries, reports, the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent import session
from veloquent.functions import text
from veloquent.plans import fixed, speech, texts
from veloquent.sources import audio, introspect, payload, sinks, textgrid
from veloquent.tables import once, table


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    """Where a request's audio would be stored: key, question and hash as a path, absent parts left out."""
    logs = once(table(spark, d, "api_usage_logs"), "id", "api_key_id", "tenant_id", "audio_hash").filter("audio_hash IS NOT NULL")
    return logs.select("id", text.object_key(F.col("tenant_id"), F.col("api_key_id"), F.concat("audio_hash", F.lit(".wav"))).alias("key"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "expected_text", "predicted_text", "use_audio_used", "deep_analysis_used")
    hit = payload.cache_hit(text.text_hash(F.col("expected_text")), text.text_hash(F.col("predicted_text")), F.col("use_audio_used"), F.col("deep_analysis_used"))
    return rows.select("id", hit.alias("hit"))


def json_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the grammar feedback with defaults where they are missing."""
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "grammar_analysis")
    x = payload.with_defaults(rows, "grammar_analysis", {"strengths": [], "improvements": [], "lexical_band_score": 5.0, "corrected_text": ""})
    return x.select("id", F.array_join("strengths", " | ").alias("strengths"), F.array_join("improvements", " | ").alias("improvements"), "lexical_band_score", "corrected_text")


def dictionary_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.dictionary(table(spark, d, "documents"), "text")


def score_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of the mean score per accent."""
    rows = once(table(spark, d, "pronunciation_analyses"), "id", "target_accent", "overall_score").filter("overall_score IS NOT NULL")
    total = F.sum(F.col("overall_score").cast("decimal(18,4)")).cast("double")
    means = rows.groupBy(F.coalesce("target_accent", F.lit("none")).alias("accent")).agg((total / F.count(F.lit(1))).alias("score"))
    return sinks.report(means, "accent", "score")


def nested_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as JSON text, as a store without arrays takes them."""
    return sinks.nested_as_json(table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * 1000)).alias("embedding")))


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    introspect.register(spark, d)
    return introspect.columns(spark)


def _bytes(n, width: int):
    """A whole number as hexadecimal digits of ``width`` bytes, the lowest first; negative ones as two's complement."""
    digits = F.lpad(F.hex(F.pmod(n.cast("bigint"), F.lit(1 << 8 * width))), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])


def audio_decode(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as 16-bit WAV files in memory, decoded again with their peak at 0.9."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * 1000)).alias("x"))
    data = F.array_join(F.transform("x", lambda v: _bytes(v, 2)), "")
    size, rate = 2 * F.size("x"), F.lit(audio.RATE)
    text = lambda t: F.lit(t.encode().hex())
    head = F.concat(text("RIFF"), _bytes(size + 36, 4), text("WAVEfmt "), _bytes(F.lit(16), 4), _bytes(F.lit(1), 2), _bytes(F.lit(1), 2), _bytes(rate, 4), _bytes(2 * rate, 4), _bytes(F.lit(2), 2), _bytes(F.lit(16), 2), text("data"), _bytes(size, 4))
    wav = vectors.select("vec_id", F.unhex(F.concat(head, data)).alias("wav"))
    return wav.select("vec_id", F.posexplode(audio.samples("wav")).alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


def textgrid_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Scored words and their sounds written as TextGrids, one second each, and read again; blank labels go."""
    tier = lambda name, labels: F.concat(F.lit(f'item:\n name = "{name}"\n'), F.array_join(F.transform(labels, lambda x, i: interval(x, i)), ""))
    interval = lambda x, i: F.concat(F.lit(" xmin = "), i.cast("string"), F.lit("\n xmax = "), (i + 1).cast("string"), F.lit('\n text = "'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"\n'))
    words = F.transform("words", lambda w: w["word_text"])
    sounds = F.flatten(F.transform("words", lambda w: F.transform(w["phonemes"], lambda p: p["ipa_label"])))
    return speech._spoken(spark, d).select("id", F.inline(textgrid.intervals(F.concat(tier("words", words), tier("phones", sounds)))))


def payload_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cached reference documents made of scored words, and opened again: symbols and words in each."""
    word = lambda w: F.struct(w["word_text"].alias("word_text"), F.transform(w["phonemes"], lambda p: p["ipa_label"]).alias("phonemes"))
    doc = F.to_json(F.struct(F.flatten(F.transform("words", lambda w: F.transform(w["phonemes"], lambda p: p["ipa_label"]))).alias("ipa_sequence"), F.transform("words", word).alias("word_phonemes")))
    x = speech._spoken(spark, d).select("id", payload.reference_payload(doc).alias("p"))
    longest = F.array_max(F.transform("p.word_phonemes", lambda w: F.size(w["phonemes"])))
    return x.select("id", F.size("p.ipa_sequence").alias("n_symbols"), F.size("p.word_phonemes").alias("n_words"), longest.alias("longest"))


def appended_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs appended to a partitioned table in two parts, and read back."""
    path = session.new_path(spark, "appended")
    logs = once(table(spark, d, "api_usage_logs"), "id", "endpoint", "method")
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    for part in (logs.filter(odd), logs.filter(~odd)):
        sinks.append(part, path, ["method"])
    return spark.read.parquet(path).select("id", "endpoint", "method")


QUERIES = {f.__name__: f for f in (object_keys, cache_hits, json_defaults, dictionary_lines, score_report, nested_as_json, table_columns, audio_decode, textgrid_intervals, payload_counts, appended_logs)}


def _hash(x: str) -> str:
    return f"sha256({texts._collapse(f'lower({x})')})"


def _list(key: str) -> str:
    return f"CASE json_type(j, '$.{key}') WHEN 'ARRAY' THEN array_to_string(json_extract_string(j, '$.{key}[*]'), ' | ') WHEN 'NULL' THEN '' ELSE coalesce(json_extract_string(j, '$.{key}'), '') END"


ORACLES = {
    "object_keys": "SELECT DISTINCT id, concat_ws('/', nullif(trim(tenant_id), ''), nullif(trim(api_key_id), ''), audio_hash || '.wav') AS key FROM api_usage_logs WHERE audio_hash IS NOT NULL",
    "cache_hits": f"SELECT DISTINCT id, coalesce(use_audio_used AND {_hash('expected_text')} = {_hash('predicted_text')} AND NOT coalesce(deep_analysis_used, false), false) AS hit FROM pronunciation_analyses",
    "json_defaults": f"""WITH a AS (SELECT id, TRY_CAST(grammar_analysis AS JSON) AS j FROM (SELECT DISTINCT id, grammar_analysis FROM pronunciation_analyses))
SELECT id, coalesce({_list('strengths')}, '') AS strengths, coalesce({_list('improvements')}, '') AS improvements, coalesce(TRY_CAST(json_extract_string(j, '$.lexical_band_score') AS DOUBLE), 5) AS lexical_band_score,
  coalesce(json_extract_string(j, '$.corrected_text'), '') AS corrected_text FROM a""",
    "nested_as_json": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda v: CAST(floor(CAST(v AS FLOAT) * 1000::FLOAT) AS BIGINT)), ',') || ']' AS embedding FROM embeddings",
    "dictionary_lines": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{fixed.TOKEN}')) AS word FROM documents WHERE text IS NOT NULL),
l AS (SELECT word, array_to_string(list_filter(list_transform(regexp_extract_all(word, 'igh|tch|sh|ch|th|ph|ng|ee|ea|oo|ou|ow|ai|ay|oi|oy|ck|qu|wh|[a-z]'), lambda m: map_from_entries([{fixed.LETTERS}])[m]), lambda x: x IS NOT NULL), ' ') AS sounds FROM w)
SELECT word || chr(9) || sounds AS value FROM l WHERE sounds <> ''""",
    "score_report": """WITH m AS (SELECT coalesce(target_accent, 'none') AS accent, CAST(sum(CAST(overall_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS score
  FROM (SELECT DISTINCT id, target_accent, overall_score FROM pronunciation_analyses WHERE overall_score IS NOT NULL) GROUP BY 1)
SELECT printf('| %s | %.2f |', accent, score) AS value FROM m UNION ALL SELECT printf('Mean: %.2f over %d rows', coalesce(avg(score), 0), count(*)) || chr(10) || chr(10) || '| name | score |' || chr(10) || '|-|-|' FROM m""",
    "table_columns": """SELECT table_name, CAST(ordinal_position - 1 AS INT) AS position, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
  ELSE lower(data_type) END AS data_type, is_nullable = 'YES' AS nullable FROM information_schema.columns
WHERE table_name IN ('api_keys', 'api_keys_tenants', 'api_usage_logs', 'context_sizes', 'documents', 'pronunciation_analyses', 'tenants')""",
    "audio_decode": """WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS FLOAT) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos FROM embeddings),
s AS (SELECT vec_id, pos, CAST(floor(v * 1000::FLOAT) AS DOUBLE) / 32768 AS x FROM v), m AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS top FROM s)
SELECT vec_id, pos, round(CAST(CAST(CASE WHEN top > 0 THEN x * 0.9::DOUBLE / top ELSE x END AS FLOAT) AS DOUBLE), 5) AS value FROM m""",
    "textgrid_intervals": speech._SPOKEN + """, w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
p AS (SELECT id, unnest(flatten(list_transform(ws, lambda w: CASE json_type(w, '$.phonemes') WHEN 'ARRAY' THEN list_filter(json_extract(w, '$.phonemes[*]'), lambda p: json_type(p) = 'OBJECT') ELSE CAST([] AS JSON[]) END))) AS p,
  generate_subscripts(flatten(list_transform(ws, lambda w: CASE json_type(w, '$.phonemes') WHEN 'ARRAY' THEN list_filter(json_extract(w, '$.phonemes[*]'), lambda p: json_type(p) = 'OBJECT') ELSE CAST([] AS JSON[]) END)), 1) - 1 AS pos FROM d)
SELECT id, tier, trim(label) AS label, CAST(pos AS DOUBLE) AS start, CAST(pos + 1 AS DOUBLE) AS "end" FROM (SELECT id, 'words' AS tier, json_extract_string(w, '$.word_text') AS label, pos FROM w
  UNION ALL SELECT id, 'phones', json_extract_string(p, '$.ipa_label'), pos FROM p) WHERE trim(label) <> ''""",
    "payload_counts": speech._SPOKEN + """, n AS (SELECT id, list_transform(ws, lambda w: len(list_filter(json_extract(w, '$.phonemes[*]'), lambda p: trim(json_extract_string(p, '$.ipa_label')) <> ''))) AS n FROM d)
SELECT id, CAST(coalesce(list_sum(n), 0) AS INT) AS n_symbols, CAST(len(n) AS INT) AS n_words, CAST(list_max(n) AS INT) AS longest FROM n
UNION ALL SELECT id, 0, 0, NULL FROM c WHERE ws IS NULL""",
    "appended_logs": "SELECT DISTINCT id, endpoint, method FROM api_usage_logs",
}
