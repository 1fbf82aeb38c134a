"""The queries pN_ of the general problems (features, rolling totals, sessions, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.operators import features, nested, rolling, sessions
from veloquent.tables import table

_AREAS = (
    "admin/analytics", "admin/keys", "admin/tenants", "assignments", "billing", "branding", "classes", "dashboards", "exports", "feedback", "homework", "imports", "lessons", "recordings", "reports", "scores", "students",
    "teachers", "v2/references", "v2/transcribe",
)
_ACTIONS = ("archive", "count", "create", "list", "preview", "remove", "restore", "search", "share", "show", "sync", "update")
#: the service's endpoints: every area with every action, and the scoring calls
ENDPOINTS = (*(f"{a}/{b}" for a in _AREAS for b in _ACTIONS), "healthz", "pronunciation", "references/pronunciation", "scripted", "tenants/config", "transcribe", "unscripted", "v2/scripted", "v2/unscripted")
DETAILS = ("discourse_markers", "pause_details", "repetitions", "filler_words_details")
DETAIL_FIELDS = {"text": "string", "start_index": "int", "end_index": "int", "description": "string", "duration": "double", "repeat_count": "int", "phonemes": "string"}
#: origin -> (table, column, name of the document's root, path of its words, path before its metric details)
DOCUMENTS = {
    "api_usage_logs.response_data": ("api_usage_logs", "response_data", "response", "response.pronunciation.words", "response.metrics"),
    "pronunciation_analyses.words": ("pronunciation_analyses", "words", "words", "words", None),
    "pronunciation_analyses.speech_metrics": ("pronunciation_analyses", "speech_metrics", "metrics", None, "metrics"),
}


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """Columns for all known endpoints, seen or not, and for any others that are found."""
    logs = table(spark, d, "api_usage_logs")
    types = sorted({*ENDPOINTS, *features.event_types(logs, "endpoint")})
    return features.entity_features(logs, "user_id", "endpoint", "created_at", "id", ["audio_duration_ms", "processing_time_ms"], types)


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "api_usage_logs")
    return features.entity_runs(logs, "user_id", "endpoint", "created_at", "id", ["audio_duration_ms", "processing_time_ms"])


def p3_trailing(spark: SparkSession, d: str) -> DataFrame:
    return rolling.trailing(table(spark, d, "api_usage_logs"), "api_key_id", "created_at", "id", ["audio_duration_ms"])


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(table(spark, d, "api_usage_logs"), "user_id", "created_at", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_id", "first_id", "last_id")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def _nodes(spark: SparkSession, d: str, want, with_fields: bool = True) -> DataFrame:
    """Packed nodes of all documents; ``kind`` is the place in ``want(words, metrics)``, which lists a path or None each."""
    found = None
    for origin, (name, column, root, words, metrics) in DOCUMENTS.items():
        paths = want(words, metrics)
        if any(paths):
            x = nested.nodes(table(spark, d, name), "id", column, origin, root, paths, with_fields)
            found = x if found is None else found.unionByName(x)
    return found


def _below(path: str | None, *keys: str) -> list[str | None]:
    return [path and f"{path}.{k}" for k in keys]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Words with no phoneme inside their interval, and all objects among the metric details."""
    found = _nodes(spark, d, lambda w, m: [w, *_below(w, "phonemes"), *_below(m, *DETAILS)], False)
    details = F.filter("nodes", lambda n: (n["kind"] >= 2) & ~n["scalar"])
    child = F.array(*map(F.lit, ("words", "phonemes", *DETAILS)))
    cases = nested.once_per_document(found, F.concat(nested.childless(F.col("nodes"), 0, 1), details), {"child": lambda n: F.get(child, n["kind"]), "pos": lambda n: n["pos"]})
    return cases.withColumnRenamed("row_id", "parent_id")


def _words(spark: SparkSession, d: str, with_fields: bool = True) -> DataFrame:
    """(origin, row_id, nodes, words): each word with its phonemes, by containment; null elements left out."""
    found = _nodes(spark, d, lambda w, m: [w, *_below(w, "phonemes")], with_fields)
    return found.withColumn("words", nested.families(F.col("nodes"), 0, 1))


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    """Words: place, text, score, number of phonemes. A scalar in place of a word is its text."""
    real = F.filter("words", lambda w: ~nested.is_null(w["parent"]))
    text = lambda w: F.coalesce(nested.field("word_text", "string")(w["parent"]), w["parent"]["fields"][""])
    columns = {"pos": lambda w: w["parent"]["pos"], "word_text": text, "word_score": lambda w: nested.field("word_score", "double")(w["parent"]), "n_phonemes": lambda w: F.size(w["children"])}
    return nested.once_per_document(_words(spark, d), real, columns)


def p7_phonemes(spark: SparkSession, d: str) -> DataFrame:
    """Phonemes: the place of their word, their own, label and score. A scalar in place of a phoneme is its label."""
    label = lambda n: F.coalesce(nested.field("ipa_label", "string")(n), n["fields"][""])
    one = lambda w, n: F.struct(w["parent"]["pos"].alias("word_pos"), n["pos"].alias("pos"), label(n).alias("ipa_label"), nested.field("phoneme_score", "double")(n).alias("phoneme_score"))
    rows = F.flatten(F.transform("words", lambda w: F.transform(F.filter(w["children"], lambda n: ~nested.is_null(n)), lambda n: one(w, n))))
    return nested.once_per_document(_words(spark, d), rows, {c: (lambda r, c=c: r[c]) for c in ("word_pos", "pos", "ipa_label", "phoneme_score")})


def p7_details(spark: SparkSession, d: str) -> DataFrame:
    """Metric details, each with its kind, place and fields; ``value`` holds elements that are scalars."""
    names = (*DETAILS, "speech_rate_over_time")
    x = _nodes(spark, d, lambda w, m: _below(m, *names))
    kinds = F.array(*map(F.lit, names))
    columns = {"detail": lambda n: F.get(kinds, n["kind"]), "pos": lambda n: n["pos"]} | {c: nested.field(c, t) for c, t in DETAIL_FIELDS.items()} | {"value": nested.field("", "string")}
    return nested.once_per_document(x, F.filter("nodes", lambda n: ~nested.is_null(n)), columns)


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    """The interval labels themselves: every word, phoneme and detail with its pre- and post-order number."""
    names = ("words", "phonemes", *DETAILS, "speech_rate_over_time")
    x = _nodes(spark, d, lambda w, m: [w, *_below(w, "phonemes"), *_below(m, *names[2:])], False)
    kinds = F.array(*map(F.lit, names))
    return nested.once_per_document(x, F.col("nodes"), {"node": lambda n: F.get(kinds, n["kind"])} | {c: (lambda n, c=c: n[c]) for c in ("pre", "post", "pos")})


_LOGS_ONCE = "(SELECT DISTINCT id, user_id, endpoint, api_key_id, created_at, audio_duration_ms, processing_time_ms FROM api_usage_logs)"

QUERIES = {
    "p2_features": p2_features, "p2_runs": p2_runs, "p3_trailing": p3_trailing, "p5_found": p5_found, "p5_sessions": p5_sessions,
    "p7_found": p7_found, "p7_words": p7_words, "p7_phonemes": p7_phonemes, "p7_details": p7_details, "p7_labels": p7_labels,
}

_SESSIONS = f"""
WITH l AS (SELECT DISTINCT id, user_id, created_at FROM api_usage_logs WHERE user_id IS NOT NULL AND created_at IS NOT NULL),
m AS (SELECT *, CASE WHEN created_at > lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM l),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at, id) AS no FROM m),
g AS (SELECT user_id, min(created_at) AS session_start, max(created_at) AS session_end, count(*) AS n_events,
  arg_min(id, {{'a': created_at, 'i': id}}) AS first_id, arg_max(id, {{'a': created_at, 'i': id}}) AS last_id FROM s GROUP BY user_id, no)
"""

_DOCS = """
WITH s AS (SELECT DISTINCT 'api_usage_logs.response_data' AS origin, id, response_data AS x FROM api_usage_logs
  UNION ALL SELECT DISTINCT 'pronunciation_analyses.words', id, words FROM pronunciation_analyses UNION ALL SELECT DISTINCT 'pronunciation_analyses.speech_metrics', id, speech_metrics FROM pronunciation_analyses),
t AS (SELECT origin, id, TRY_CAST(x AS JSON) AS j FROM s WHERE x IS NOT NULL),
o AS (SELECT origin, id, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM t),
m AS (SELECT origin, id, CASE WHEN origin LIKE '%response_data' THEN json_extract(j, '$.metrics') WHEN origin LIKE '%metrics' THEN j END AS m,
  CASE WHEN origin LIKE '%response_data' THEN json_extract(j, '$.pronunciation.words') WHEN origin LIKE '%words' THEN j END AS w FROM o),
c AS (SELECT origin, id, 'words' AS child, w AS v FROM m UNION ALL SELECT origin, id, k, json_extract(m, '$.' || k) FROM m, (SELECT unnest(['discourse_markers', 'pause_details', 'repetitions', 'filler_words_details']) AS k)),
l AS (SELECT origin, id, child, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] END AS xs FROM c),
e AS (SELECT origin, id, child, unnest(xs) AS x, CAST(generate_subscripts(xs, 1) - 1 AS INT) AS pos FROM l WHERE xs IS NOT NULL)
"""

ORACLES = {
    "p7_found": _DOCS + """SELECT origin, id AS parent_id, child, pos FROM e WHERE json_type(x) = 'OBJECT'
  AND (child <> 'words' OR coalesce(json_type(x, '$.phonemes'), 'NULL') = 'NULL' OR (json_type(x, '$.phonemes') = 'ARRAY' AND json_array_length(x, '$.phonemes') = 0))""",
    "p7_words": _DOCS + """SELECT origin, id AS row_id, pos, CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.word_text') ELSE json_extract_string(x, '$') END AS word_text,
  TRY_CAST(json_extract_string(x, '$.word_score') AS DOUBLE) AS word_score,
  CAST(CASE coalesce(json_type(x, '$.phonemes'), 'NULL') WHEN 'NULL' THEN 0 WHEN 'ARRAY' THEN json_array_length(x, '$.phonemes') ELSE 1 END AS INT) AS n_phonemes
FROM e WHERE child = 'words' AND json_type(x) <> 'NULL'""",
    "p7_phonemes": _DOCS + """, p AS (SELECT origin, id, pos AS word_pos, CASE json_type(x, '$.phonemes') WHEN 'ARRAY' THEN json_extract(x, '$.phonemes[*]') ELSE [json_extract(x, '$.phonemes')] END AS ps
  FROM e WHERE child = 'words' AND json_type(x) = 'OBJECT' AND json_type(x, '$.phonemes') <> 'NULL'),
q AS (SELECT origin, id, word_pos, unnest(ps) AS x, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS pos FROM p)
SELECT origin, id AS row_id, word_pos, pos, CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.ipa_label') ELSE json_extract_string(x, '$') END AS ipa_label,
  TRY_CAST(json_extract_string(x, '$.phoneme_score') AS DOUBLE) AS phoneme_score FROM q WHERE json_type(x) <> 'NULL'""",
    "p7_details": _DOCS.replace("'filler_words_details']", "'filler_words_details', 'speech_rate_over_time']") + """SELECT origin, id AS row_id, child AS detail, pos, json_extract_string(x, '$.text') AS text,
  TRY_CAST(json_extract_string(x, '$.start_index') AS INT) AS start_index, TRY_CAST(json_extract_string(x, '$.end_index') AS INT) AS end_index, json_extract_string(x, '$.description') AS description,
  TRY_CAST(json_extract_string(x, '$.duration') AS DOUBLE) AS duration, TRY_CAST(json_extract_string(x, '$.repeat_count') AS INT) AS repeat_count,
  CASE json_type(x, '$.phonemes') WHEN 'VARCHAR' THEN json_extract_string(x, '$.phonemes') END AS phonemes, CASE WHEN json_type(x) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(x, '$') END AS value
FROM e WHERE child <> 'words' AND json_type(x) <> 'NULL'""",
    "p2_features": f"""SELECT * FROM (PIVOT (SELECT user_id, endpoint, created_at, audio_duration_ms, processing_time_ms FROM {_LOGS_ONCE} WHERE user_id IS NOT NULL)
ON endpoint IN ({", ".join(f"'{e}'" for e in ENDPOINTS)}) USING count(*) AS n, max(created_at) AS last_at, CAST(sum(audio_duration_ms) AS BIGINT) AS audio_duration_ms,
CAST(sum(processing_time_ms) AS BIGINT) AS processing_time_ms GROUP BY user_id)""",
    "p2_runs": f"""SELECT user_id, endpoint, count(*) AS n, max(created_at) AS last_at, CAST(sum(audio_duration_ms) AS BIGINT) AS audio_duration_ms,
  CAST(sum(processing_time_ms) AS BIGINT) AS processing_time_ms FROM {_LOGS_ONCE} WHERE user_id IS NOT NULL GROUP BY user_id, endpoint""",
    "p3_trailing": f"""
WITH l AS (SELECT * FROM {_LOGS_ONCE} WHERE created_at IS NOT NULL),
c AS (SELECT unnest(generate_series((SELECT min(CAST(created_at AS DATE)) FROM l), (SELECT max(CAST(created_at AS DATE)) FROM l), INTERVAL 1 DAY))::DATE AS day),
g AS (SELECT api_key_id, CAST(created_at AS DATE) AS day, count(*) AS r, coalesce(sum(audio_duration_ms), 0) AS a, count(audio_duration_ms) AS k FROM l GROUP BY ALL),
x AS (SELECT k.api_key_id, c.day, coalesce(g.r, 0) AS r, coalesce(g.a, 0) AS a, coalesce(g.k, 0) AS k
  FROM (SELECT DISTINCT api_key_id FROM l) k CROSS JOIN c LEFT JOIN g ON g.api_key_id IS NOT DISTINCT FROM k.api_key_id AND g.day = c.day),
w AS (SELECT api_key_id, day,
  sum(r) OVER w7 AS r7, sum(a) OVER w7 AS a7, sum(k) OVER w7 AS k7, sum(r) OVER w30 AS r30, sum(a) OVER w30 AS a30, sum(k) OVER w30 AS k30 FROM x
  WINDOW w7 AS (PARTITION BY api_key_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY api_key_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT api_key_id, day, CAST(r7 AS BIGINT) AS requests_7d, CAST(r7 AS DOUBLE) / 7 AS avg_requests_7d, CAST(a7 AS BIGINT) AS audio_duration_ms_7d,
  CAST(a7 AS DOUBLE) / 7 AS avg_audio_duration_ms_7d, CASE WHEN k7 > 0 THEN CAST(a7 AS DOUBLE) / k7 END AS mean_audio_duration_ms_7d,
  CAST(r30 AS BIGINT) AS requests_30d, CAST(r30 AS DOUBLE) / 30 AS avg_requests_30d, CAST(a30 AS BIGINT) AS audio_duration_ms_30d,
  CAST(a30 AS DOUBLE) / 30 AS avg_audio_duration_ms_30d, CASE WHEN k30 > 0 THEN CAST(a30 AS DOUBLE) / k30 END AS mean_audio_duration_ms_30d FROM w""",
    "p5_found": _SESSIONS + "SELECT user_id, first_id, last_id FROM g",
    "p5_sessions": _SESSIONS + "SELECT user_id, session_start, session_end, CAST(epoch_us(session_end) - epoch_us(session_start) AS DOUBLE) / 1e6 AS duration_seconds, n_events, first_id, last_id FROM g",
}
