"""The queries pN_ of the llm problems, and their oracles where SQL can state them over whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.llm import copies, distinct, lookalike, packing, percentiles, tokens
from veloquent import session
from veloquent.tables import table


def _ledger(spark: SparkSession, d: str):
    rows = None
    for name in ("api_usage_logs", "pronunciation_analyses"):
        x = copies.keyed(table(spark, d, name), name, "id", "expected_text", F.date_format("created_at", "yyyy-MM"))
        rows = x if rows is None else rows.unionByName(x)
    return copies.build(spark, rows)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_ledger(spark, d))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """One record per text, with its number of copies."""
    return _ledger(spark, d).read().select("origin", "first_id", "copies")


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "api_usage_logs")
    return distinct.patterns(distinct.memberships(logs, "user_id", {"day": F.to_date("created_at"), "tenant_id": F.col("tenant_id")}))


_SETS = [("all", []), ("day", ["day"]), ("tenant", ["tenant_id"]), ("day_tenant", ["day", "tenant_id"])]


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct.by_sets(_patterns(spark, d), _SETS, ["day", "tenant_id"])


def p4_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable totals themselves: each pattern of days and tenants as text, and its number of users."""
    cell = lambda c: F.concat(F.coalesce(c["day"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(c["tenant_id"], F.lit("")))
    return _patterns(spark, d).select(F.array_join(F.transform("cells", cell), ";").alias("pattern"), "n")


def p4_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users per week: unions of seven days, which the daily counts alone could not give."""
    return distinct.coarser(_patterns(spark, d), lambda c: F.trunc(c["day"], "week"), "week")


def _times(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.histogram(table(spark, d, "api_usage_logs"), "id", "processing_time_ms", ["endpoint", "api_key_id"])


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_times(spark, d))


def p6_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The partial results themselves, which combine by adding: how often each value occurs in each group."""
    return _times(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.encode(table(spark, d, "documents"), "doc_id", "text", lengths_only=True)
    items = session.staged(sizes.select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size")), "sizes")
    capacities = table(spark, d, "context_sizes").select(F.col("size_name").alias("name"), F.col("max_tokens").alias("capacity"))
    packed = packing.pack(items, capacities)
    return packed.select(F.col("name").alias("size_name"), "container", F.col("item_id").alias("doc_id"), "piece", "start", "tokens")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_members(spark: SparkSession, d: str) -> DataFrame:
    """One row per document of a class of look-alikes, with the class's smallest document."""
    return lookalike.members(table(spark, d, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "canonical")


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts, "p4_distinct": p4_distinct, "p4_patterns": p4_patterns, "p4_weeks": p4_weeks, "p6_percentiles": p6_percentiles, "p6_histogram": p6_histogram, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found, "p10_members": p10_members, "p10_canonical": p10_canonical}

# words: what stands between is blanked out, then words are taken whole; RE2 has no look-around, so a word is spelled out
_WORD = r"(?:\p{L}(?:''\p{L})*|\p{Nd}(?:\.\p{Nd})*)+"


def _words(x: str) -> str:
    return f"array_to_string(regexp_extract_all(replace(lower({x}), '’', ''''), '{_WORD}'), ' ')"


_FIELD = r"'(?i)^[\s\p{Z}]*(level|focus|topic|say|pace)[\s\p{Z}]*[:=]'"
_SAME_TEXT = f"""
WITH t AS (SELECT DISTINCT 'api_usage_logs' AS origin, id, expected_text AS x FROM api_usage_logs WHERE expected_text IS NOT NULL
  UNION ALL SELECT DISTINCT 'pronunciation_analyses', id, expected_text FROM pronunciation_analyses WHERE expected_text IS NOT NULL),
w AS (SELECT *, {_words("x")} AS w, list_filter(regexp_split_to_array(x, '[|;\\r\\n]+'), lambda p: regexp_matches(p, '[^\\s\\p{{Z}}]')) AS pieces,
  TRY_CAST(nullif(regexp_replace(x, '^[\\s\\p{{Z}}]*([{{])|[\\s\\p{{Z}}]+$', '\\1', 'g'), x || 'x') AS JSON) AS j FROM t),
k AS (SELECT origin, id, CASE
  WHEN j IS NOT NULL AND json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0 AND len(list_filter(json_keys(j), lambda k: json_type(j, '$."' || k || '"') <> 'VARCHAR')) = 0
    THEN 'R' || array_to_string(list_sort(list_transform(json_keys(j), lambda k: lower(trim(k)) || chr(2) || {_words("json_extract_string(j, '$.\"' || k || '\"')")})), chr(1))
  WHEN len(pieces) >= 2 AND len(list_filter(pieces, lambda p: NOT regexp_matches(p, {_FIELD}))) = 0
    THEN 'R' || array_to_string(list_sort(list_transform(pieces, lambda p: lower(regexp_extract(p, {_FIELD}, 1)) || chr(2) || {_words("regexp_replace(p, " + _FIELD + ", '')")})), chr(1))
  ELSE 'T' || w END AS k FROM w WHERE w <> ''),
f AS (SELECT *, min(id) OVER (PARTITION BY origin, k) AS first_id FROM k)
"""

# letters of other scripts, and below each the letter it looks like
_SHAPES = (
    "АВЕЅІЇЈКМНОРСТУХԌԚԜӀҺаеѕіїјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳϹօՕոսհՍɡKÅᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴⲞⲟⲤⲥⲢⲣⲘⲚⲔⲎⲒⲦⲨⲬ",
    "ABESIÏJKMHOPCTYXGQWIHaesiïjopcyxhdqwABEZHIKMNOPTYXvocjCoOnuhUgKÅABCDEHJKLMPSTVWZBPDTGKJCZFMNLSRVHWXYAEIOUOoCcPpMNKHITYX",
)


def _skeleton() -> str:
    """A text in the form all texts that look the same share: joiners of pictures kept, what shows nothing left out, then one
    letter for another, then composed."""
    bases = dict(zip(*_SHAPES))
    single = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFFA0)} | bases
    single |= {chr(c): chr(k) for c, k in ((0xFF9E, 0x3099), (0xFF9F, 0x309A))}
    for c in range(0x370, 0x530):  # accented Greek and Cyrillic letters on such a letter
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0] in bases:
            new = unicodedata.normalize("NFC", bases[parts[0]] + parts[1:])
            if len(new) == 1:
                single[chr(c)] = new
    text = "text"
    for _ in range(2):  # a picture joined on both sides is met by the second round
        text = rf"regexp_replace({text}, '([\p{{So}}\p{{Sk}}]\x{{FE0F}}?)\x{{200D}}(\p{{So}})', '\1{chr(0xE000)}\2', 'g')"
    hidden = (
        r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
        r"\x{E0001}\x{E0100}-\x{E01EF}"
    )
    text = rf"regexp_replace(regexp_replace({text}, '[{hidden}]', '', 'g'), '[\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        text = f"replace({text}, '{sign}', '{letters}')"
    quoted = lambda xs: "".join(xs).replace("'", "''")
    return f"nfc_normalize(translate({text}, '{quoted(single)}', '{quoted(single.values())}'))"


_LOOK = f"""WITH k AS (SELECT doc_id, text, {_skeleton()} AS k FROM documents WHERE text IS NOT NULL),
v AS MATERIALIZED (SELECT * FROM k WHERE regexp_matches(k, '[^\\s\\p{{Z}}\\p{{C}}]'))
"""

ORACLES = {
    "p10_found": _LOOK + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.k = b.k AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_members": _LOOK + """, c AS (SELECT k, min(doc_id) AS class_id, count(DISTINCT text) AS n_texts, count(*) AS n_documents FROM v GROUP BY k)
SELECT doc_id, class_id, n_texts, CAST(n_documents AS BIGINT) AS n_documents FROM v JOIN c USING (k) WHERE n_texts > 1""",
    "p1_found": _SAME_TEXT + "SELECT origin, first_id, id AS copy_id FROM f WHERE id <> first_id",
    "p1_texts": _SAME_TEXT + "SELECT origin, first_id, count(*) AS copies FROM f GROUP BY ALL",
    "p4_distinct": """
SELECT CASE grouping(day) * 2 + grouping(tenant_id) WHEN 3 THEN 'all' WHEN 1 THEN 'day' WHEN 2 THEN 'tenant' ELSE 'day_tenant' END AS kind,
  day, tenant_id, count(DISTINCT user_id) AS n_distinct
FROM (SELECT CAST(created_at AS DATE) AS day, tenant_id, user_id FROM api_usage_logs WHERE user_id IS NOT NULL)
GROUP BY GROUPING SETS ((), (day), (tenant_id), (day, tenant_id))""",
    "p4_patterns": """
WITH c AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day, tenant_id FROM api_usage_logs WHERE user_id IS NOT NULL),
u AS (SELECT string_agg(coalesce(CAST(day AS VARCHAR), '') || '|' || coalesce(tenant_id, ''), ';' ORDER BY day NULLS FIRST, tenant_id NULLS FIRST) AS pattern FROM c GROUP BY user_id)
SELECT pattern, count(*) AS n FROM u GROUP BY pattern""",
    "p4_weeks": """SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(DISTINCT user_id) AS n_distinct FROM api_usage_logs WHERE user_id IS NOT NULL GROUP BY ALL""",
    "p6_histogram": """
WITH l AS (SELECT DISTINCT id, endpoint, api_key_id, CAST(processing_time_ms AS BIGINT) AS value FROM api_usage_logs WHERE processing_time_ms IS NOT NULL)
SELECT 'endpoint' AS kind, endpoint AS grp, value, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'api_key_id', api_key_id, value, count(*) FROM l GROUP BY ALL""",
    "p6_percentiles": """
WITH l AS (SELECT DISTINCT id, endpoint, api_key_id, processing_time_ms AS v FROM api_usage_logs WHERE processing_time_ms IS NOT NULL),
g AS (SELECT 'endpoint' AS kind, endpoint AS grp, v FROM l UNION ALL SELECT 'api_key_id', api_key_id, v FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY v) AS k, count(*) OVER (PARTITION BY kind, grp) AS n FROM g)
SELECT kind, grp, n, percentile, CAST(v AS BIGINT) AS value FROM r JOIN (SELECT unnest([25, 50, 75, 90, 95, 99]) AS percentile) ON k = (percentile * n + 99) // 100""",
}
