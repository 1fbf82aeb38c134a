"""The general training-data operators against brute force on small, dirty fixtures."""

import json
import random
from collections import defaultdict
from itertools import product
from datetime import date, datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veloquent.operators import features, nested, rolling, sessions
from veloquent.plans import training
from veloquent.tables import heavy_keys

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id string, user_id string, endpoint string, api_key_id string, created_at timestamp, audio_duration_ms int, n int, user string"


def make_rows(seed, n=600, hot=0.34):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if r.random() < hot else r.choice(["a", "b", "c", None])
        at = None if r.random() < 0.03 else T0 + timedelta(minutes=30 * r.randint(0, 900) + r.choice([0, 0, 1]))
        rows.append((f"i{i:04d}", user, r.choice(["x/y", "z", None]), r.choice(["k1", "k2", None]), at, r.choice([None, 0, 5, 7]), 1, "clash"))
    rows += [r.choice(rows) for _ in range(20)]  # delivered again
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return make_rows(request.param)


def uniq(rows):
    return list({r[0]: r for r in rows}.values())


def utc(t):
    return t and t.astimezone(timezone.utc)


@pytest.mark.parametrize("heavy", [[], ["hot"]])
def test_runs_count_each_id_once_hot_or_not(spark, rows, heavy):
    got = features.entity_runs(spark.createDataFrame(rows, SCHEMA), "user_id", "endpoint", "created_at", "id", ["audio_duration_ms"], heavy).collect()
    want = defaultdict(lambda: [0, None, None])
    for i, u, e, _, at, ms, *_ in uniq(rows):
        if u is not None:
            w = want[u, e]
            w[0] += 1
            w[1] = at if w[1] is None else max(w[1], at) if at else w[1]
            w[2] = (w[2] or 0) + ms if ms is not None else w[2]
    assert {(g[0], g[1]): [g["n"], utc(g["last_at"]), g["audio_duration_ms"]] for g in got} == dict(want)


def test_runs_share_one_shuffle_and_stream(spark, rows):
    df = features.entity_features(spark.createDataFrame(rows, SCHEMA), "user_id", "endpoint", "created_at", "id", ["audio_duration_ms"], ["x/y", "z"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" in plan


ARGS = ("user_id", "endpoint", "created_at", "id", ["audio_duration_ms", "n"])


@pytest.mark.parametrize("heavy", [[], ["hot"]])
def test_features_are_wide(spark, rows, heavy):
    df = features.entity_features(spark.createDataFrame(rows, SCHEMA), *ARGS, heavy=heavy)
    assert df.columns == ["user_id", *[f"{t}_{c}" for t in ("x/y", "z") for c in ("n", "last_at", "audio_duration_ms", "n")]]
    got = [list(g) for g in df.collect()]
    assert {g[0] for g in got} == {"hot", "a", "b", "c"} and len(got) == 4
    for g in got:
        for k, t in enumerate(("x/y", "z")):
            mine = [r for r in uniq(rows) if r[1] == g[0] and r[2] == t]
            ms = [r[5] for r in mine if r[5] is not None]
            assert [g[1 + 4 * k], utc(g[2 + 4 * k]), g[3 + 4 * k], g[4 + 4 * k]] == [len(mine), max(r[4] for r in mine if r[4]), sum(ms), len(mine)]
    empty = features.entity_features(spark.createDataFrame([], SCHEMA), *ARGS)
    assert empty.columns == ["user_id"] and empty.count() == 0


@pytest.mark.parametrize("heavy", [[], ["u"]])
def test_events_without_an_id_are_told_apart(spark, heavy):
    rows = [(None, "u", "e", None, T0, ms, 1, "") for ms in (1, 2, 2, None)] + [("i", "u", "e", None, T0, 5, 1, "")] * 2
    got = features.entity_runs(spark.createDataFrame(rows, SCHEMA), "user_id", "endpoint", "created_at", "id", ["audio_duration_ms"], heavy).collect()
    assert [(g["n"], g["audio_duration_ms"]) for g in got] == [(4, 8)]


def test_documents_without_an_id_are_told_apart(spark):
    rows = [(None, '[{"p": 1}]'), (None, '[{"p": 1}]'), (None, '[{"p": 2}, {"p": 3}]'), ("a", "[{}]"), ("a", "[{}]"), (None, None)]
    found = nested.nodes(spark.createDataFrame(rows, "id string, doc string"), "id", "doc", "o", "d", ["d"])
    got = nested.once_per_document(found, F.col("nodes"), {"pos": lambda n: n["pos"], "p": nested.field("p", "int")}).collect()
    assert sorted(((g["row_id"] or "", g["pos"], g["p"] or 0) for g in got)) == [("", 0, 1), ("", 0, 2), ("", 1, 3), ("a", 0, 0)]


def test_odd_type_names(spark):
    odd = ["a.b", "`c`", "", "d e"]
    df = spark.createDataFrame([("i%d" % i, "u", t, None, T0, i, 1, "") for i, t in enumerate(odd)], SCHEMA)
    got = features.entity_features(df, "user_id", "endpoint", "created_at", "id", ["audio_duration_ms"])
    assert got.columns[1::3] == [f"{t}_n" for t in sorted(odd)] and list(got.collect()[0])[3::3] == [odd.index(t) for t in sorted(odd)]


def test_a_heavy_user_costs_the_others_no_shuffle(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = features.entity_features(spark.createDataFrame(rows, SCHEMA), *ARGS, types=["x/y", "z"], heavy=["hot"])
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    both = plan.index("Filter (isnotnull(user_id#") if "Filter (isnotnull(user_id#" in plan else 0
    assert sum("REPARTITION_BY_COL" in x for x in lines) == 1  # the ordinary users' only shuffle
    assert all("_id" in x or "_k" in x or "hashpartitioning(_e" in x for x in lines) and len(lines) <= 4 and both >= 0
    top = next(x for x in plan.splitlines()[1:] if x.strip())
    assert "Union" in top  # the wide rows themselves are not shuffled


def test_heavy_keys_are_few_and_found(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [(None,)] * 90 + [(f"k{i}",) for i in range(20)], "k string")
    assert heavy_keys(df, "k", share=7, floor=10) == ["a", "b"] and heavy_keys(df, "k", share=4, floor=10) == ["a"]
    assert heavy_keys(df, "k") == [] and heavy_keys(df.limit(0), "k") == []


def test_too_many_types_is_an_error(spark, rows):
    with pytest.raises(ValueError):
        features.event_types(spark.createDataFrame(rows, SCHEMA), "id", 10)


def test_trailing_matches_brute_force(spark, rows):
    got = rolling.trailing(spark.createDataFrame(rows, SCHEMA), "api_key_id", "created_at", "id", ["audio_duration_ms"], (1, 7, 30)).collect()
    u = [r for r in uniq(rows) if r[4]]
    first, last = min(r[4] for r in u).date(), max(r[4] for r in u).date()
    assert len(got) == 3 * ((last - first).days + 1)
    for g in got:
        for w in (1, 7, 30):
            mine = [r for r in u if r[3] == g["api_key_id"] and g["day"] - timedelta(days=w) < r[4].date() <= g["day"]]
            ms = [r[5] for r in mine if r[5] is not None]
            assert g[f"requests_{w}d"] == len(mine) and g[f"audio_duration_ms_{w}d"] == sum(ms)
            assert g[f"avg_requests_{w}d"] == len(mine) / w
            assert g[f"mean_audio_duration_ms_{w}d"] == (sum(ms) / len(ms) if ms else None)


def test_trailing_of_nothing(spark):
    df = rolling.trailing(spark.createDataFrame([], SCHEMA), "api_key_id", "created_at", "id", ["audio_duration_ms"])
    assert df.count() == 0 and "requests_30d" in df.columns
    one = spark.createDataFrame([("i", "u", "e", "k", None, 1, 1, "")], SCHEMA)
    assert rolling.trailing(one, "api_key_id", "created_at", "id", []).count() == 0
    assert isinstance(date.today(), date)


def test_a_stray_date_is_an_error(spark):
    df = spark.createDataFrame([("i", "u", "e", "k", T0, 1, 1, ""), ("j", "u", "e", "k", T0.replace(year=9999), 1, 1, "")], SCHEMA)
    with pytest.raises(ValueError, match="stray"):
        rolling.trailing(df, "api_key_id", "created_at", "id", [])


def brute_sessions(rows):
    by = defaultdict(set)
    for i, u, _, _, at, *_ in rows:
        if u is not None and at is not None:
            by[u].add((at, i))
    out = []
    for u, xs in by.items():
        cur = []
        for x in sorted(xs):
            if cur and x[0] - cur[-1][0] > timedelta(minutes=30):
                out.append((u, cur[0][1], cur[-1][1], cur[0][0], cur[-1][0], len(cur)))
                cur = []
            cur.append(x)
        out.append((u, cur[0][1], cur[-1][1], cur[0][0], cur[-1][0], len(cur)))
    return sorted(out)


@pytest.mark.parametrize("parts,batch", [(1, 10000), (4, 7), (13, 3)])
def test_sessions_cross_partitions_and_batches(spark, rows, parts, batch):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sessions.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "created_at", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    flat = sorted((g["user_id"], g["first_id"], g["last_id"], utc(g["session_start"]), utc(g["session_end"]), g["n_events"]) for g in got)
    assert flat == brute_sessions(rows)
    assert all(g["duration_seconds"] == (g["session_end"] - g["session_start"]).total_seconds() for g in got)


def test_one_session_over_many_partitions(spark):
    rows = [(f"{i:05d}", "bot", None, None, T0 + timedelta(seconds=i), None, 1, "") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sessions.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "created_at", "id").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(g["first_id"], g["last_id"], g["n_events"]) for g in got] == [("00000", "02999", 3000)]
    assert sessions.sessions(spark.createDataFrame([], SCHEMA), "user_id", "created_at", "id").count() == 0


DOCS = [
    {"pronunciation": {"words": [{"word_text": "a", "phonemes": [{"ipa_label": "x", "phoneme_score": 1.5}, {"ipa_label": "y"}]}, None, {"word_text": "b", "phonemes": None}, {"word_text": "c"}, {"phonemes": []}, {"phonemes": {"ipa_label": "z"}}]}},
    {"metrics": {"pause_details": {"start_index": 1, "duration": 2.5}, "repetitions": [None, {"text": "t", "repeat_count": 3}], "discourse_markers": [], "speech_rate_over_time": [1, 2]}, "words": [{"word_text": "elsewhere"}]},
    {"pronunciation": {"words": {"word_text": "alone"}}},
    [],
    None,
    "just text",
    5,
    {},
]


def write(d, spark, docs):
    logs = [(f"r{i}", x, 1) for i, x in enumerate(docs)]
    spark.createDataFrame(logs + logs[:2], "id string, response_data string, pos int").write.parquet(f"{d}/api_usage_logs.parquet")
    pa = [("w1", json.dumps([{"word_text": "q"}, None, {"phonemes": [None]}]), "null"), ("w2", json.dumps({"word_text": "one"}), json.dumps(json.dumps({"filler_words_details": [{"text": "uh"}]}))), ("w3", None, '{"repetitions": [{'), ("w4", "[]", "{}")]
    spark.createDataFrame(pa, "id string, words string, speech_metrics string").write.parquet(f"{d}/pronunciation_analyses.parquet")
    return str(d)


def test_p7_cases(spark, tmp_path):
    docs = [json.dumps(x) for x in DOCS] + [json.dumps(json.dumps(DOCS[0])), json.dumps(DOCS[0])[:-3], "", None, "x" * 100_000, "[" * 5000 + "]" * 5000]
    d = write(tmp_path, spark, docs)
    got = sorted(tuple(r) for r in training.p7_found(spark, d).collect())
    o = "api_usage_logs.response_data"
    want = [(o, p, "words", i) for p in ("r0", "r8") for i in (2, 3, 4)] + [(o, "r2", "words", 0), (o, "r1", "pause_details", 0), (o, "r1", "repetitions", 1)]
    want += [("pronunciation_analyses.words", "w1", "words", 0), ("pronunciation_analyses.words", "w2", "words", 0), ("pronunciation_analyses.speech_metrics", "w2", "filler_words_details", 0)]
    assert got == sorted(want)
    words = {(r["row_id"], r["pos"]): r for r in training.p7_words(spark, d).collect()}
    assert words["r0", 0]["n_phonemes"] == 2 and words["r0", 5]["n_phonemes"] == 1 and words["r0", 2]["word_text"] == "b" and ("r0", 1) not in words
    phones = training.p7_phonemes(spark, d).collect()
    assert sorted((r["row_id"], r["word_pos"], r["pos"], r["ipa_label"], r["phoneme_score"]) for r in phones if r["row_id"] == "r0") == [("r0", 0, 0, "x", 1.5), ("r0", 0, 1, "y", None), ("r0", 5, 0, "z", None)]
    values = [r["value"] for r in training.p7_details(spark, d).collect() if r["detail"] == "speech_rate_over_time"]
    assert sorted(values) == ["1", "2"]
    labels = training.p7_labels(spark, d)
    inside = nested.contained(labels.filter("node = 'words'"), labels.filter("node = 'phonemes'")).collect()
    assert len(inside) == 2 * 3 + 1  # r0 and its copy r8; the null phoneme of w1 takes a place


def test_deep_documents_are_read(spark, tmp_path):
    deep = 100_000
    inner = '[' * deep + ']' * deep
    chain = '{"a":' * deep + "1" + "}" * deep
    docs = [json.dumps({"metrics": {"repetitions": [{"text": "t"}]}})[:-1] + f', "x": {inner}, "y": {chain}}}', f'{{"pronunciation": {{"words": [{{"word_text": "w", "more": {chain}}}]}}}}', inner, chain, inner[:-1]]
    d = write(tmp_path, spark, [*docs, json.dumps(docs[1])])
    o = "api_usage_logs.response_data"
    got = {tuple(r) for r in training.p7_found(spark, d).collect() if r["origin"] == o}
    assert got == {(o, "r0", "repetitions", 0), (o, "r1", "words", 0), (o, "r5", "words", 0)}
    whole = nested.label(nested.read_document(chain), nested.Paths.of("r", ["r" + ".a" * deep]))
    assert [x[1] - x[0] for x in whole] == [deep]  # a scalar at the very end of the path


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(0, 40), st.sampled_from(["", "}", "]", ",", " ", ":", '"', "1", "-", "\x01", "nul"]), st.sampled_from([None, 1]))
def test_deep_reader_reads_as_the_plain_one(doc, at, noise, indent):
    good = json.dumps(doc, indent=indent)
    for text in (good, good[:at] + noise + good[at:], good[:at]):
        try:
            want = json.loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                nested.parse_deep(text)
        else:
            assert nested.parse_deep(text) == want


def test_labels_are_intervals():
    r = random.Random(3)

    def tree(depth):
        k = r.random()
        if depth == 0 or k < 0.3:
            return r.choice([1, "s", None, True])
        return {f"k{i}": tree(depth - 1) for i in range(r.randint(0, 3))} if k < 0.7 else [tree(depth - 1) for _ in range(r.randint(0, 3))]

    def count(v):
        return 1 + sum(map(count, v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    def objects(v, path):
        """(path, values below) of every object, by recursion."""
        if isinstance(v, dict):
            yield path, count(v)
            for k, x in v.items():
                yield from objects(x, f"{path}.{k}")
        elif isinstance(v, list):
            for x in v:
                yield from objects(x, path)

    paths = ["root" + "".join(f".{k}" for k in ks) for n in range(6) for ks in product(("top", "k0", "k1", "k2"), repeat=n)]
    known = nested.Paths.of("root", paths)
    for _ in range(200):
        doc = {"top": tree(5)}
        rows = nested.label(doc, known)
        assert [x[2] for x in rows] == sorted(x[2] for x in rows)
        ends = [e for x in rows for e in x[1:3]]
        assert len(set(ends)) == len(ends)
        assert all(not (y[1] < x[1] < y[2] < x[2]) for x in rows for y in rows)
        # an interval is as long as the value has values, and paths lie inside the paths they start with
        assert sorted((paths[x[0]], (x[2] - x[1] + 1) // 2) for x in rows if not x[4]) == sorted(objects(doc, "root"))
        few = r.sample(paths, 20)
        some = nested.label(doc, nested.Paths.of("root", few), False)
        assert [(few[x[0]], *x[1:5]) for x in some] == [(paths[x[0]], *x[1:5]) for x in rows if paths[x[0]] in few]
        for x in rows:
            around = {paths[y[0]] for y in rows if y[1] < x[1] and x[2] < y[2]}
            assert all(paths[x[0]].startswith(p) for p in around)


def test_families_and_childless_by_brute_force(spark):
    r = random.Random(5)
    docs = [{"w": [r.choice([None, 3, {}, {"p": r.choice([None, [], {}, 1, [1], [None], [{}, {"q": [1, 2]}]])}]) for _ in range(r.randint(0, 6))]} for _ in range(60)]
    df = spark.createDataFrame([(str(i), json.dumps(x)) for i, x in enumerate(docs)], "id string, doc string")
    found = nested.nodes(df, "id", "doc", "o", "d", ["d.w", None, "d.w.p"])
    got = found.select("row_id", nested.childless(F.col("nodes"), 0, 2).alias("bare"), nested.families(F.col("nodes"), 0, 2).alias("all")).collect()

    def n_inside(w):
        p = w.get("p") if isinstance(w, dict) else None
        return len(p) if isinstance(p, list) else 0 if p is None else 1

    for g in got:
        ws = docs[int(g["row_id"])]["w"]
        assert [n["pos"] for n in g["bare"]] == [i for i, w in enumerate(ws) if isinstance(w, dict) and not n_inside(w)]
        assert [(f["parent"]["pos"], [c["pos"] for c in f["children"]]) for f in g["all"]] == [(i, list(range(n_inside(w)))) for i, w in enumerate(ws)]
    assert {g["row_id"] for g in got} == {str(i) for i, x in enumerate(docs) if x["w"]}
