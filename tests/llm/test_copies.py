"""The copy ledger against brute force, over formatting differences, records, batches and hot keys."""

import json
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from veloquent.llm import copies, queries

T0 = datetime(2025, 1, 20, tzinfo=timezone.utc)


def key(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", copies.canonical(F.col("t")).alias("c")).orderBy("i").select("c").collect()]


SAME = [
    ["Don't stop at 1.5, please", "  don’t STOP at 1.5 please!", "[Don't] *stop* at: 1.5 -- 'please'"],
    ["far-off", "Far off", "far\noff."],
    ['{"say": "Hi there", "level": "B2"}', "level: B2 | say: Hi there", "SAY = hi, there ;\nLevel=b2", ' \n{"LEVEL":"b2","say":"hi there."} ', "level: b2\r\nsay: hi there;"],
    ["a" * 50_000, "A" * 50_000 + "."],
    ["x " * 20_000, "(X)  " * 20_000],
]
APART = ["1.5", "15", "1 5", "dont", "don t", "don't", "level B2 say hi", "level: B2", "say: level: B2", '{"level": 2}', '{"level": "2", "say": null}', "level: B2 | mood: x", "stop.at", "é", "e"]


def test_same_texts_share_a_key(spark):
    for group in SAME:
        got = key(spark, group)
        assert len(set(got)) == 1 and got[0] is not None
    assert key(spark, [None, "", " \t", "...", "'", "-.-", " "]) == [None] * 7


def test_different_texts_do_not(spark):
    firsts = APART + [g[0] for g in SAME]
    got = key(spark, firsts)
    # stop.at is two words, as is a full stop with letters on both sides
    assert len(set(got)) == len(firsts) and None not in got
    assert key(spark, ["stop.at", "stop at"])[0] == key(spark, ["stop at"])[0]
    assert key(spark, ["level: a | level: b"]) != key(spark, ["level: b | level: a | level: a"])


def dirty(r, words):
    s = " ".join(words)
    k = r.randint(0, 4)
    return [s, s.upper(), s.replace(" ", "  ") + ".", f"*{s}*", s.replace(" ", ", ")][k]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    d = str(tmp_path_factory.mktemp("p1"))
    want, rows = defaultdict(list), {"api_usage_logs": [], "pronunciation_analyses": []}
    for name in rows:
        for i in range(700):
            words = ("hot",) if r.random() < 0.34 else (r.choice("abc"), r.choice("def"), str(r.randint(0, 20)))
            t = r.choice([None, "", "--"]) if r.random() < 0.1 else dirty(r, words)
            at = None if r.random() < 0.1 else T0 + timedelta(days=r.randint(0, 60))
            rows[name].append((f"{name[0]}{i:04d}", t, at, "clash", 1))
            if t and re.search(r"\w", t):
                want[name, words].append(f"{name[0]}{i:04d}")
        rows[name] += [r.choice(rows[name]) for _ in range(30)]
        rows[name].append((None, "hot", T0, "x", 1))
        spark.createDataFrame(rows[name], "id string, expected_text string, created_at timestamp, key string, copies int").write.parquet(f"{d}/{name}.parquet")
    return d, want


def test_found_matches_brute_force(spark, tables):
    d, want = tables
    got = {tuple(x) for x in queries.p1_found(spark, d).collect()}
    assert got == {(o, min(ids), i) for (o, _), ids in want.items() for i in ids if i != min(ids)}
    texts = {(x["origin"], x["first_id"]): x["copies"] for x in queries.p1_texts(spark, d).collect()}
    assert texts == {(o, min(ids)): len(ids) for (o, _), ids in want.items()}


def test_hot_keys_are_broadcast_and_whole(spark, tables):
    ledger = queries._ledger(spark, tables[0])
    assert ledger.batches == ["2025-01", "2025-02", "2025-03", "none"]
    cold = {tuple(x) for x in copies.copies(ledger).collect()}
    assert {tuple(x) for x in copies.copies(ledger, share=5, floor=1).collect()} == cold
    plan = copies.copies(ledger, share=5, floor=1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_neither_side_of_the_ledger_join_is_shuffled(spark, tables):
    ledger = queries._ledger(spark, tables[0])
    plan = ledger.read().hint("merge").join(ledger.read().withColumnRenamed("copies", "n"), "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def texts_of(ledger):
    return {(x["origin"], x["first_id"]): x["copies"] for x in ledger.read().collect()}


def rows_of(spark, pairs):
    """(id, text) as keyed rows."""
    return copies.keyed(spark.createDataFrame(pairs, "id string, t string"), "o", "id", "t", F.lit("b"))


def test_a_ledger_is_kept_up_by_several_sessions(spark, tables, tmp_path):
    d, want = tables
    path = f"file://{tmp_path}/ledger"
    rows = None
    for n in ("api_usage_logs", "pronunciation_analyses"):
        x = copies.keyed(spark.read.parquet(f"{d}/{n}.parquet"), n, "id", "expected_text", F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none")))
        rows = x if rows is None else rows.unionByName(x)
    one = copies.Ledger(spark, path, 4)
    assert one.add(rows.filter("batch = '2025-01'"), "2025-01") and one.add(rows.filter("batch = '2025-02'"), "2025-02")
    other = spark.newSession()
    moved = other.createDataFrame(rows.collect(), rows.schema)
    two = copies.Ledger(other, path)
    assert two.buckets == 4 and two.batches == ["2025-01", "2025-02"]
    before = texts_of(two)
    assert not two.add(moved.filter("batch = '2025-01'"), "2025-01") and texts_of(two) == before  # a batch sent again
    assert two.add(moved.filter("batch = '2025-01'"), "again under another name") and texts_of(two) == before  # rows sent again
    for b in ("2025-03", "none"):
        assert two.add(moved.filter(F.col("batch") == b), b)
    expected = {(o, min(ids)): len(ids) for (o, _), ids in want.items()}
    assert texts_of(two) == texts_of(copies.Ledger(spark, path)) == expected
    assert {tuple(x) for x in copies.copies(two).collect()} == {(o, min(ids), i) for (o, _), ids in want.items() for i in ids if i != min(ids)}
    assert not [t.name for t in spark.catalog.listTables() if "ledger" in t.name]


def test_a_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    ledger = copies.Ledger(spark, f"file://{tmp_path}/ledger", 16)
    ledger.add(rows_of(spark, [(f"i{i:03d}", f"text {i}") for i in range(300)]), "a")
    before = ledger._listed("keys")
    assert len(before) == 16
    ledger.add(rows_of(spark, [("h1", "text 7"), ("x1", "TEXT 7.")]), "b")
    after = ledger._listed("keys")
    changed = [b for b in before if after[b] != before[b]]
    assert len(changed) == 1 and set(after) == set(before)
    got = {r["first_id"]: r["copies"] for r in ledger.read().collect()}
    assert len(got) == 300 and got["h1"] == 3 and "i007" not in got and got["i008"] == 1
    ledger.add(rows_of(spark, [(f"j{i:03d}", f"text {i * 7}") for i in range(40)]), "c")  # many buckets, not all keys
    got = [r["copies"] for r in ledger.read().collect()]
    assert len(got) == 300 and sum(got) == 342


@pytest.mark.parametrize("cut", ["before the commit", "after the commit"])
def test_a_batch_cut_short(spark, tmp_path, monkeypatch, cut):
    path = f"file://{tmp_path}/ledger"
    first, second = rows_of(spark, [("a", "x"), ("b", "y")]), rows_of(spark, [("c", "x"), ("d", "z")])
    copies.Ledger(spark, path, 3).add(first, "1")
    ledger = copies.Ledger(spark, path)

    def fail(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(*((copies.session, "write_bytes") if cut.startswith("before") else (copies.Store, "take")), fail)
        with pytest.raises(OSError):
            ledger.add(second, "2")
    again = copies.Ledger(spark, path)
    assert again.batches == (["1"] if cut.startswith("before") else ["1", "2"])
    again.add(second, "2")
    assert texts_of(again) == texts_of(copies.Ledger(spark, path)) == {("o", "a"): 2, ("o", "b"): 1, ("o", "d"): 1}
    assert again.rows().count() == 4


def test_empty_tables(spark, tmp_path):
    for n in ("api_usage_logs", "pronunciation_analyses"):
        spark.createDataFrame([], "id string, expected_text string, created_at timestamp").write.parquet(f"{tmp_path}/{n}.parquet")
    assert queries.p1_found(spark, str(tmp_path)).count() == 0
    assert json.loads("1") == 1
