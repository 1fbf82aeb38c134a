"""Sources, sinks, limits, intervals and streams on small fixtures."""

import io
import json
import random
import wave
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from veloquent.functions import hooks
from veloquent.operators import intervals, ratelimit, upsert
from veloquent.sources import audio, introspect, payload, sinks, textgrid
from veloquent.streaming import admission, counters

T0 = datetime(2025, 1, 31, 23, 0, tzinfo=timezone.utc)


def wav(samples, rate=16000, channels=1, width=2):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)
    return b.getvalue()


def test_audio(spark, tmp_path):
    tone = (np.sin(np.arange(1600) / 20) * 8000).astype("<i2")
    (tmp_path / "a.wav").write_bytes(wav(tone.tobytes()))
    (tmp_path / "b.wav").write_bytes(wav(np.repeat(tone[::2], 2).tobytes(), 8000, 2))
    (tmp_path / "c.wav").write_bytes(b"no audio")
    got = {r["path"][-5:]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert len(got["a.wav"]["samples"]) == 1600 and abs(max(map(abs, got["a.wav"]["samples"])) - 0.9) < 1e-6
    assert len(got["b.wav"]["samples"]) == 1600 and got["c.wav"]["samples"] is None
    assert audio.decode_wav(wav(b"", 16000)) == [] and audio.decode_wav(None) is None
    assert audio.decode_wav(wav(bytes([128, 255]), width=1))[1] == 0.9
    assert audio.decode_wav(wav(b"\x00\x00\x80\x00\x00\x40", width=3)) == [-0.9, 0.45]


GRID = '''File type = "ooTextFile"
item [1]:
    class = "IntervalTier"
    name = "Words"
    intervals [1]:
        xmin = 0
        xmax = 0.5
        text = "say ""hi"""
    intervals [2]:
        xmin = 0.5
        xmax = 1
        text = ""
item [2]:
    name = "phones"
    intervals [1]:
        xmin = 0.1
        xmax = 0.2
        text = "s"
item [3]:
    name = "other"
    intervals [1]:
        xmin = 0
        xmax = 1
        text = "x"
'''


def test_textgrid_and_containment(spark, tmp_path):
    (tmp_path / "u.TextGrid").write_text(GRID)
    got = textgrid.read_textgrids(spark, str(tmp_path)).cache()
    assert sorted((r["tier"], r["label"], r["start"], r["end"]) for r in got.collect()) == [("phones", "s", 0.1, 0.2), ("words", 'say "hi"', 0.0, 0.5)]
    inside = intervals.contained(got.filter("tier = 'words'"), got.filter("tier = 'phones'"), "path", 1.0).collect()
    assert [(r["outer_label"], r["inner_label"]) for r in inside] == [('say "hi"', "s")]


def test_containment_matches_brute_force(spark):
    r = random.Random(5)
    make = lambda n, size: [("u%d" % r.randint(0, 2), r.choice(["a", "sil", "b"]), x := round(r.uniform(0, 50), 2), round(x + r.uniform(0, size), 2)) for _ in range(n)]
    outer, inner = make(60, 9), make(80, 2)
    kind = "u string, label string, start double, end double"
    got = intervals.contained(spark.createDataFrame(outer, kind), spark.createDataFrame(inner, kind), "u", 3.0).collect()
    want = sorted((o, i) for o in outer for i in inner if o[0] == i[0] and i[1] != "sil" and i[2] + 1e-4 >= o[2] and i[3] - 1e-4 <= o[3])
    assert sorted(((g["u"], g["outer_label"], g["outer_start"], g["outer_end"]), (g["u"], g["inner_label"], g["inner_start"], g["inner_end"])) for g in got) == want


def test_payload(spark):
    doc = {"expected_text": "x", "ipa_sequence": ["a", "", None], "word_phonemes": [{"word_text": "x", "phonemes": ["p", " "]}]}
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(json.dumps(doc)),), ("{broken",), (None,), ("{}",)], "d string")
    got = [r[0] for r in df.select(payload.reference_payload(F.col("d"))).collect()]
    assert got[0] == got[1] and got[0]["ipa_sequence"] == ["a"] and got[0]["word_phonemes"][0]["phonemes"] == ["p"]
    assert got[2] is None and got[3] is None and got[4]["ipa_sequence"] == []
    x = payload.with_defaults(spark.createDataFrame([('{"a": "one", "s": 2}',), ("nope",), ('{"a": ["x", "y"]}',)], "j string"), "j", {"a": [], "s": 5.0, "t": "none"}).collect()
    assert [(r["a"], r["s"], r["t"]) for r in x] == [(["one"], 2.0, "none"), ([], 5.0, "none"), (["x", "y"], 5.0, "none")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1]), (2, "b", None)], "k int, p string, xs array<int>")
    sinks.append(df, f"{tmp_path}/t", ["p"])
    sinks.append(df, f"{tmp_path}/t", ["p"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    sinks.replace_partitions(df.filter("p = 'a'"), f"{tmp_path}/t", ["p"])
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("p").count().orderBy("p").collect()[0]["count"] == 1
    assert [r["xs"] for r in sinks.nested_as_json(df).orderBy("k").collect()] == ["[1]", None]
    sinks.write_dictionary(spark.createDataFrame([("Cat cat 12",)], "t string"), "t", f"{tmp_path}/d")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/d").collect()] == ["cat\tK AE0 T"]
    sinks.write_report(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "n string, s double"), "n", "s", f"{tmp_path}/r")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert lines[0] == "Mean: 1.50 over 2 rows" and lines[-2:] == ["| a | 1.00 |", "| b | 2.00 |"]


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, 10, "x"), (2, 10, "y"), (None, 1, "n")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 10, "z"), (3, None, "w"), (1, 5, "late")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in upsert.upsert(old, new, ["k"], "t").collect()} == {(1, "x"), (2, "z"), (3, "w"), (None, "n")}
    assert upsert.insert_absent(old, new, ["k"]).count() == 4
    patched = upsert.patch(old, spark.createDataFrame([(1, None), (2, "p")], "k int, v string"), ["k"]).collect()
    assert {r["v"] for r in patched} == {"x", "p", "n"}


def test_upserts_rewrite_the_parts_they_touch(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    plain = lambda df: sorted((r["k"] is None, r["k"] or 0, r["t"] or 0, r["v"]) for r in df.collect())
    first = spark.createDataFrame([(k, 1, f"v{k}") for k in range(200)] + [(None, 1, "n")], "k int, t int, v string")
    assert sinks.upsert_into(spark, path, first, ["k"], "t", parts=8) == list(range(8))
    state = first
    for t, rows in enumerate(([(5, 7, "new"), (5, 6, "older")], [(None, 9, "m"), (500, None, "x")], [(5, 1, "late")], [])):
        batch = spark.createDataFrame(rows, "k int, t int, v string")
        state = spark.createDataFrame(upsert.upsert(state, batch, ["k"], "t").collect(), first.schema)
        for _ in range(2):  # the second time changes nothing
            assert len(sinks.upsert_into(spark, path, batch, ["k"], "t")) <= len(rows)
            assert plain(sinks.read_upserted(spark, path)) == plain(state)
    wider = spark.createDataFrame([(7, 9, "w", 1.5)], "k int, t int, v string, more double")
    sinks.upsert_into(spark, path, wider, ["k"], "t")
    got = {r["k"]: r["more"] for r in sinks.read_upserted(spark, path).collect()}
    assert len(got) == 202 and got[7] == 1.5 and got[6] is None


def simulate(rows, limits):
    used, out = {}, {}
    for at, i, k in sorted({(at, i, k) for i, k, at in rows}):
        keys = [(k, "minute", at.replace(second=0, microsecond=0)), (k, "day", at.date()), (k, "month", (at.year, at.month))]
        full = next((p for (_, p, _), key, lim in zip(keys, keys, limits.get(k, (9**9,) * 3)) if used.get(key, 0) >= lim), None)
        out[i] = full
        # a request that fails a longer limit has passed the shorter ones; only served ones count against any
        for n, key in enumerate(keys):
            if full is None or n < ["minute", "day", "month"].index(full):
                used[key] = used.get(key, 0) + 1
    return out


def test_limits_against_a_simulator(spark):
    r = random.Random(11)
    limits = {"a": (2, 25, 40), "b": (3, 40, 45)}
    rows = [(f"i{n:04d}", r.choice(["a", "a", "b", "none"]), T0 + timedelta(seconds=20 * r.randint(0, 450) + 86400 * r.randint(0, 2))) for n in range(900)]
    keys = spark.createDataFrame([(k, *v) for k, v in limits.items()], "id string, minute_limit int, daily_limit int, monthly_limit int")
    df = spark.createDataFrame(rows + rows[:30], "id string, api_key_id string, created_at timestamp")
    got = {x["id"]: x["denied_by"] for x in ratelimit.decisions(df, keys).collect()}
    assert got == simulate(rows, limits) and {"minute", "day", "month", None} <= set(got.values())
    c = ratelimit.counters(df)
    assert c.filter("period = 'month'").agg(F.sum("n")).first()[0] == 900


def test_stream_counts_each_row_once(spark, tmp_path):
    rows = [(f"i{n}", "k", "u", T0 + timedelta(seconds=25 * n)) for n in range(40)]
    kind = "id string, api_key_id string, user_id string, created_at timestamp"
    spark.createDataFrame(rows + rows[:7], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    late = [("z", "k", "u", T0 + timedelta(days=20))]
    spark.createDataFrame(late, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    logs = counters.log_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], kind).schema)
    q = counters.window_counts(counters.once_stream(logs)).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 40
    s = counters.session_counts(logs.withWatermark("created_at", "1 day")).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.table("sessions").count() >= 1
    u = counters.upsert_sink(logs, f"{tmp_path}/state", f"{tmp_path}/u", ["api_key_id"], "created_at")
    u.awaitTermination()
    last = sorted((tmp_path / "state").iterdir())[-1]
    assert [r["id"] for r in spark.read.parquet(str(last)).collect()] == ["z"]


def test_stream_admission_equals_batch(spark, tmp_path):
    r = random.Random(3)
    limits = {"a": (2, 25, 40), "b": (3, 40, 45)}
    rows = sorted(((f"i{n:04d}", r.choice(["a", "b", "none"]), T0 + timedelta(seconds=20 * r.randint(0, 450) + 86400 * r.randint(0, 2))) for n in range(600)), key=lambda x: (x[2], x[0]))
    kind = "id string, api_key_id string, created_at timestamp"
    for k in range(3):  # three batches, in order of time
        spark.createDataFrame(rows[200 * k : 200 * (k + 1)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    keys = spark.createDataFrame([(k, *v) for k, v in limits.items()], "id string, minute_limit int, daily_limit int, monthly_limit int")
    (tmp_path / "in").mkdir()
    for k in range(3):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        logs = counters.log_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], kind).schema)
        q = admission.decisions(logs, keys).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {x["id"]: x["denied_by"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {x["id"]: x["denied_by"] for x in ratelimit.decisions(spark.createDataFrame(rows, kind), keys).collect()}
    assert got == want and {"minute", "day", "month", None} <= set(got.values())


def test_model_hook(spark):
    def load():
        return lambda texts: [[t.upper()] for t in texts]

    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    assert sorted(str(r[0]) for r in df.select(hooks.model_column(load, "array<string>")("t")).collect()) == ["None", "['A']", "['B']"]


def test_catalog(spark):
    introspect.register(spark, "/root/testdata/sf0.001", ["tenants"])
    assert introspect.columns(spark, ["tenants"]).first()["column_name"] == "id"
    assert introspect.views(spark).filter("table_name = 'tenants' AND temporary").count() == 1
    assert introspect.routines(spark, "regexp_extract*").count() >= 2


def test_staged_tables_go_with_their_block(spark):
    from veloquent import session

    with session.staging(spark):
        df = session.staged(spark.range(5), "block")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 5 and session.files(spark, path)
    assert session.files(spark, path) == []


def test_small_files_are_replaced_whole(spark, tmp_path):
    from veloquent import session

    path = f"file://{tmp_path}/x/manifest.json"
    for data in (b"", b"one", bytes(range(256)) * 100):
        session.write_bytes(spark, path, data)
        assert session.read_bytes(spark, path) == data
    assert [f for f in session.files(spark, f"file://{tmp_path}/x") if not f.startswith(".")] == ["manifest.json"]


def test_a_stream_keeps_the_newest_row_per_key(spark, tmp_path):
    from veloquent.streaming import counters

    schema = "k int, t int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (1, 3, "c")], schema).write.parquet(f"{tmp_path}/in")
    table, checkpoint = f"file://{tmp_path}/out", f"{tmp_path}/cp"

    def run():
        q = counters.upsert_sink(counters.log_stream(spark, f"{tmp_path}/in", schema, 1), table, checkpoint, ["k"], "t")
        q.awaitTermination()
        return sorted(map(tuple, sinks.read_upserted(spark, table).collect()))

    assert run() == [(1, 3, "c"), (2, 5, "b")]
    spark.createDataFrame([(2, 4, "late"), (3, 1, "d"), (1, 9, None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == run() == [(1, 9, None), (2, 5, "b"), (3, 1, "d")]


def test_files_for_executors_outlive_a_staging_block(spark):
    from pyspark import SparkFiles

    from veloquent import session

    with session.staging(spark):
        name = session.add_file(spark, "numbers.bin", b"123")
    assert spark.range(4).repartition(4).rdd.map(lambda _: open(SparkFiles.get(name), "rb").read()).collect() == [b"123"] * 4
