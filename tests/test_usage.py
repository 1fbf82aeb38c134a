"""Usage figures with one key at a third of the rows, against brute force, and the plans they run by."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest

from veloquent.operators import usage

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
LOG = "id string, api_key_id string, endpoint string, deep_analysis boolean, use_audio boolean, processing_time_ms int, audio_duration_ms int, created_at timestamp, tenant_id string, user_id string"


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(7)
    logs = []
    for i in range(500):
        key = "hot" if r.random() < 0.34 else r.choice(["k1", "k2", "off", "gone", None])
        at = None if r.random() < 0.05 else T0 + timedelta(hours=r.randint(0, 90))
        logs.append((f"i{i}", key, r.choice(["scripted", "transcribe", "x", None]), None, True, r.choice([None, -1, 5]), r.choice([None, 10]), at, r.choice([None, "t1", "t2"]), r.choice([None, "u1", "u2", "u3"])))
    keys = [("hot", True), ("k1", True), ("k2", None), ("off", False), ("idle", True)]
    bridge = [("hot", "t1"), ("hot", "t2"), ("k1", "t1"), ("off", "t2"), ("idle", "t3"), ("idle", "t4"), ("unknown", "t3")]
    tenants = [(t, f"name {t}", t, "active" if t != "t4" else "closed", T0) for t in ("t1", "t2", "t3", "t4", "t5")]
    dfs = [spark.createDataFrame(keys, "id string, is_active boolean"), spark.createDataFrame(bridge, "api_key_id string, tenant_id string"), spark.createDataFrame(tenants, "id string, display_name string, subdomain string, status string, created_at timestamp"), spark.createDataFrame(logs + logs[:30], LOG)]
    return dfs, keys, bridge, tenants, logs


def figures(mine):
    times = [x[5] for x in mine if x[5] is not None]
    audio = [x[6] for x in mine if x[6] is not None]
    at = [x[7] for x in mine if x[7]]
    return (sum(x[2] == "scripted" for x in mine), sum(times) / len(times) if times else None, sum(audio) if audio else None, len({x.date() for x in at}), max(at) if at else None)


def shown(g):
    last = g["last_activity"] and g["last_activity"].astimezone(timezone.utc)
    return (g["scripted_requests"], g["avg_processing_time"], g["total_audio_duration_ms"], g["active_days"], last)


def test_tenant_summary(frames):
    dfs, keys, bridge, tenants, logs = frames
    got = {g["tenant_id"]: g for g in usage.tenant_summary(*dfs).collect()}
    assert set(got) == {"t1", "t2", "t3", "t5"}
    for t, g in got.items():
        mine_keys = [k for k, x in bridge if x == t]
        rows = [x for k in mine_keys for x in logs if x[1] == k and k in dict(keys)]
        idle = sum(1 for k in mine_keys if k not in dict(keys) or not any(x[1] == k for x in logs)) + (not mine_keys)
        assert g["total_requests"] == len(rows) + idle
        assert g["unique_users"] == len({x[9] for x in rows} - {None})
        assert shown(g) == figures(rows)


def test_tenant_user_analytics(frames):
    dfs, keys, bridge, tenants, logs = frames
    want = defaultdict(list)
    for x in logs:
        if x[8] and x[9] and dict(keys).get(x[1]):
            for t in [t for k, t in bridge if k == x[1]] or [None]:
                want[x[8], t and f"name {t}", x[9]].append(x)
    got = usage.tenant_user_analytics(*dfs).collect()
    assert {(g["tenant_id"], g["tenant_name"], g["user_id"]) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        mine = want[g["tenant_id"], g["tenant_name"], g["user_id"]]
        assert (g["total_requests"], g["unique_endpoints_used"]) == (len(mine), len({x[2] for x in mine} - {None})) and shown(g) == figures(mine)


@pytest.mark.parametrize("name", ["tenant_summary", "tenant_user_analytics"])
def test_facts_shrink_before_they_are_joined(spark, frames, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(usage, name)(*frames[0])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    facts = [i for i, s in enumerate(lines) if "LogicalRDD" in s and "processing_time_ms" in s]
    for i in facts:
        above, d = [], depth(lines[i])
        for s in reversed(lines[:i]):
            if depth(s) < d:
                above.append(s.strip(" :+-"))
                d = depth(s)
        kinds = [s.split()[0] for s in above]
        joins = [k for k, s in enumerate(kinds) if s == "Join"]
        assert kinds[: min(joins)].count("Aggregate") >= 2  # once per id, then into partial sums
        assert above[min(joins)].startswith("Join Inner") or kinds[: min(joins)].count("Aggregate") >= 3
    assert facts
